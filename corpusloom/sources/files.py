"""Files and question sets as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

EXTENSIONS = ("pdf", "docx", "txt", "md", "pptx", "xlsx")


def discover(spark: SparkSession, path: str, max_mb: int = 100) -> DataFrame:
    """Files below a folder, sorted by path: path, length, extension, error (null when they can be read)."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("path", "length")
    ext = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    error = F.when(~ext.isin(*EXTENSIONS), F.concat(F.lit("unsupported extension: "), ext)).when(F.col("length") > max_mb << 20, F.lit(f"larger than {max_mb} MB"))
    return files.select("path", "length", ext.alias("extension"), error.alias("error")).orderBy("path")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """Text and Markdown files: document_id, path, text, error (blank files)."""
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{txt,md}").load(path)
    text = F.try_validate_utf8(F.col("content").cast("string"))
    text = F.coalesce(text, F.decode("content", "ISO-8859-1"))
    return raw.select(document_id(F.col("path")).alias("document_id"), "path", text.alias("text"), F.when(F.trim(text) == "", F.lit("no text")).alias("error"))


def document_id(path):
    """A stable id from the path and the file's name."""
    name = F.element_at(F.split(path, "/"), -1)
    return F.concat(F.lit("doc_"), F.substring(F.md5(F.concat(path, F.lit("_"), name).cast("binary")), 1, 8))

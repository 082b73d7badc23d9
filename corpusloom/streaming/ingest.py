"""Documents that arrive as text files are chunked and appended as they come."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from corpusloom.operators.chunking import chunk_documents
from corpusloom.sources.files import document_id


def text_stream(spark: SparkSession, folder: str) -> DataFrame:
    """New files of a folder, one row each: document_id, path, text."""
    files = spark.readStream.format("text").option("wholetext", True).option("recursiveFileLookup", True).load(folder)
    return files.select(document_id(F.col("_metadata.file_path")).alias("document_id"), F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))


def ingest(spark: SparkSession, folder: str, target: str, checkpoint: str) -> StreamingQuery:
    """Chunk all files that have come since the last run; a batch that is repeated overwrites itself."""

    def write(batch: DataFrame, number: int) -> None:
        chunk_documents(batch.select("document_id", "text")).write.mode("overwrite").parquet(f"{target}/batch={number}")

    return text_stream(spark, folder).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

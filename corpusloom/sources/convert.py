"""Files to Markdown: checks, a converter of the caller's, parsers by suffix.

Every file is a row with its text or an error; none stops the others.
"""

from __future__ import annotations

import html.parser
import io
import os
import re
import zipfile
import zlib
from collections.abc import Callable
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.runtime import ship_package
from corpusloom.sources.files import document_id

ALLOWED = (".pdf", ".docx", ".txt", ".md", ".pptx", ".xlsx")
MAX_MB = 100
RESULT = "path string, success boolean, markdown string, error string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./\\]+)$", 1))


def validate(files: DataFrame, allowed: tuple[str, ...] = ALLOWED, max_mb: float = MAX_MB) -> DataFrame:
    """Files (path, length; no length for one that isn't there) with the error that keeps them from being read."""
    size = F.col("length") / F.lit(1024.0 * 1024.0)
    kind = suffix(F.col("path"))
    error = F.when(F.col("length").isNull(), F.concat(F.lit("File not found: "), "path")).when(size > max_mb, F.format_string("File too large: %.1f MB (max: %s MB)", size, F.lit(str(max_mb)))).when(~kind.isin(*allowed), F.concat(F.lit("Unsupported file type: "), kind))
    return files.withColumn("error", error)


def read_files(spark: SparkSession, paths: list[str]) -> DataFrame:
    """path, length and content of files; those that aren't there have neither."""
    asked = spark.createDataFrame([(p,) for p in paths], "path string")
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    there = [p for p in paths if (t := jvm.org.apache.hadoop.fs.Path(p)).getFileSystem(conf).exists(t)]
    if not there:
        return asked.select("path", F.lit(None).cast("long").alias("length"), F.lit(None).cast("binary").alias("content"))
    found = spark.read.format("binaryFile").load(there).select(F.regexp_replace("path", r"^file:/*", "/").alias("own"), "length", "content")
    return asked.join(found, F.regexp_replace("path", r"^file:/*", "/") == F.col("own"), "left").select("path", "length", "content")


def docx_text(content: bytes) -> str:
    """The paragraphs that hold text, stripped, with a blank line between."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    parts = []
    for p in root.iter(f"{_WORD}p"):
        pieces = {f"{_WORD}t": lambda x: x.text or "", f"{_WORD}tab": lambda x: "\t", f"{_WORD}br": lambda x: "\n"}
        parts.append("".join(pieces[x.tag](x) for x in p.iter() if x.tag in pieces).strip())
    return "\n\n".join(p for p in parts if p)


def pdf_pages(content: bytes) -> list[str]:
    """The text operators of a PDF's page streams; enough for plain and deflated streams with simple fonts."""
    pages = []
    for match in re.finditer(rb"stream\r?\n(.*?)\r?\nendstream", content, re.S):
        body = match.group(1)
        try:
            body = zlib.decompress(body)
        except zlib.error:
            pass
        if b"BT" not in body:
            continue
        text = []
        for line in re.finditer(rb"\((?:\\.|[^\\()])*\)|T\*|T[dDmJj]\b|'", body, re.S):
            token = line.group(0)
            if token[:1] == b"(":
                bare = re.sub(rb"\\([nrtbf()\\])", lambda m: {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"", b"f": b""}.get(m.group(1), m.group(1)), token[1:-1])
                text.append(re.sub(rb"\\([0-7]{1,3})", lambda m: bytes([int(m.group(1), 8) & 255]), bare).decode("latin-1"))
            elif token in (b"T*", b"Td", b"TD", b"Tm", b"'") and text and text[-1] != "\n":
                text.append("\n")
        pages.append("".join(text).strip())
    return pages


def pdf_text(content: bytes, pages: Callable[[bytes], list[str]] = pdf_pages) -> str:
    """Each page that holds text under its number."""
    told = [f"## Page {n}\n\n{text}" for n, text in enumerate(pages(content), 1) if text.strip()]
    if not told:
        raise ValueError("No text extracted from PDF (might be scanned/image-based)")
    return "\n\n".join(told)


class _Markdown(html.parser.HTMLParser):
    """HTML to Markdown: headings, list items, paragraphs; scripts and styles are left out."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        if tag in ("script", "style", "head"):
            self.hidden += 1
        elif re.fullmatch("h[1-6]", tag):
            self.parts.append("\n\n" + "#" * int(tag[1]) + " ")
        elif tag == "li":
            self.parts.append("\n- ")
        elif tag in ("p", "div", "ul", "ol", "table", "tr", "section", "article", "br"):
            self.parts.append("\n\n" if tag != "br" else "\n")

    def handle_endtag(self, tag):
        if tag in ("script", "style", "head"):
            self.hidden = max(0, self.hidden - 1)
        elif re.fullmatch("h[1-6]|p|ul|ol|table", tag):
            self.parts.append("\n\n")

    def handle_data(self, data):
        if not self.hidden:
            self.parts.append(re.sub(r"\s+", " ", data))


def html_text(content: bytes) -> str:
    parser = _Markdown()
    parser.feed(plain_text(content))
    lines = [x.strip() for x in "".join(parser.parts).split("\n")]
    return re.sub(r"\n{3,}", "\n\n", "\n".join(lines)).strip()


def plain_text(content: bytes) -> str:
    """UTF-8, else a byte-order mark's encoding, else Latin-1."""
    for encoding in ("utf-8-sig", *(("utf-16",) if content[:2] in (b"\xff\xfe", b"\xfe\xff") else ())):
        try:
            return content.decode(encoding)
        except UnicodeDecodeError:
            pass
    return content.decode("latin-1")


#: Parsers by suffix.
PARSERS: dict[str, Callable[[bytes], str]] = {".pdf": pdf_text, ".docx": docx_text, ".txt": plain_text, ".md": plain_text, ".html": html_text, ".htm": html_text}


def convert(files: DataFrame, primary: Callable[[str, bytes], str] | None = None, parsers: dict[str, Callable[[bytes], str]] | None = None, allowed: tuple[str, ...] = ALLOWED, max_mb: float = MAX_MB) -> DataFrame:
    """Files (path, length, content) to rows of path, success, markdown, error.

    The caller's converter goes first; where it fails, or gives blank text, the suffix's
    parser does.  A file that neither reads keeps the parser's error.
    """
    ship_package(files.sparkSession)
    known = PARSERS if parsers is None else parsers

    def one(path: str, content: bytes) -> tuple[bool, str, str | None]:
        if primary is not None:
            try:
                if (text := primary(path, content)).strip():
                    return True, text, None
            except Exception:  # noqa: BLE001  the parser gets its turn
                pass
        try:
            kind = os.path.splitext(path)[1].lower()
            if kind not in known:
                raise ValueError(f"No fallback converter for {kind}")
            text = known[kind](content)
            if not text.strip():
                raise ValueError(f"No text extracted from {kind[1:].upper()}")
            return True, text, None
        except Exception as e:  # noqa: BLE001  a broken file is a row with its error
            return False, "", f"Conversion failed: {e}"

    def run(parts):
        for pdf in parts:
            rows = [one(p, bytes(c)) if e is None else (False, "", e) for p, c, e in zip(pdf["path"], pdf["content"], pdf["error"], strict=True)]
            yield pd.DataFrame({"path": pdf["path"], "success": [r[0] for r in rows], "markdown": [r[1] for r in rows], "error": [r[2] for r in rows]})

    checked = validate(files, allowed, max_mb)
    # Files that fail a check are not sent to a worker with their content.
    return checked.select("path", F.when(F.col("error").isNull(), F.col("content")).alias("content"), "error").mapInPandas(run, RESULT)


def converted(results: DataFrame, files: DataFrame) -> DataFrame:
    """Results with a document's id, name, type and sizes."""
    name = F.regexp_extract("path", r"([^/\\]+)$", 1)
    both = results.join(files.select("path", F.col("length").alias("file_size_bytes")), "path", "left")
    return both.select("*", document_id(F.col("path")).alias("document_id"), name.alias("filename"), suffix(F.col("path")).alias("file_type"), F.length("markdown").alias("markdown_length"))


def write_markdown(documents: DataFrame, folder: str) -> DataFrame:
    """K1: each converted text as ``<id>_<stem>.md``; returns document_id, markdown_path and whether it was written."""
    stem = F.regexp_replace("filename", r"\.[^.]*$", "")
    named = documents.filter("success").select("document_id", F.concat_ws("_", "document_id", stem).alias("name"), "markdown")

    def run(parts):
        import pyarrow.fs

        files, root = pyarrow.fs.FileSystem.from_uri(folder)
        files.create_dir(root, recursive=True)
        for pdf in parts:
            paths, good = [], []
            for name, text in zip(pdf["name"], pdf["markdown"], strict=True):
                paths.append(f"{folder.rstrip('/')}/{name}.md")
                try:
                    with files.open_output_stream(f"{root}/{name}.md") as out:
                        out.write(text.encode())
                    good.append(True)
                except OSError:  # a text that can't be written is no reason to lose the others
                    good.append(False)
            yield pd.DataFrame({"document_id": pdf["document_id"], "markdown_path": paths, "written": good})

    return named.mapInPandas(run, "document_id string, markdown_path string, written boolean")

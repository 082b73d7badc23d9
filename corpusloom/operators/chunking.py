"""Markdown sections and size-controlled chunks, one document per row.

The size rules are a fold over a document's paragraphs, so they run in an Arrow batch
function, document by document; nothing is shuffled.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import ship_package

CHUNKS = "document_id string, chunk_id string, chunk_index int, total_chunks int, text string, token_count int, header string, header_level int, header_path string, start_char int, end_char int, has_code boolean, has_tables boolean, has_overlap boolean, merged boolean, emergency_split boolean"


def count_tokens(text: str) -> int:
    """X12 stand-in: words and single marks; a model's vocabulary can be put in its place."""
    return len(re.findall(r"\w+|[^\w\s]", text))


class TokenizerCounter:
    """Counts the tokens of a tokenizers file, which every machine has at ``path``; it is opened where it is used."""

    def __init__(self, path: str):
        self.path, self.tokenizer = path, None

    def __getstate__(self) -> dict:
        return {"path": self.path, "tokenizer": None}

    def __call__(self, text: str) -> int:
        if self.tokenizer is None:
            from tokenizers import Tokenizer

            self.tokenizer = Tokenizer.from_file(self.path)
        return len(self.tokenizer.encode(text, add_special_tokens=False).ids)


def sections(markdown: str) -> list[dict]:
    """Runs of lines under one heading; headings inside code fences don't count."""
    out, stack, fenced, at = [], [], False, 0
    now = {"header": None, "level": 0, "path": "", "lines": [], "start": 0, "code": False, "tables": False}
    for line in markdown.split("\n"):
        fence = line.strip().startswith("```")
        match = None if fenced or fence else re.match(r"^(#{1,6})\s+(.+)$", line)
        if match:
            out.append(now | {"end": at})
            stack = [h for h in stack if h[0] < len(match[1])] + [(len(match[1]), match[2].strip())]
            now = {"header": match[2].strip(), "level": len(match[1]), "path": " > ".join(h[1] for h in stack), "lines": [], "start": at, "code": False, "tables": False}
        else:
            now["lines"].append(line)
            now["code"] |= fence
            now["tables"] |= not fenced and not fence and "|" in line
        fenced ^= fence
        at += len(line) + 1
    return [s | {"text": "\n".join(s["lines"]).strip()} for s in [*out, now | {"end": len(markdown)}] if "\n".join(s["lines"]).strip()]


def split_long(text: str, most: int, count=count_tokens) -> list[str]:
    """Sentences packed up to ``most`` tokens; a longer single sentence stays whole."""
    parts, held, size = [], [], 0
    for sentence in re.split(r"(?<=[.!?])\s+", text):
        n = count(sentence)
        if held and size + n > most:
            parts.append(" ".join(held))
            held, size = [], 0
        held.append(sentence)
        size += n
    return parts + [" ".join(held)] if held else parts


def chunk_document(markdown: str, target: int = 500, least: int = 200, most: int = 800, overlap: int = 1, count=count_tokens) -> list[dict]:
    """Pack paragraphs, merge small chunks once with the next, split large ones, prepend the last sentence before."""
    packed = []
    for s in sections(markdown):
        meta = {k: s[k] for k in ("header", "level", "path", "start", "end", "code", "tables")} | {"merged": False, "split": False}
        if count(s["text"]) <= most:
            packed.append(meta | {"text": s["text"], "n": count(s["text"])})
            continue
        held, size = [], 0
        for paragraph in (p for p in re.split(r"\n\s*\n", s["text"]) if p.strip()):
            n = count(paragraph)
            if held and size + n > target:
                packed.append(meta | {"text": "\n\n".join(held).strip(), "n": size})
                held, size = [], 0
            held.append(paragraph)
            size += n
        if held:
            packed.append(meta | {"text": "\n\n".join(held).strip(), "n": size})
    sized, k = [], 0
    while k < len(packed):
        c = packed[k]
        if c["n"] < least and k + 1 < len(packed) and c["n"] + packed[k + 1]["n"] <= most:
            sized.append(c | {"text": c["text"] + "\n\n" + packed[k + 1]["text"], "n": c["n"] + packed[k + 1]["n"], "merged": True})
            k += 1
        elif c["n"] > most:
            sized += [c | {"text": t, "n": count(t), "split": True} for t in split_long(c["text"], most, count)]
        else:
            sized.append(c)
        k += 1
    out = []
    for k, c in enumerate(sized):
        text = c["text"]
        if k and overlap:
            text = " ".join(re.split(r"(?<=[.!?])\s+", sized[k - 1]["text"].strip())[-overlap:]) + "\n\n" + text
        out.append(c | {"text": text, "n": count(text) if k and overlap else c["n"], "overlap": bool(k and overlap)})
    return out


def chunk_documents(docs: DataFrame, target: int = 500, least: int = 200, most: int = 800, overlap: int = 1, count=count_tokens) -> DataFrame:
    """Chunks of (document_id, text); ids are ``document_id:index``.  Null or blank texts have none.

    count: of a text's tokens, a pattern's unless another counter is given.
    """
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import _parse_datatype_string

    ship_package(docs.sparkSession)
    schema = to_arrow_schema(_parse_datatype_string(CHUNKS))

    def run(batches):
        for batch in batches:
            rows = []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = chunk_document(text or "", target, least, most, overlap, count)
                rows += [(i, f"{i}:{k}", k, len(found), c["text"], c["n"], c["header"], c["level"], c["path"], c["start"], c["end"], c["code"], c["tables"], c["overlap"], c["merged"], c["split"]) for k, c in enumerate(found)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return docs.select(F.col("document_id").cast("string"), F.col("text").cast("string")).mapInArrow(run, CHUNKS)

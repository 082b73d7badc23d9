"""Packed exchanges between chunks of documents and slots of hashes.

Documents are dealt out to chunks of a bounded size; the number of chunks and of slots
follows the bytes of text, whatever the shuffle partitions.  A chunk sends each slot one
message: the distinct hashes that it holds there, in ascending order.  A slot answers
with one flag for each, which the chunk sets against the same list, made anew.  A key that
many documents share thus costs one entry a chunk, and no position ever travels back.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.runtime import ship_package

#: Bytes of text in a chunk, and what makes for one slot, about.
CHUNK_BYTES = 8 << 20
#: The kind of answers that say which hashes many chunks hold.
HOT = 2
#: What a row costs besides its text.
ROW_BYTES = 32


def select_texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def parts_of(texts: DataFrame, part_bytes: int = CHUNK_BYTES) -> int:
    """How many parts of ``part_bytes`` the texts make; one scan of their lengths."""
    size = texts.agg(F.sum(F.coalesce(F.octet_length("text"), F.lit(0)) + ROW_BYTES)).first()[0] or 0
    return max(2, -(-size // part_bytes))


def chunked(texts: DataFrame, chunks: int):
    """The texts (doc_id, text) in packed chunks, grouped; see ``kernels.unpack_documents``."""
    ship_package(texts.sparkSession)
    return texts.mapInArrow(K.pack_documents(chunks), K.PACKED).groupBy("slot")


def map_rows(docs: DataFrame, run) -> DataFrame:
    """``mapInArrow`` over whole rows that keeps their columns, whatever their names."""
    plain = docs.toDF(*[f"c{k}" for k in range(len(docs.columns))])
    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)


class Sent:
    """Distinct hashes of a chunk, by slot: what it sends, and what comes back."""

    def __init__(self, hashes: np.ndarray, slots: int):
        self.distinct, self.place, self.times = np.unique(hashes, return_inverse=True, return_counts=True)
        self.parts = list(K.dealt((self.distinct % np.uint64(slots)).astype(np.int32)))

    def messages(self, chunk: int, *flags: np.ndarray) -> pa.Table:
        """A message for each slot: chunk, upper halves of the hashes, flags of each."""
        short = self.distinct >> np.uint64(32)
        return K.packed_table([(slot, K.pack(chunk, K.steps(short[at].astype(np.int64)), *[K.bits(f[at]) for f in flags])) for slot, at in self.parts])

    def flags(self, answers: dict[int, np.ndarray]) -> np.ndarray:
        """The slots' answers (packed flags), for each distinct hash; those that didn't answer said no."""
        out = np.zeros(len(self.distinct), bool)
        for slot, at in self.parts:
            if slot in answers:
                out[at] = K.unbits(answers[slot], len(at))
        return out


class Received:
    """All messages of a slot."""

    def __init__(self, table: pa.Table):
        parts = [K.unpack(x) for x in table.column("payload").to_pylist()]
        self.chunks = [p[0] for p in parts]
        self.sizes = [len(p[1]) for p in parts]
        self.hashes = np.concatenate([K.unsteps(p[1]) for p in parts])
        self.flags = [np.concatenate([K.unbits(p[k], n) for p, n in zip(parts, self.sizes, strict=True)]) for k in range(2, len(parts[0]))]

    def answer(self, slot: int, yes: np.ndarray, kind: int = 0) -> pa.Table:
        """For each chunk with any yes, the flags of its hashes in their order."""
        rows, at = [], 0
        for chunk, n in zip(self.chunks, self.sizes, strict=True):
            own = yes[at : at + n]
            at += n
            if own.any():
                rows.append((chunk, K.pack(kind, slot, K.bits(own))))
        return K.packed_table(rows)


def answers_of(table: pa.Table, kind: int = 0) -> dict[int, np.ndarray]:
    """A chunk's answers of a kind, by slot."""
    parts = (K.unpack(x) for x in table.column("payload").to_pylist())
    return {p[1]: p[2] for p in parts if p[0] == kind}

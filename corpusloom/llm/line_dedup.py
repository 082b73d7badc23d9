"""Line deduplication with a sharded minimal perfect hash.

Lines' keys are hashed to 128 bits; the upper 64 are the fingerprint and choose the
shard, the lower 64 are hashed within it.  Batches of documents send each shard their
distinct line hashes once, with the smallest id and the number of documents.  A shard
merges them, lets go of lines that one document holds, and builds over the others a
minimal perfect hash (levels of bit arrays, in each of which the hashes that meet no
other are placed) with compact arrays by its index: fingerprint, saturating document
count, smallest document.  The shards are written once.

The documents then probe the arrays line by line.  Most lines are foreign to them: the
perfect hash gives these some index or none, and the fingerprint there tells them apart.
Arrays of at most ``max_broadcast`` bytes together go to all workers, and no text moves.
Larger ones stay in their shards: chunks of documents send them the distinct hashes they
probe with, and a flag for each comes back.

Cases: a null text is one empty line; a key under ``min_chars`` code points is always
kept; rows with the same id count as one document; a null id sorts first and comes
back null; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import exchange as X
from corpusloom.llm import kernels as K
from corpusloom.runtime import materialise, ship_package

RESULT = "doc_id long, kept_text string, n_lines long, n_dropped long"
_RESULT = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])
_SPACE = b" \t\n\r\x0b\x0c"
_LOW = 0xFFFFFFFFFFFFFFFF
#: Bytes of text for one shard, about.
SHARD_BYTES = 32 << 20
MAX_BROADCAST = 64 << 20


def line_hash(line: bytes, min_chars: int) -> int | None:
    """128 bits of the line's key; None where the key is too short to be judged."""
    key = line.strip(_SPACE).translate(K.LOWER)
    if len(key) < min_chars or not key.isascii() and len(key.decode("utf-8", "replace")) < min_chars:
        return None
    return xxhash.xxh3_128_intdigest(key)


class MinimalPerfectHash:
    """Each of n distinct 64-bit numbers gets its own index under n; others get any, or -1."""

    def __init__(self, levels: list[tuple[np.ndarray, int]]):
        """levels: each one's bits, packed, and their number."""
        self.levels, self.ranks, done = levels, [], 0
        for taken, _ in levels:
            counts = np.cumsum(np.bitwise_count(taken), dtype=np.int64)
            self.ranks.append((np.concatenate([[0], counts[:-1]]) + done).astype(np.uint32))
            done += int(counts[-1])

    @classmethod
    def build(cls, keys: np.ndarray) -> MinimalPerfectHash:
        levels: list[tuple[np.ndarray, int]] = []
        while len(keys):
            at = cls._place(keys, len(levels), size := 2 * len(keys) + 1)
            alone = np.bincount(at, minlength=size) == 1
            levels.append((np.packbits(alone, bitorder="little"), size))
            keys = keys[~alone[at]]
        return cls(levels)

    @staticmethod
    def _place(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (K.mix(keys + np.uint64((level + 1) * 0x9E3779B97F4A7C15 % (1 << 64))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        index, left = np.full(len(keys), -1), np.arange(len(keys))
        for k, ((taken, size), rank) in enumerate(zip(self.levels, self.ranks, strict=True)):
            at = self._place(keys[left], k, size)
            byte, bit = taken[at >> 3], (at & 7).astype(np.uint8)
            here = (byte >> bit) & 1 == 1
            below = np.bitwise_count(byte & ((np.uint8(1) << bit) - np.uint8(1)))
            index[left[here]] = rank[at[here] >> 3] + below[here]
            left = left[~here]
        return index


class Shard:
    """The arrays of one shard."""

    def __init__(self, levels, fingerprint: np.ndarray, count: np.ndarray, owner: np.ndarray):
        self.index, self.fingerprint, self.count, self.owner = MinimalPerfectHash(levels), fingerprint, count, owner

    @staticmethod
    def build(keys: np.ndarray, fingerprints: np.ndarray, counts: np.ndarray, owners: np.ndarray) -> bytes:
        index = MinimalPerfectHash.build(keys)
        order = np.argsort(index(keys))
        return K.pack(index.levels, fingerprints[order], counts[order], owners[order])

    def owners(self, keys: np.ndarray, fingerprints: np.ndarray) -> np.ndarray:
        """The smallest document of each line that several hold; the greatest number for others."""
        out = np.full(len(keys), np.iinfo(np.int64).max)
        at = self.index(keys)
        some = np.flatnonzero(at >= 0)
        some = some[(self.fingerprint[at[some]] == fingerprints[some]) & (self.count[at[some]] >= 2)]
        out[some] = self.owner[at[some]]
        return out


class Lines:
    """The long enough lines of a batch of documents: document, place, key and fingerprint."""

    def __init__(self, docs: K.Docs, min_chars: int):
        doc, place, low, high = [], [], [], []
        for k in range(len(docs)):
            for n, line in enumerate(docs.text(k).split(b"\n")):
                if (h := line_hash(line, min_chars)) is not None:
                    doc.append(k)
                    place.append(n)
                    low.append(h & _LOW)
                    high.append(h >> 64)
        self.doc, self.place = np.array(doc, np.int64), np.array(place, np.int64)
        self.keys, self.prints = np.array(low, np.uint64), np.array(high, np.uint64)
        self.ids = docs.ids[self.doc]
        self.distinct, self.sample, self.number = np.unique(self.keys ^ K.mix(self.prints), return_index=True, return_inverse=True)
        self.owner = np.full(len(self.distinct), np.iinfo(np.int64).max)
        np.minimum.at(self.owner, self.number, self.ids)

    def dealt(self, shards: int):
        return K.dealt((self.prints[self.sample] % np.uint64(shards)).astype(np.int32))


def _send(min_chars: int, shards: int):
    def run(batches):
        for docs in K.documents(batches, 4 * K.BATCH_BYTES):
            lines = Lines(docs, min_chars)
            pairs = np.unique(np.stack([lines.number, lines.ids], axis=1), axis=0)[:, 0]
            holders = np.minimum(np.bincount(pairs, minlength=len(lines.distinct)), 255).astype(np.uint8)
            rows = []
            for slot, at in lines.dealt(shards):
                k = lines.sample[at]
                rows.append((slot, K.pack(lines.keys[k], lines.prints[k], lines.owner[at], holders[at])))
            yield K.packed_rows(rows)

    return run


def _build(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    keys, prints, owners, holders = (np.concatenate(c) for c in zip(*(K.unpack(x) for x in table.column("payload").to_pylist()), strict=True))
    order = np.lexsort((owners, prints, keys))
    keys, prints, owners, holders = keys[order], prints[order], owners[order], holders[order]
    heads = np.flatnonzero(np.concatenate([[True], (keys[1:] != keys[:-1]) | (prints[1:] != prints[:-1])]))
    last = np.append(heads[1:], len(keys)) - 1
    count = np.minimum(np.add.reduceat(holders.astype(np.int64), heads), 255)
    # One document in several batches is one holder.
    count[(owners[heads] == owners[last]) & (np.maximum.reduceat(holders, heads) == 1)] = 1
    several = heads[count >= 2]
    # Two lines whose lower halves agree would have one place in the hash: all but unheard of, and refused.
    if len(np.unique(keys[several])) != len(several):
        raise ValueError("two lines agree in 64 bits of their hashes")
    return K.packed_table([(key[0].as_py(), Shard.build(keys[several], prints[several], count[count >= 2].astype(np.uint8), owners[several]))])


def _result(docs: K.Docs, times: np.ndarray, drop: dict[int, set[int]]) -> list[pa.Array]:
    out: tuple[list, ...] = ([], [], [], [])
    for k in range(len(docs)):
        text = docs.text(k)
        n = text.count(b"\n") + 1
        gone = drop.get(k, ())
        if gone:
            text = b"\n".join([x for i, x in enumerate(text.split(b"\n")) if i not in gone])
        for column, value in zip(out, (None if docs.ids[k] == K.NULL_ID else int(docs.ids[k]), text.decode(), n, len(gone)), strict=True):
            column.extend([value] * int(times[k]))
    return [pa.array(c, t) for c, t in zip(out, _RESULT.types, strict=True)]


def _dropped(lines: Lines, late: np.ndarray) -> dict[int, set[int]]:
    drop: dict[int, set[int]] = {}
    for k, n in zip(lines.doc[late].tolist(), lines.place[late].tolist(), strict=True):
        drop.setdefault(k, set()).add(n)
    return drop


def _probe(broadcast, label: str, min_chars: int, shards: int):
    """Documents against the arrays that every worker has."""

    def run(batches):
        opened: dict[int, Shard] = K.held(label, dict)
        for docs in K.documents(batches, 4 * K.BATCH_BYTES):
            lines = Lines(docs, min_chars)
            owner = np.empty(len(lines.distinct), np.int64)
            for slot, at in lines.dealt(shards):
                if slot not in opened:
                    opened[slot] = Shard(*K.unpack(broadcast.value[slot])) if slot in broadcast.value else Shard([], *[np.zeros(0, t) for t in (np.uint64, np.uint8, np.int64)])
                k = lines.sample[at]
                owner[at] = opened[slot].owners(lines.keys[k], lines.prints[k])
            yield pa.RecordBatch.from_arrays(_result(docs, np.ones(len(docs), np.int64), _dropped(lines, owner[lines.number] < lines.ids)), schema=_RESULT)

    return run


def _route(min_chars: int, shards: int):
    """The distinct lines of a chunk to the shards that hold their arrays."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        lines = Lines(K.unpack_documents(table)[0], min_chars)
        return K.packed_table([(slot, K.pack(key[0].as_py(), lines.keys[k := lines.sample[at]], lines.prints[k], lines.owner[at])) for slot, at in lines.dealt(shards)])

    return run


def _resident(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
    """A shard's answers: whether a smaller document than any of the chunk's holds the line."""
    rows = []
    if left.num_rows:
        shard = Shard(*K.unpack(left.column("payload")[0].as_py()))
        for payload in right.column("payload").to_pylist():
            chunk, keys, prints, owner = K.unpack(payload)
            late = shard.owners(keys, prints) < owner
            if late.any():
                rows.append((chunk, K.pack(0, key[0].as_py(), K.bits(late))))
    return K.packed_table(rows)


def _finish(min_chars: int, shards: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        docs, times = K.unpack_documents(left)
        lines, answers = Lines(docs, min_chars), X.answers_of(right)
        late = np.zeros(len(lines.distinct), bool)
        for slot, at in lines.dealt(shards):
            if slot in answers:
                late[at] = K.unbits(answers[slot], len(at))
        return pa.Table.from_arrays(_result(docs, times, _dropped(lines, late[lines.number] | (lines.ids > lines.owner[lines.number]))), schema=_RESULT)

    return run


def dedup_lines(docs: DataFrame, min_chars: int = 10, id_col: str = "doc_id", text_col: str = "text", max_broadcast: int = MAX_BROADCAST, chunk_bytes: int = X.CHUNK_BYTES) -> DataFrame:
    """Keep a line that several documents hold only in the one with the smallest id.

    Returns per input row: doc_id, kept_text, n_lines, n_dropped.
    """
    spark = docs.sparkSession
    ship_package(spark)
    texts = X.select_texts(docs, id_col, text_col)
    n = X.parts_of(texts, SHARD_BYTES)
    built = texts.mapInArrow(_send(min_chars, n), K.PACKED).groupBy("slot").applyInArrow(_build, K.PACKED)
    shards = materialise(built, "line-shards")
    size = shards.agg(F.sum(F.octet_length("payload"))).first()[0] or 0
    if size <= max_broadcast:
        arrays = spark.sparkContext.broadcast({r.slot: bytes(r.payload) for r in shards.collect()})
        return texts.mapInArrow(_probe(arrays, uuid.uuid4().hex, min_chars, n), RESULT)
    packed = X.chunked(texts, X.parts_of(texts, chunk_bytes))
    probes = packed.applyInArrow(_route(min_chars, n), K.PACKED).groupBy("slot")
    answers = shards.groupBy("slot").cogroup(probes).applyInArrow(_resident, K.PACKED)
    return packed.cogroup(answers.groupBy("slot")).applyInArrow(_finish(min_chars, n), RESULT)

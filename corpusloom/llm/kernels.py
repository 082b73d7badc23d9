"""Vectorised text kernels: word spans, rolling hashes and packed rows.

Texts are handled as UTF-8 bytes.  A batch of documents is one byte buffer with
offsets, so hashing and window arithmetic run in numpy for all documents at once.
White space is ``[\\x20\\x09-\\x0D]`` throughout.
"""

from __future__ import annotations

import ctypes
import pickle
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard

#: Stands for a null document id; it sorts before every other id.
NULL_ID = np.iinfo(np.int64).min
#: Bytes of text that are handled at once (a longer single text is one batch).
BATCH_BYTES = 2 << 20

PACKED = "slot int, payload binary"
_PACKED_ARROW = pa.schema([("slot", pa.int32()), ("payload", pa.binary())])

_R = 0x9E3779B97F4A7C15 | 1
_R_INV = pow(_R, -1, 1 << 64)
WHITE = np.zeros(256, bool)
WHITE[[9, 10, 11, 12, 13, 32]] = True
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_LOWER = np.frombuffer(LOWER, np.uint8)
_powers = [np.ones(1, np.uint64), np.ones(1, np.uint64)]
_libc = ctypes.CDLL(None)


_held: list = [None, None]


def release() -> None:
    """Give memory that is free back to the system; a worker lives on through other operators' tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(_libc, "malloc_trim", None)
    if trim is not None:
        trim(0)


def held(key, make):
    """The one costly thing that a worker keeps between tasks; it goes when another is asked for."""
    if _held[0] != key:
        clear()
        _held[:] = [key, make()]
    return _held[1]


def clear() -> None:
    """Let go of what other operators have kept."""
    if _held[0] is not None:
        _held[:] = [None, None]
        release()


def mix(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finaliser."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95))


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, at least ``n`` of each; those for very long runs are not kept."""
    if len(_powers[0]) >= n:
        return _powers[0], _powers[1]
    size, out = -(-n // (1 << 18)) << 18, []
    for base in (_R, _R_INV):
        steps = np.full(size, base, np.uint64)
        steps[0] = 1
        out.append(np.cumprod(steps, dtype=np.uint64))
    if size <= 1 << 22:
        _powers[:] = out
    return out[0], out[1]


class Rolling:
    """Polynomial prefix sums: the hash of any run of values in constant time."""

    def __init__(self, values: np.ndarray):
        n = len(values)
        power, self.inverse = _tables(n + 1)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(values * power[:n], dtype=np.uint64, out=self.sums[1:])

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        return mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts] + (ends - starts).astype(np.uint64))

    def every(self, k: int) -> np.ndarray:
        """Hashes of all runs of ``k`` values."""
        n = len(self.sums) - 1 - k + 1
        if n <= 0:
            return np.zeros(0, np.uint64)
        return mix((self.sums[k:] - self.sums[:n]) * self.inverse[:n])


class Docs:
    """A batch of documents: ids, one byte buffer, offsets."""

    def __init__(self, ids: np.ndarray, data: np.ndarray, offsets: np.ndarray):
        self.ids, self.data, self.offsets = ids, data, offsets

    def __len__(self) -> int:
        return len(self.ids)

    def text(self, k: int) -> bytes:
        return self.data[self.offsets[k] : self.offsets[k + 1]].tobytes()

    def lowered(self) -> "Docs":
        """A-Z in lower case."""
        return Docs(self.ids, _LOWER[self.data], self.offsets)

    def rolling(self) -> Rolling:
        return Rolling(_BYTE[self.data])

    def row_keys(self) -> np.ndarray:
        """64 bits of each row's id and whole text."""
        hashes = np.empty(len(self), np.uint64)
        for k in range(len(self)):
            hashes[k] = xxhash.xxh3_64_intdigest(self.data[self.offsets[k] : self.offsets[k + 1]])
        return mix(mix(self.ids.view(np.uint64)) + hashes)

    def words(self, space: np.ndarray = WHITE) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends of all words, and for each document its first word's index."""
        n = len(self.data)
        solid = ~space[self.data]
        before = np.zeros(n + 1, bool)
        before[1:] = solid
        before[self.offsets] = False
        after = np.zeros(n + 1, bool)
        after[:n] = solid
        after[self.offsets[1:]] = False
        starts = np.flatnonzero(solid & ~before[:n])
        ends = np.flatnonzero(solid & ~after[1:]) + 1
        return starts, ends, np.searchsorted(starts, self.offsets)

    def take(self, rows: np.ndarray) -> "Docs":
        lengths = np.diff(self.offsets)[rows]
        texts = [self.data[self.offsets[k] : self.offsets[k + 1]] for k in rows.tolist()]
        return Docs(self.ids[rows], np.concatenate([np.zeros(0, np.uint8), *texts]), np.concatenate([[0], np.cumsum(lengths)]))


def chunk_of(ids: np.ndarray, chunks: int) -> np.ndarray:
    return (mix(ids.view(np.uint64) + np.uint64(7)) % np.uint64(chunks)).astype(np.int32)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, step: int = 1 << 20) -> np.ndarray:
    """Each word's hash, about ``step`` bytes at a time, so that a long text needs little more than its words."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        end = max(k + 1, int(np.searchsorted(ends, starts[k] + step, "right")))
        a, b = int(starts[k]), int(ends[end - 1])
        out[k:end] = Rolling(_BYTE[data[a:b]]).runs(starts[k:end] - a, ends[k:end] - a)
        k = end
    return out


def window_hashes(word_hashes: np.ndarray, first: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Start indexes and hashes of all ``k``-word windows that stay in one document."""
    hashes = Rolling(word_hashes).every(k)
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    inside = np.flatnonzero(doc[: len(hashes)] == doc[k - 1 :][: len(hashes)]) if len(hashes) else np.zeros(0, np.int64)
    return inside, hashes[inside]


def from_arrow(ids: pa.Array, texts: pa.Array) -> Docs:
    ids = pc.fill_null(ids, int(NULL_ID)).to_numpy(zero_copy_only=False).astype(np.int64)
    texts = pc.fill_null(texts, "")
    wide = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    if not len(texts):
        return Docs(ids, np.zeros(0, np.uint8), np.zeros(1, np.int64))
    _, at, body = texts.buffers()
    offsets = np.frombuffer(at, wide)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = np.frombuffer(body, np.uint8) if body is not None else np.zeros(0, np.uint8)
    return Docs(ids, data[offsets[0] : offsets[-1]], offsets - offsets[0])


def pieces(docs: Docs, limit: int = BATCH_BYTES) -> Iterator[Docs]:
    """Split a batch where its bytes pass ``limit``."""
    k = 0
    while k < len(docs):
        end = max(k + 1, int(np.searchsorted(docs.offsets, docs.offsets[k] + limit, "right")) - 1)
        end = min(end, len(docs))
        at = docs.offsets[k : end + 1]
        yield Docs(docs.ids[k:end], docs.data[at[0] : at[-1]], at - at[0])
        k = end


def documents(batches: Iterable[pa.RecordBatch], limit: int = BATCH_BYTES) -> Iterator[Docs]:
    """Batches with an id and a text column, in this order, as ``Docs`` of bounded size."""
    for batch in batches:
        yield from pieces(from_arrow(batch.column(0), batch.column(1)), limit)


def pack(*arrays) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(pickle.dumps(arrays, 5))


def unpack(payload: bytes) -> tuple:
    return pickle.loads(zstandard.ZstdDecompressor().decompress(payload))


def narrow(x: np.ndarray) -> np.ndarray:
    """Non-negative integers in the smallest type that holds them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(np.uint8 if top < 1 << 8 else np.uint16 if top < 1 << 16 else np.uint32 if top < 1 << 32 else np.uint64)


def steps(x: np.ndarray) -> np.ndarray:
    """Ascending integers as differences."""
    return narrow(np.diff(x, prepend=0))


def unsteps(x: np.ndarray) -> np.ndarray:
    return np.cumsum(x, dtype=np.int64)


def packed_rows(rows: list[tuple[int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema=_PACKED_ARROW)


def packed_table(rows: list[tuple[int, bytes]]) -> pa.Table:
    release()
    return pa.Table.from_batches([packed_rows(rows)])


def dealt(slots: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """For each slot that occurs, the indexes of its entries in their order."""
    if not len(slots):
        return
    order = np.argsort(slots.astype(np.uint16) if int(slots.max()) < 1 << 16 else slots, kind="stable")
    ordered = slots[order]
    cuts = np.flatnonzero(np.diff(ordered)) + 1
    for part in np.split(order, cuts):
        yield int(slots[part[0]]), part


def pack_documents(chunks: int):
    """For mapInArrow: deals whole texts out to chunks by id and text; a batch's equal rows go once, with their number."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        clear()
        for docs in documents(batches, 4 * BATCH_BYTES):
            keys, first, times = np.unique(docs.row_keys(), return_index=True, return_counts=True)
            docs = docs.take(first)
            rows = []
            for slot, at in dealt(chunk_of(keys.view(np.int64), chunks)):
                texts = [docs.text(k) for k in at]
                rows.append((slot, pack(keys[at], docs.ids[at], narrow(times[at]), np.fromiter(map(len, texts), np.int64, len(texts)), b"".join(texts))))
            yield packed_rows(rows)

    return run


def unpack_documents(table: pa.Table) -> tuple[Docs, np.ndarray]:
    """A chunk's distinct documents, by id and key, always in the same order, and how often each occurs."""
    release()
    parts = [unpack(x) for x in table.column("payload").to_pylist()]
    if not parts:
        return Docs(np.zeros(0, np.int64), np.zeros(0, np.uint8), np.zeros(1, np.int64)), np.zeros(0, np.int64)
    keys, ids, times, lengths = (np.concatenate([p[c] for p in parts]) for c in range(4))
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    docs = Docs(ids, np.frombuffer(b"".join(p[4] for p in parts), np.uint8), offsets)
    distinct, first, place = np.unique(keys, return_index=True, return_inverse=True)
    total = np.bincount(place, times, len(distinct)).astype(np.int64)
    order = np.lexsort((distinct, ids[first]))
    return docs.take(first[order]), total[order]


def bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags)


def unbits(packed: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(packed, count=n).view(bool)


def sliding(x: np.ndarray, width: int, best) -> np.ndarray:
    """The best of each run of ``width`` values, by doubling."""
    if len(x) < width:
        return x[:0]
    have, out = 1, x
    while have * 2 <= width:
        out = best(out[:-have], out[have:])
        have *= 2
    if have < width:
        rest = width - have
        out = best(out[:-rest], out[rest:])
    return out


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1 ... of each run, one run after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))

"""Benchmark decontamination by greedy string tiling.

Texts are lower-cased and cut into words (letters and digits; bytes over 127 count as
letters).  A benchmark item's runs of ``min_match`` words are hashed and joined with every
rolling run of a document.  For a document and an item whose shared runs could cover
enough of the item, a running Karp-Rabin search with falling length finds the longest
common run of unmarked words and marks it, again and again, until none of ``min_match``
words is left; hashes only propose, words are compared.  Tiles may come in any order, so
reordered passages count.  The pair is reported when tiles cover ``coverage`` of the item.
An item of fewer than ``min_match`` words is one run: a document gives it away when it
holds all its words in a row.

The benchmark goes to the workers in blocks of at most ``block_bytes`` of text, each
read against all documents in one pass; documents never move.  Of a document's equal runs
one is looked up, so repetitive text makes no pairs of places.

Cases: null or empty texts, and those without a word, match nothing on either side;
repeated rows are judged each; null ids come back null; empty tables give an empty result;
other columns, whatever their names, pass through ``remove_contaminated`` and are
otherwise ignored.  A single text must fit a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import exchange as X
from corpusloom.llm import kernels as K
from corpusloom.runtime import ship_package

_APART = np.ones(256, bool)
_APART[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False
FILTER_BITS = 22
PAIRS = "doc_id long, item_id long, coverage double, n_tiles int, matched_words int, item_words int"
_PAIRS = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("coverage", pa.float64()), ("n_tiles", pa.int32()), ("matched_words", pa.int32()), ("item_words", pa.int32())])


def _words(docs: K.Docs) -> tuple[np.ndarray, np.ndarray]:
    starts, ends, first = docs.words(_APART)
    return K.word_hashes(docs.data, starts, ends), first


def lowered(ids: pa.Array, texts: pa.Array) -> K.Docs:
    return K.from_arrow(ids.cast(pa.int64()), pc.utf8_lower(pc.fill_null(texts, "")))


class _Side:
    """A sequence of words, some of them marked, with the hashes of its runs."""

    def __init__(self, words: np.ndarray, marked: np.ndarray):
        self.words, self.marked = words, marked
        self.rolling = K.Rolling(words)

    def runs(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Starts and hashes of the runs of ``n`` unmarked words."""
        if n > len(self.words):
            return np.zeros(0, np.int64), np.zeros(0, np.uint64)
        before = np.concatenate([[0], np.cumsum(self.marked)])
        at = np.flatnonzero(before[n:] == before[: len(before) - n])
        return at, self.rolling.every(n)[at]


def _longest(doc: _Side, item: _Side, least: int, most: int) -> int:
    """Length of the longest run of unmarked words that both may hold, by halving; 0 under ``least``."""
    low, high = least - 1, most
    while low < high:
        n = (low + high + 1) // 2
        if np.isin(item.runs(n)[1], doc.runs(n)[1]).any():
            low = n
        else:
            high = n - 1
    return low if low >= least else 0


def tiles(doc: np.ndarray, item: np.ndarray, min_match: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (document position, item position, length), longest first.

    doc, item: words as numbers.
    """
    doc, item = doc.astype(np.uint64), item.astype(np.uint64)
    # Words outside shared runs of min_match words are in no tile.
    open_ = np.zeros(len(doc) + 1, np.int64)
    a, b = _Side(doc, np.zeros(len(doc), bool)), _Side(item, np.zeros(len(item), bool))
    at, h = a.runs(min_match)
    shared = at[np.isin(h, b.runs(min_match)[1])]
    np.add.at(open_, shared, 1)
    np.add.at(open_, shared + min_match, -1)
    real = np.flatnonzero(np.cumsum(open_[:-1]) > 0)
    if not len(real):
        return []
    # The document without them; one marked place stands for each gap.
    place = np.insert(real, np.flatnonzero(np.diff(real) > 1) + 1, -1)
    a = _Side(np.where(place < 0, np.uint64(0), doc[place]), place < 0)
    found, n = [], min(len(item), len(place))
    while n := _longest(a, b, min_match, n):
        at, h = a.runs(n)
        order = np.argsort(h, kind="stable")
        at, h = at[order], h[order]
        item_at, item_h = b.runs(n)
        low, high = np.searchsorted(h, item_h), np.searchsorted(h, item_h, "right")
        passed: dict[int, int] = {}  # of equal runs of the document, those that can't be free any more
        for i, x, y in zip(item_at.tolist(), low.tolist(), high.tolist(), strict=True):
            if x == y or b.marked[i : i + n].any():
                continue
            k = passed.get(x, x)
            while k < y and (a.marked[at[k] : at[k] + n].any() or not np.array_equal(a.words[at[k] : at[k] + n], b.words[i : i + n])):
                k += 1
            passed[x] = k
            if k < y:
                d = int(at[k])
                found.append((int(place[d]), i, n))
                a.marked[d : d + n] = True
                b.marked[i : i + n] = True
        n -= 1
    return found


class Benchmark:
    """A block of items with an index of their runs, by length of run."""

    def __init__(self, docs: K.Docs, min_match: int):
        self.min_match = min_match
        self.ids = docs.ids
        words, first = _words(docs)
        self.items = [words[a:b] for a, b in zip(first, first[1:], strict=False)]
        sizes = np.diff(first)
        self.index: dict[int, tuple] = {}
        for n in range(1, min_match + 1):
            at, h = K.window_hashes(words, first, n)
            item = np.searchsorted(first, at, "right") - 1
            own = (sizes[item] == n) | (n == min_match)
            if own.any():
                at, h, item = at[own], h[own], item[own]
                order = np.argsort(h, kind="stable")
                field = np.zeros(1 << FILTER_BITS, bool)
                field[h >> np.uint64(64 - FILTER_BITS)] = True
                self.index[n] = h[order], item[order], (at - first[item])[order], np.packbits(field)

    def _shared(self, n: int, words: np.ndarray, first: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each document, the items and places of the runs of ``n`` words that it shares."""
        hashes, item, place, field = self.index[n]
        at, h = K.window_hashes(words, first, n)
        cell = h >> np.uint64(64 - FILTER_BITS)
        maybe = (field[cell >> np.uint64(3)] >> (np.uint8(7) - (cell & np.uint64(7)).astype(np.uint8))) & 1 == 1
        at, h = at[maybe], h[maybe]
        doc = np.searchsorted(first, at, "right") - 1
        order = np.lexsort((h, doc))
        doc, h = doc[order], h[order]
        new = np.ones(len(h), bool)
        new[1:] = (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])
        doc, h = doc[new], h[new]
        low, high = np.searchsorted(hashes, h), np.searchsorted(hashes, h, "right")
        real = high > low
        doc, low, high = doc[real], low[real], high[real]
        cuts = np.flatnonzero(np.diff(doc, prepend=-1))
        for x, y in zip(cuts.tolist(), [*cuts[1:].tolist(), len(doc)], strict=False):
            k = K.spread(low[x:y], high[x:y] - low[x:y])
            yield int(doc[x]), item[k], place[k]

    def matches(self, docs: K.Docs, coverage: float):
        """(document row, item row, tiles, matched words) of contaminated pairs."""
        words, first = _words(docs)
        for n in self.index:
            for d, items, places in self._shared(n, words, first):
                own = words[first[d] : first[d + 1]]
                order = np.lexsort((places, items))
                items, places = items[order], places[order]
                # How much of each item its shared runs cover, where they overlap once.
                same = np.zeros(len(items), bool)
                same[1:] = items[1:] == items[:-1]
                gain = np.full(len(items), n)
                gain[1:] = np.where(same[1:], np.minimum(n, np.diff(places)), n)
                heads = np.flatnonzero(~same)
                for i, within in zip(items[heads].tolist(), np.add.reduceat(gain, heads).tolist(), strict=True):
                    size = len(self.items[i])
                    if within < (coverage * size if size >= self.min_match else size):
                        continue
                    found = tiles(own, self.items[i], min(self.min_match, size))
                    matched = sum(t[2] for t in found)
                    if matched >= (coverage * size if size >= self.min_match else size):
                        yield d, i, found, matched


def _blocks(benchmark: DataFrame, min_match: int, block_bytes: int):
    """The benchmark as broadcast blocks of a bounded size."""
    spark = benchmark.sparkSession
    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text"))
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-size // block_bytes)
    for b in range(n):
        own = items if n == 1 else items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b)
        table = own.orderBy("item_id").toArrow().combine_chunks()
        for batch in table.to_batches():
            yield spark.sparkContext.broadcast(Benchmark(lowered(batch.column(0), batch.column(1)), min_match))


def contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """Pairs of a document and an item that it gives away: PAIRS."""
    spark = docs.sparkSession
    ship_package(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    out = spark.createDataFrame([], PAIRS)
    for block in _blocks(benchmark, min_match, block_bytes):

        def run(batches, block=block):
            K.clear()
            real = lambda i: None if i == K.NULL_ID else int(i)
            for batch in batches:
                for docs in K.pieces(lowered(batch.column(0), batch.column(1))):
                    b = block.value
                    rows = [(real(docs.ids[d]), real(b.ids[i]), n / len(b.items[i]), len(t), n, len(b.items[i])) for d, i, t, n in b.matches(docs, coverage)]
                    yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(_PAIRS.types)], schema=_PAIRS)

        out = out.unionByName(texts.mapInArrow(run, PAIRS))
    return out


def remove_contaminated(docs: DataFrame, benchmark: DataFrame, min_match: int = 5, coverage: float = 0.8, block_bytes: int = 16 << 20) -> DataFrame:
    """The documents, all columns, that give no item away."""
    ship_package(docs.sparkSession)
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")
    for block in _blocks(benchmark, min_match, block_bytes):

        def run(batches, block=block):
            K.clear()
            for batch in batches:
                clean, at = np.ones(batch.num_rows, bool), 0
                for piece in K.pieces(lowered(batch.column(id_at), batch.column(text_at))):
                    for d, *_ in block.value.matches(piece, coverage):
                        clean[at + d] = False
                    at += len(piece)
                yield batch.filter(pa.array(clean))

        docs = X.map_rows(docs, run)
    return docs

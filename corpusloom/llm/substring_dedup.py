"""Exact substring deduplication by fixed-block anchors.

Every document's non-overlapping blocks of ``window // 2`` words are the index;
every rolling window of that many words probes it.  Any repeat of ``window`` words
holds one whole reference block of its earlier copy, so no repeat is missed.  A block
that several places hold, one of them as a reference, is an anchor.

Each window that holds anchors is filed under the one of least hash, which equal
windows share wherever they stand; where that one stands in ``HOT_CHUNKS`` chunks, under it
and the next one together, so that a common phrase with many surroundings is spread.  The words around an anchor go to the anchor's slot,
and there the hit is extended to the left and to the right, word by word, among all
places at once: places stay in one class as long as their words agree.  Words are told
apart by their bytes, so hashes only bring places together and decide nothing.  Where
windows overlap, what is repeated joins up to maximal exact repeats.

Chunks of documents send each slot its distinct hashes, and each distinct surrounding of
an anchor once, with its first place; flags come back (see ``exchange``).  No pair of
places is ever built, and a passage in n documents costs an entry a chunk at most.

Cases: a null or empty text has no words and nothing to remove; a text shorter than
the window stays whole; rows that share a document id count as one document (a window
at the same place in two of them is no repeat); equal rows give equal results; a null id
sorts first and comes back null; an empty table gives an empty result; other columns are
ignored.  A single text must fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import exchange as X
from corpusloom.llm import kernels as K

RESULT = "doc_id long, kept_text string, n_words long, n_removed long, spans array<int>"
_RESULT = pa.schema([("doc_id", pa.int64()), ("kept_text", pa.string()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int32()))])
_NONE = np.uint64(0xFFFFFFFFFFFFFFFF)
#: An anchor of so many chunks is filed together with a second one.
HOT_CHUNKS = 256


class Blocks:
    """A chunk's words and rolling blocks."""

    def __init__(self, table: pa.Table, block: int, slots: int):
        self.docs, self.times = K.unpack_documents(table)
        self.starts, self.ends, self.first = self.docs.words()
        self.words = K.word_hashes(self.docs.data, self.starts, self.ends)
        self.at, self.hashes = K.window_hashes(self.words, self.first, block)
        self.sent = X.Sent(self.hashes, slots)

    def doc_of(self, words: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.first, words, "right") - 1


class Surroundings:
    """The runs of windows that are filed under one anchor each; equal ones have one number."""

    def __init__(self, b: Blocks, hits: np.ndarray, hot: np.ndarray, window: int, block: int, slots: int):
        n, shifts = len(b.words), window - block + 1
        masked = np.full(n + shifts, _NONE)
        masked[b.at] = np.where(hits[b.sent.place], b.hashes, _NONE)
        inside, _ = K.window_hashes(b.words, b.first, window)
        least = K.sliding(masked, shifts, np.minimum)
        inside = inside[least[inside] != _NONE]
        anchor = np.full(len(inside), -1)
        for d in range(shifts):
            here = (anchor < 0) & (masked[inside + d] == least[inside])
            anchor[here] = inside[here] + d
        second = self.second(inside, anchor, masked, b, hot, shifts)
        new = np.flatnonzero((np.diff(anchor, prepend=-1) != 0) | (np.diff(second, prepend=-2) != 0))
        self.begin, self.anchor = inside[new], anchor[new]
        self.size = np.diff(new, append=len(inside))  # windows
        self.hash, more = masked[self.anchor], second[new]
        self.hash = np.where(more < 0, self.hash, K.mix(self.hash ^ K.mix(masked[more])))
        doc = b.doc_of(self.begin)
        self.ids, self.pos = b.docs.ids[doc], self.anchor - b.first[doc]
        last = self.begin + self.size + window - 1
        whole = K.mix(K.Rolling(b.words).runs(self.begin, last) ^ (self.hash + (self.anchor - self.begin).astype(np.uint64)))
        order = np.lexsort((self.pos, self.ids, whole))
        new = np.ones(len(order), bool)
        new[1:] = whole[order][1:] != whole[order][:-1]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.sample = order[new]  # of each number, its first place
        self.parts = list(K.dealt((self.hash[self.sample] % np.uint64(slots)).astype(np.int32))) if len(order) else []

    @staticmethod
    def second(inside: np.ndarray, anchor: np.ndarray, masked: np.ndarray, b: Blocks, hot: np.ndarray, shifts: int) -> np.ndarray:
        """Where an anchor is hot, the next least one of each window; -1 elsewhere, and where there is none."""
        out, is_hot = np.full(len(inside), -1), np.zeros(len(masked), bool)
        is_hot[b.at] = hot[b.sent.place]
        own = np.flatnonzero(is_hot[anchor])
        best, place = np.full(len(own), _NONE), np.full(len(own), -1)
        for d in range(shifts if len(own) else 0):
            at = inside[own] + d
            value = np.where(at == anchor[own], _NONE, masked[at])
            better = value < best
            best[better], place[better] = value[better], at[better]
        out[own] = place
        return out

    def windows(self) -> np.ndarray:
        return self.size[self.sample]


def _send(block: int, slots: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        b = Blocks(table, block, slots)
        doc = b.doc_of(b.at)
        reference = np.zeros(len(b.sent.distinct), bool)
        reference[b.sent.place[(b.at - b.first[doc]) % block == 0]] = True
        return b.sent.messages(key[0].as_py(), reference, b.sent.times > 1)

    return run


def _anchors(hot_chunks: int):
    """Blocks that stand in several places, in one of them as a reference; and those of many chunks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got = X.Received(table)
        reference, several = got.flags
        _, place = np.unique(got.hashes, return_inverse=True)
        chunks = np.bincount(place)
        hits = (np.bincount(place, 1 + several) > 1) & (np.bincount(place, reference) > 0)
        slot = key[0].as_py()
        return pa.concat_tables([got.answer(slot, hits[place]), got.answer(slot, (hits & (chunks >= hot_chunks))[place], X.HOT)])

    return run


def _surround(window: int, block: int, slots: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if right.num_rows:
            b = Blocks(left, block, slots)
            s = Surroundings(b, b.sent.flags(X.answers_of(right)), b.sent.flags(X.answers_of(right, X.HOT)), window, block, slots)
            for slot, at in s.parts:
                k = s.sample[at]
                low, high = b.starts[s.begin[k]], b.ends[s.begin[k] + s.size[k] + window - 2]
                text = b"".join(b.docs.data[x:y].tobytes() for x, y in zip(low.tolist(), high.tolist(), strict=True))
                rows.append((slot, K.pack(key[0].as_py(), s.hash[k], K.narrow(s.anchor[k] - s.begin[k]), K.narrow(s.size[k]), s.ids[k], K.narrow(s.pos[k]), K.narrow(high - low), text)))
        return K.packed_table(rows)

    return run


def _classes(before: np.ndarray, more: np.ndarray) -> np.ndarray:
    """Classes of rows that agree in a class and in a code."""
    order = np.lexsort((more, before))
    a, b = before[order], more[order]
    new = np.zeros(len(order), np.int64)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


def first_places(hashes: np.ndarray, words: list[np.ndarray], anchor: np.ndarray, size: np.ndarray, ids: np.ndarray, pos: np.ndarray, window: int, block: int) -> np.ndarray:
    """For each window of each surrounding, whether no place of the same words is earlier.

    words: codes of all words, and where each surrounding's begin.  anchor: of its
    first word, within the surrounding; size: its windows; ids, pos: the anchor's place.
    """
    codes, at = words
    shifts = window - block
    code = lambda offset, real: np.where(real, codes[np.clip(at + offset, 0, len(codes) - 1)], -1)
    same = _classes(np.zeros(len(at), np.int64), hashes.view(np.int64))
    for k in range(block):
        same = _classes(same, code(anchor + k, np.ones(len(at), bool)))
    left, right = [same], [same]
    n_words = size + window - 1
    for k in range(shifts):
        left.append(_classes(left[-1], code(anchor - 1 - k, anchor > k)))
        right.append(_classes(right[-1], code(anchor + block + k, anchor + block + k < n_words)))
    out = np.zeros(int(size.sum()), bool)
    base = np.cumsum(size) - size
    for d in range(shifts + 1):  # windows that begin d words before the anchor
        k = np.flatnonzero((anchor >= d) & (anchor - d < size))
        if not len(k):
            continue
        group = _classes(left[d][k], right[shifts - d][k])
        order = np.lexsort((pos[k], ids[k], group))
        g = group[order]
        head = np.flatnonzero(np.diff(g, prepend=-1))[np.cumsum(np.diff(g, prepend=g[:1]) != 0)]
        earliest = (ids[k][order] == ids[k][order][head]) & (pos[k][order] == pos[k][order][head])
        out[base[k[order]] + anchor[k[order]] - d] = earliest
    return out


def _extend(window: int, block: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [K.unpack(x) for x in table.column("payload").to_pylist()]
        hashes, anchor, size, ids, pos, lengths = (np.concatenate([p[c] for p in parts]) for c in range(1, 7))
        anchor, size, pos = (x.astype(np.int64) for x in (anchor, size, pos))
        offsets = np.concatenate([[0], np.cumsum(lengths, dtype=np.int64)])
        docs = K.Docs(np.zeros(len(lengths), np.int64), np.frombuffer(b"".join(p[7] for p in parts), np.uint8), offsets)
        starts, ends, first = docs.words()
        solid = docs.data[K.spread(starts, ends - starts)]
        cuts = np.concatenate([[0], np.cumsum(ends - starts)])
        column = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(cuts), pa.py_buffer(solid)])
        codes = column.dictionary_encode().indices.to_numpy().astype(np.int64)
        earliest = first_places(hashes, (codes, first[:-1]), anchor, size, ids, pos, window, block)
        rows, at = [], 0
        for p in parts:
            n = int(p[3].sum(dtype=np.int64))
            rows.append((p[0], K.pack(1, key[0].as_py(), K.bits(earliest[at : at + n]))))
            at += n
        return K.packed_table(rows)

    return run


def _finish(window: int, block: int, slots: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        b = Blocks(left, block, slots)
        docs, n = b.docs, len(b.words)
        edge = np.zeros(n + 1, np.int64)
        if right.num_rows:
            s = Surroundings(b, b.sent.flags(X.answers_of(right)), b.sent.flags(X.answers_of(right, X.HOT)), window, block, slots)
            sizes, answers = s.windows(), X.answers_of(right, 1)
            base = np.cumsum(sizes) - sizes
            earliest = np.zeros(int(sizes.sum()), bool)
            for slot, at in s.parts:
                where = K.spread(base[at], sizes[at])
                earliest[where] = K.unbits(answers[slot], len(where))
            sample = s.sample[s.number]
            first = (s.ids == s.ids[sample]) & (s.pos == s.pos[sample])
            late = ~(earliest[K.spread(base[s.number], s.size)] & np.repeat(first, s.size))
            begin = K.spread(s.begin, s.size)[late]
            np.add.at(edge, begin, 1)
            np.add.at(edge, begin + window, -1)
        gone = np.cumsum(edge[:n]) > 0
        out: tuple[list, ...] = ([], [], [], [], [])
        for k in range(len(docs)):
            a, z = int(b.first[k]), int(b.first[k + 1])
            own = gone[a:z]
            text, spans = docs.text(k).split(), []
            if own.any():
                spans = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
                kept: list[bytes] = []
                at = 0
                for x, y in zip(spans[::2], spans[1::2], strict=True):
                    kept += text[at:x]
                    at = y
                text = kept + text[at:]
            values = (None if docs.ids[k] == K.NULL_ID else int(docs.ids[k]), b" ".join(text).decode(), z - a, z - a - len(text), spans)
            for column, value in zip(out, values, strict=True):
                column.extend([value] * int(b.times[k]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, _RESULT.types, strict=True)], schema=_RESULT)

    return run


def dedup_substrings(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = X.CHUNK_BYTES, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """Remove every word of a ``window``-word passage that starts earlier in the corpus.

    Earlier: in a document with a smaller id, or before in the same document.
    Returns per input row: doc_id, kept_text, n_words, n_removed, spans (removed
    word ranges, as begin, end, begin, end ...).
    """
    if window < 2:
        raise ValueError("window must be 2 words at least")
    block = window // 2
    texts = X.select_texts(docs, id_col, text_col)
    n = X.parts_of(texts, chunk_bytes)
    packed = X.chunked(texts, n)
    anchors = packed.applyInArrow(_send(block, n), K.PACKED).groupBy("slot").applyInArrow(_anchors(hot_chunks), K.PACKED)
    surroundings = packed.cogroup(anchors.groupBy("slot")).applyInArrow(_surround(window, block, n), K.PACKED)
    firsts = surroundings.groupBy("slot").applyInArrow(_extend(window, block), K.PACKED)
    answers = anchors.unionByName(firsts).groupBy("slot")
    return packed.cogroup(answers).applyInArrow(_finish(window, block, n), RESULT)

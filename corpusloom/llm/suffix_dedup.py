"""Byte-level deduplication from the common-prefix interval tree of a suffix array.

The suffix array is sharded so that every repeated string meets in one shard: each
``window``-byte string is filed under its minimiser (the least of its 16-byte
hashes), which equal strings share wherever they stand.  First only the minimisers'
hashes travel; where one is found in a single document its strings can't repeat, and
their text is never sent.  The strings around the others go to their minimiser's
shard, equal ones of a chunk once, with their smallest document.  A minimiser that stands
in ``HOT_CHUNKS`` chunks files its windows together with the next least gram of each, so
that a common phrase with many surroundings is spread over shards.

A shard sorts the suffixes of its distinct strings, computes the common prefixes of
neighbours and scans them with a stack.  Each interval of the tree whose members
differ in the byte to their left is a maximal repeat group; it holds all occurrences,
and those outside its smallest document are removed.  A string with several places
is a leaf with several occurrences.

A shard's strings reach as far as their windows share the minimiser, ``2 * window - 16``
bytes at most.  Its groups are thus maximal within these strings, not within whole
texts, and a string's first suffix counts as diverse to the left; a longer repeat comes
out as the overlapping groups of its minimisers, which join up again in the document.

Cases: a null or empty text has no bytes; texts shorter than the window stay; rows
with the same id count as one document; equal rows give equal results; a null id sorts
first and comes back null; an empty table gives an empty result; other columns are
ignored.  The kept bytes are binary, since a cut may fall within a character.  A single
text must fit a task.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from corpusloom.llm import exchange as X
from corpusloom.llm import kernels as K

GRAM = 16
#: A minimiser of so many chunks is filed together with a second gram.
HOT_CHUNKS = 256
RESULT = "doc_id long, kept binary, n_bytes long, n_removed long, spans array<int>"
_RESULT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.int32()))])


class Minimisers:
    """A chunk's bytes, and the places of its windows' minimisers."""

    def __init__(self, table: pa.Table, window: int, slots: int):
        self.docs, self.times = K.unpack_documents(table)
        span = window - GRAM + 1
        places, hashes, at = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0
        for docs in K.pieces(self.docs):
            n = len(docs.data)
            if n >= window:
                grams = docs.rolling().every(GRAM)
                short = self.short(grams)
                least = self.least(docs, short, window)
                padded = np.zeros(len(least) + 2 * (span - 1), np.uint32)
                padded[span - 1 : span - 1 + len(least)] = least
                chosen = np.flatnonzero(K.sliding(padded, span, np.maximum) == short)
                places.append(chosen + at)
                hashes.append(grams[chosen])
            at += n
        self.at, self.hashes = np.concatenate(places), np.concatenate(hashes)
        self.sent = X.Sent(self.hashes, slots)

    @staticmethod
    def short(grams: np.ndarray) -> np.ndarray:
        """32 bits of each gram's hash; never zero, which stands for no window."""
        return np.maximum((grams >> np.uint64(32)).astype(np.uint32), np.uint32(1))

    @staticmethod
    def least(docs: K.Docs, short: np.ndarray, window: int) -> np.ndarray:
        """The least gram hash of each window; 0 where it leaves its document."""
        least = K.sliding(short, window - GRAM + 1, np.minimum)
        doc = np.repeat(np.arange(len(docs), dtype=np.int32), np.diff(docs.offsets))
        least[doc[: len(least)] != doc[window - 1 :]] = 0
        return least

    def doc_of(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.docs.offsets, at, "right") - 1


class Strings:
    """The strings around the minimisers that hit; equal ones have one number."""

    def __init__(self, m: Minimisers, hits: np.ndarray, hot: np.ndarray, window: int, slots: int):
        span = window - GRAM + 1
        own = hits[m.sent.place] if len(m.at) else np.zeros(0, bool)
        at, hashes, hot = m.at[own], m.hashes[own], hot[m.sent.place][own] if len(m.at) else own
        begins, ends, filed, whole, base, done = [], [], [np.zeros(0, np.uint64)], [], 0, 0
        for docs in K.pieces(m.docs):
            n = len(docs.data)
            part = slice(done, int(np.searchsorted(at, base + n)))
            done = part.stop
            if part.stop > part.start:
                rolling = docs.rolling()
                short = Minimisers.short(rolling.every(GRAM))
                least = Minimisers.least(docs, short, window)
                here = at[part] - base
                begin, end = np.full(len(here), -1), np.zeros(len(here), np.int64)
                for d in range(span - 1, -1, -1):  # windows that begin d bytes before the minimiser
                    start = here - d
                    real = (start >= 0) & (start < len(least))
                    real[real] = least[start[real]] == short[here[real]]
                    begin = np.where(real & (begin < 0), start, begin)
                    end = np.where(real, start + window, end)
                real = begin >= 0
                begin, end, here, hash_, split = begin[real], end[real], here[real], hashes[part][real], hot[part][real]
                if split.any():
                    cut = self.cut(begin[split], end[split], here[split], hash_[split], short, window)
                    begin, end, hash_ = (np.concatenate([x[~split], y]) for x, y in zip((begin, end, hash_), cut, strict=True))
                begins.append(begin + base)
                ends.append(end + base)
                filed.append(hash_)
                whole.append(rolling.runs(begin, end))
            base += n
        none = np.zeros(0, np.int64)
        self.begin, self.end = np.concatenate([none, *begins]), np.concatenate([none, *ends])
        self.hash = np.concatenate(filed)
        self.ids = m.docs.ids[m.doc_of(self.begin)]
        whole = np.concatenate([np.zeros(0, np.uint64), *whole])
        order = np.lexsort((self.ids, whole))
        new = np.ones(len(order), bool)
        new[1:] = whole[order][1:] != whole[order][:-1]
        self.number = np.empty(len(order), np.int64)
        self.number[order] = np.cumsum(new) - 1
        self.sample = order[new]  # of each number, its place in the smallest document
        self.parts = list(K.dealt((self.hash[self.sample] % np.uint64(slots)).astype(np.int32)))

    @staticmethod
    def cut(begin: np.ndarray, end: np.ndarray, anchor: np.ndarray, hashes: np.ndarray, short: np.ndarray, window: int) -> tuple[np.ndarray, ...]:
        """Strings cut into the runs of windows that share their second least gram, filed under both."""
        sizes = end - begin - window + 1
        start, of = K.spread(begin, sizes), np.repeat(np.arange(len(begin)), sizes)
        most = np.iinfo(np.uint32).max
        best, place = np.full(len(start), most, np.uint32), np.full(len(start), -1)
        for d in range(window - GRAM + 1):
            at = start + d
            value = np.where(at == anchor[of], most, short[at])
            better = value < best
            best[better], place[better] = value[better], at[better]
        new = np.flatnonzero((np.diff(of, prepend=-1) != 0) | (np.diff(place, prepend=-2) != 0))
        last = np.append(new[1:], len(start)) - 1
        return start[new], start[last] + window, K.mix(hashes[of[new]] ^ K.mix(best[new].astype(np.uint64)))

    def lengths(self) -> np.ndarray:
        return (self.end - self.begin)[self.sample]


def _send(window: int, slots: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        m = Minimisers(table, window, slots)
        ids = m.docs.ids[m.doc_of(m.at)]
        low = np.full(len(m.sent.distinct), np.iinfo(np.int64).max)
        np.minimum.at(low, m.sent.place, ids)
        several = np.zeros(len(low), bool)
        several[m.sent.place[ids != low[m.sent.place]]] = True
        return m.sent.messages(key[0].as_py(), several)

    return run


def _repeated(hot_chunks: int):
    """Minimisers of several documents, or of one whose rows are in several chunks; and those of many chunks."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        got, slot = X.Received(table), key[0].as_py()
        _, place = np.unique(got.hashes, return_inverse=True)
        hits = (np.bincount(place, 1 + got.flags[0]) > 1)[place]
        return pa.concat_tables([got.answer(slot, hits), got.answer(slot, hits & (np.bincount(place) >= hot_chunks)[place], X.HOT)])

    return run


def _send_strings(window: int, slots: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if right.num_rows:
            m = Minimisers(left, window, slots)
            s = Strings(m, m.sent.flags(X.answers_of(right)), m.sent.flags(X.answers_of(right, X.HOT)), window, slots)
            for slot, at in s.parts:
                k = s.sample[at]
                text = m.docs.data[K.spread(s.begin[k], s.end[k] - s.begin[k])].tobytes()
                rows.append((slot, K.pack(key[0].as_py(), (s.end - s.begin)[k].astype(np.uint8), s.ids[k], text)))
        return K.packed_table(rows)

    return run


def _intervals(prefix: list[int], least: int) -> tuple[list[int], list[int], list[int]]:
    """Stack scan of neighbours' common prefixes: length, first and last of each interval of ``least`` at least."""
    length, low, high = [], [], []
    stack: list[tuple[int, int]] = []
    for k, x in enumerate(prefix):  # prefix[k]: of suffixes k - 1 and k
        begin = k - 1
        while stack and stack[-1][0] > x:
            n, begin = stack.pop()
            length.append(n)
            low.append(begin)
            high.append(k - 1)
        if x >= least and (not stack or stack[-1][0] < x):
            stack.append((x, begin))
    for n, begin in reversed(stack):
        length.append(n)
        low.append(begin)
        high.append(len(prefix) - 1)
    return length, low, high


def maximal_repeats(text: np.ndarray, lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of ``window`` bytes at least among distinct strings.

    text: one row of bytes a string, padded with zeros to 8 more than the longest's
    next multiple of 8.  Returns members: group, string, offset, and each group's length.
    """
    none = np.zeros(0, np.int64)
    m, stride = text.shape
    n_windows = lengths - window + 1
    string = np.repeat(np.arange(m), n_windows)
    offset = np.arange(len(string)) - np.repeat(np.cumsum(n_windows) - n_windows, n_windows)
    flat = np.concatenate([text.reshape(-1), np.zeros(stride, np.uint8)])
    view = np.lib.stride_tricks.sliding_window_view(flat, 8)
    columns = -(-int(lengths.max(initial=0)) // 8)

    def column(k: int, at: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Bytes 8k to 8k + 7 of suffixes as numbers; zeros after a string's end."""
        value = np.ascontiguousarray(view[np.minimum(at + 8 * k, len(view) - 1)]).view(">u8").reshape(-1).astype(np.uint64)
        over = np.clip(8 * k + 8 - size, 0, 8).astype(np.uint64) * np.uint64(8)
        return np.where(over >= 64, np.uint64(0), value >> np.minimum(over, np.uint64(63)) << np.minimum(over, np.uint64(63)))

    at, size = string * stride + offset, lengths[string] - offset
    group = np.zeros(len(at), np.int64)
    alive = np.arange(len(at))
    for k in range(window // 8):  # those whose first bytes nobody shares are in no repeat
        value = column(k, at[alive], size[alive])
        order = np.lexsort((value, group)) if k else np.argsort(value)
        g, value = group[order], value[order]
        new = np.ones(len(order), bool)
        new[1:] = (g[1:] != g[:-1]) | (value[1:] != value[:-1])
        heads = np.flatnonzero(new)
        sizes = np.diff(heads, append=len(order))
        keep = np.repeat(sizes > 1, sizes)
        group = (np.cumsum(new) - 1)[keep]
        alive = alive[order][keep]
        if not len(alive):
            return none, none, none, none
    later = [column(k, at[alive], size[alive]) for k in range(window // 8, columns)]
    order = np.lexsort((*later[::-1], group))
    alive, group = alive[order], group[order]
    later = [c[order] for c in later]
    common = np.full(len(alive), 8 * (window // 8))
    running = np.ones(len(alive), bool)
    running[0] = False
    running[1:] = group[1:] == group[:-1]
    common[~running] = 0
    for value in later:
        x = np.zeros(len(alive), np.uint64)
        x[1:] = value[1:] ^ value[:-1]
        lead = np.full(len(alive), 8)
        some = x > 0
        lead[some] = 7
        for byte in range(1, 8):
            lead -= x >= np.uint64(1 << 8 * byte)
        common[running] += lead[running]
        running &= ~some
    common[1:] = np.minimum(common[1:], np.minimum(size[alive][1:], size[alive][:-1]))
    length, low, high = (np.array(x, np.int64) for x in _intervals(common.tolist(), window))
    if not len(length):
        return none, none, none, none
    # Left-extension diversity: members that all follow the same byte are part of a longer repeat.
    byte = np.where(offset[alive] > 0, flat[np.maximum(at[alive] - 1, 0)].astype(np.int64), -1 - np.arange(len(alive)))
    changes = np.cumsum(np.concatenate([[0], byte[1:] != byte[:-1]]))
    diverse = changes[high] > changes[low]
    length, low, high = length[diverse], low[diverse], high[diverse]
    sizes = high - low + 1
    member = np.repeat(low, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    return np.repeat(np.arange(len(length)), sizes), string[alive][member], offset[alive][member], length


def _removals(window: int):
    """For each byte of each string, whether a smaller document than the string's holds a window over it."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        parts = [K.unpack(x) for x in table.column("payload").to_pylist()]
        sizes = np.concatenate([p[1] for p in parts]).astype(np.int64)
        ids = np.concatenate([p[2] for p in parts])
        flat = np.frombuffer(b"".join(p[3] for p in parts), np.uint8)
        begins = np.cumsum(sizes) - sizes
        stride = -(-int(sizes.max()) // 8) * 8 + 8
        text = np.zeros((len(sizes), stride), np.uint8)
        text[np.arange(stride) < sizes[:, None]] = flat
        column = pa.Array.from_buffers(pa.binary(stride), len(sizes), [None, pa.py_buffer(text)])
        same = column.dictionary_encode().indices.to_numpy().astype(np.int64)  # equal strings of several chunks
        sample = np.full(int(same.max()) + 1, -1)
        sample[same[::-1]] = np.arange(len(same))[::-1]
        owner = np.full(len(sample), np.iinfo(np.int64).max)
        np.minimum.at(owner, same, ids)
        edge = np.zeros(int(sizes.sum()) + 1, np.int32)
        # All occurrences of a whole string outside its smallest document.
        extra = np.flatnonzero(ids > owner[same])
        np.add.at(edge, begins[extra], 1)
        np.add.at(edge, begins[extra] + sizes[extra], -1)
        # In its smallest document, what a repeat group shares with a smaller one.
        group, string, offset, length = maximal_repeats(text[sample], sizes[sample], window)
        if len(group):
            smallest = np.full(len(length), np.iinfo(np.int64).max)
            np.minimum.at(smallest, group, owner[string])
            mine = smallest[group] < owner[string]
            group, string, offset = group[mine], string[mine], offset[mine]
            first = np.flatnonzero(ids == owner[same])
            first = first[np.argsort(same[first], kind="stable")]
            low = np.searchsorted(same[first], string)
            count = np.searchsorted(same[first], string, "right") - low
            at = begins[first[K.spread(low, count)]] + np.repeat(offset, count)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + np.repeat(length[group], count), -1)
        gone = np.cumsum(edge[:-1]) > 0
        rows, at = [], 0
        for p in parts:
            n = int(p[1].sum(dtype=np.int64))
            rows.append((p[0], K.pack(1, key[0].as_py(), K.bits(gone[at : at + n]))))
            at += n
        return K.packed_table(rows)

    return run


def _finish(window: int, slots: int):
    def run(key: tuple[pa.Scalar, ...], left: pa.Table, right: pa.Table) -> pa.Table:
        if right.num_rows:
            m = Minimisers(left, window, slots)
            docs, times = m.docs, m.times
            s = Strings(m, m.sent.flags(X.answers_of(right)), m.sent.flags(X.answers_of(right, X.HOT)), window, slots)
            sizes, answers = s.lengths(), X.answers_of(right, 1)
            base = np.cumsum(sizes) - sizes
            gone = np.zeros(int(sizes.sum()), bool)
            for slot, at in s.parts:
                where = K.spread(base[at], sizes[at])
                gone[where] = K.unbits(answers[slot], len(where))
            edge = np.zeros(len(docs.data) + 1, np.int32)
            later = s.ids > s.ids[s.sample[s.number]]
            np.add.at(edge, s.begin[later], 1)
            np.add.at(edge, s.end[later], -1)
            runs = np.diff(gone.astype(np.int8), prepend=0)
            runs[base] = gone[base]  # a string's run does not begin in the one before
            stops = np.diff(gone.astype(np.int8), append=0) < 0
            stops[np.append(base[1:], len(gone)) - 1] = gone[np.append(base[1:], len(gone)) - 1]
            starts, stops = np.flatnonzero(runs > 0), np.flatnonzero(stops) + 1
            of = np.searchsorted(base, starts, "right") - 1
            low = np.searchsorted(of, s.number[~later])
            count = np.searchsorted(of, s.number[~later], "right") - low
            which = K.spread(low, count)
            shift = np.repeat(s.begin[~later] - base[s.number[~later]], count)
            np.add.at(edge, starts[which] + shift, 1)
            np.add.at(edge, stops[which] + shift, -1)
            removed = np.cumsum(edge[:-1]) > 0
        else:
            docs, times = K.unpack_documents(left)
            removed = np.zeros(len(docs.data), bool)
        out: tuple[list, ...] = ([], [], [], [], [])
        for k in range(len(docs)):
            a, z = int(docs.offsets[k]), int(docs.offsets[k + 1])
            text, own, spans = docs.data[a:z], removed[a:z], []
            if own.any():
                spans = np.flatnonzero(np.diff(own, prepend=False, append=False)).tolist()
                text = text[~own]
            values = (None if docs.ids[k] == K.NULL_ID else int(docs.ids[k]), text.tobytes(), z - a, z - a - len(text), spans)
            for column, value in zip(out, values, strict=True):
                column.extend([value] * int(times[k]))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(out, _RESULT.types, strict=True)], schema=_RESULT)

    return run


def dedup_suffixes(docs: DataFrame, window: int = 50, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = X.CHUNK_BYTES, hot_chunks: int = HOT_CHUNKS) -> DataFrame:
    """Remove every byte of a ``window``-byte string that is also in a document with a smaller id.

    Returns per input row: doc_id, kept, n_bytes, n_removed, spans (removed byte
    ranges, as begin, end, begin, end ...).
    """
    if not GRAM < window <= 128:
        raise ValueError(f"window must be from {GRAM + 1} to 128 bytes")
    texts = X.select_texts(docs, id_col, text_col)
    n = X.parts_of(texts, chunk_bytes)
    packed = X.chunked(texts, n)
    repeated = packed.applyInArrow(_send(window, n), K.PACKED).groupBy("slot").applyInArrow(_repeated(hot_chunks), K.PACKED)
    strings = packed.cogroup(repeated.groupBy("slot")).applyInArrow(_send_strings(window, n), K.PACKED)
    removals = strings.groupBy("slot").applyInArrow(_removals(window), K.PACKED)
    return packed.cogroup(repeated.unionByName(removals).groupBy("slot")).applyInArrow(_finish(window, n), RESULT)

"""Language-model scores from a log-frequency Bloom filter.

Counts of words, word pairs and triples are quantised to a logarithmic scale; an n-gram
whose count has level j is in the filter once for each level up to j, so probing levels
until one is missing gives its count.  All n-grams of the training documents are in it,
those seen once at level one.

Chunks of documents send each slot their distinct n-grams with their counts; a slot adds
them up and builds its segment of the filter.  Whitespace bounds the number of n-grams
beforehand.  A filter that is certain to stay under ``max_filter_bytes`` is broadcast, and
chunks probe it as they are scored.  A larger one stays where it is built: a slot probes its
segment with the n-grams that the chunks sent, and the levels go back.  Either way each text
is gone over once to count and once to score, whatever the size of the corpus, and the
levels are the same.

A word's probability given the two before it is smoothed by hierarchical Dirichlet priors:
with ``b`` the add-half unigram estimate, ``p2 = (c(vw) + m2 * b) / (c(v) + m2)`` and
``p3 = (c(uvw) + m3 * p2) / (c(uv) + m3)``.  An n-gram's count is taken at its level's lower
end and its context's at the upper end, so that probabilities never sum to more than one
(but for the filter's false positives).  A text's score mixes, with equal weight for each of
``PRIORS``, the model with these ``m2`` and ``m3``, and the unigram model.  ``base_score`` and
``n_known`` come from the words' exact counts, which slots send back as well.

Cases: a null or empty text is its end token alone; without any training document
all estimates are one; rows with the same id are scored each; a null id counts as the
empty text for the split and comes back null; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import uuid
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import exchange as X
from corpusloom.llm import kernels as K
from corpusloom.runtime import materialise

END, BEGIN = np.uint64(0x5F3759DF12345677), np.uint64(0x2545F4914F6CDD1D)
#: Strength of the pair's and the triple's prior.
PRIORS = ((1.0, 0.5), (8.0, 4.0), (60.0, 30.0))
#: Each level's least count is so many times the last one's.
SCALE = 1.3
LEVEL_STARTS = np.unique(np.ceil(SCALE ** np.arange(150)))
PROBES, BITS_PER_KEY = 7, 10.1
MAX_FILTER_BYTES = 128 << 20
CHUNK_BYTES = 4 << 20
_SCORES = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORES = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
_TABLE = pa.schema([("kind", pa.int32()), ("slot", pa.int32()), ("payload", pa.binary()), ("n_tokens", pa.int64()), ("n_types", pa.int64())])
TABLE = "kind int, slot int, payload binary, n_tokens long, n_types long"


def folds(ids: np.ndarray, n: int) -> np.ndarray:
    return np.fromiter((zlib.crc32(b"" if i == K.NULL_ID else str(i).encode()) % n for i in ids.tolist()), np.int64, len(ids))


class Tokens:
    """A chunk's tokens: word hashes with each document's end, and its distinct words and n-grams."""

    def __init__(self, table: pa.Table, slots: int):
        docs, self.times = K.unpack_documents(table)
        low = docs.lowered()
        starts, ends, first = low.words()
        self.ids = docs.ids
        self.counts = np.diff(first) + 1
        words = np.insert(K.word_hashes(low.data, starts, ends), first[1:], END)
        self.ends = np.cumsum(self.counts)
        begins = self.ends - self.counts
        before, further = np.empty_like(words), np.empty_like(words)
        before[1:] = words[:-1]
        before[begins] = BEGIN
        further[1:] = before[:-1]
        further[begins] = END
        self.words, self.word = np.unique(words, return_inverse=True)
        self.word_parts = list(K.dealt((self.words % np.uint64(slots)).astype(np.int32)))
        # Contexts are n-grams themselves: a pair's is the word before, a triple's the pair before.
        pair, context = self.join(before, words), self.join(further, before)
        self.sent = X.Sent(np.concatenate([K.mix(words), K.mix(np.array([BEGIN])), pair, self.join(context, words)]), slots)
        n = len(words)
        place = self.sent.place
        one = np.full(n, place[n])
        one[1:] = place[: n - 1]
        one[begins] = place[n]
        two = np.full(n, -1)
        two[1:] = place[n + 1 : 2 * n]
        two[begins] = -1
        self.pair, self.triple, self.before_one, self.before_two = place[n + 1 : 2 * n + 1], place[2 * n + 1 :], one, two

    @staticmethod
    def join(first: np.ndarray, then: np.ndarray) -> np.ndarray:
        return K.mix(first * np.uint64(0xC2B2AE3D27D4EB4F) + then)

    def train_counts(self, fold: int, of: int) -> tuple[np.ndarray, np.ndarray]:
        """How often training documents hold each distinct word, and each distinct n-gram."""
        weight = np.where(folds(self.ids, of) != fold, self.times, 0)
        each = np.repeat(weight, self.counts)
        grams = np.concatenate([each, [weight.sum()], each, each])
        count = lambda place, w, n: np.bincount(place, w, n).astype(np.int64)
        return count(self.word, each, len(self.words)), count(self.sent.place, grams, len(self.sent.distinct))


def _count(fold: int, of: int, slots: int):
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        t = Tokens(table, slots)
        seen, times = t.train_counts(fold, of)
        words = dict(t.word_parts)
        short = (t.sent.distinct >> np.uint64(32)).astype(np.int64)
        none = np.zeros(0, np.int64)
        rows, grams = [], dict(t.sent.parts)
        for slot in sorted(words.keys() | grams.keys()):
            w, g = words.get(slot, none), grams.get(slot, none)
            rows.append((slot, K.pack(key[0].as_py(), t.words[w], K.narrow(seen[w]), K.steps(short[g]), K.narrow(times[g]))))
        return K.packed_table(rows)

    return run


def _levels(counts: np.ndarray) -> np.ndarray:
    return np.searchsorted(LEVEL_STARTS, counts, "right").astype(np.uint8)


def _bits(h: np.ndarray, level: int, probe: int, size: np.ndarray | int) -> np.ndarray:
    """Which bit of its segment an n-gram's level sets or reads."""
    x = K.mix(h + np.uint64(level * 0x9E3779B97F4A7C15 % (1 << 64)) + np.uint64(probe * 0xD6E8FEB86659FD93 % (1 << 64)))
    return ((x >> np.uint64(32)) * np.asarray(size).astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def segment(grams: np.ndarray, level: np.ndarray) -> np.ndarray:
    """The bits, packed, of a segment that holds n-grams at their levels."""
    size = 8 * max(1, int(np.ceil(int(level.sum(dtype=np.int64)) * BITS_PER_KEY / 8)))
    field = np.zeros(size, bool)
    for j in range(1, int(level.max(initial=0)) + 1):
        grams, level = grams[level >= j], level[level >= j]
        for probe in range(PROBES):
            field[_bits(grams, j, probe, size)] = True
    return np.packbits(field, bitorder="little")


def probed(field: np.ndarray, grams: np.ndarray) -> np.ndarray:
    """Each n-gram's level, by probing one level after the other until one is missing."""
    out = np.zeros(len(grams), np.uint8)
    alive, level = np.arange(len(grams)), 0
    while len(alive):
        level += 1
        for probe in range(PROBES):
            bit = _bits(grams[alive], level, probe, 8 * len(field))
            alive = alive[(field[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1]
        out[alive] = level
    return out


def _merge(resident: bool):
    """A slot's answers to its chunks, and its segment where that is to be broadcast."""

    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        slot = key[0].as_py()
        parts = [K.unpack(x) for x in table.column("payload").to_pylist()]
        distinct, place = np.unique(np.concatenate([p[1] for p in parts]), return_inverse=True)
        total = np.bincount(place, np.concatenate([p[2] for p in parts]), len(distinct)).astype(np.int64)
        grams, where = np.unique(np.concatenate([K.unsteps(p[3]) for p in parts]), return_inverse=True)
        level = _levels(np.bincount(where, np.concatenate([p[4] for p in parts]), len(grams)).astype(np.int64))
        field = segment(grams.view(np.uint64), level)
        found = probed(field, grams.view(np.uint64)) if resident else None
        rows, at, base = [], 0, 0
        for p in parts:
            own = [found[where[base : base + len(p[3])]]] if resident else []
            rows.append((0, p[0], K.pack(0, slot, K.narrow(total[place[at : at + len(p[1])]]), *own), 0, 0))
            at, base = at + len(p[1]), base + len(p[3])
        rows.append((1, slot, b"" if resident else field.tobytes(), int(total.sum()), int((total > 0).sum())))
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TABLE.types, strict=True)], schema=_TABLE)

    return run


def _segments(broadcast, label: str) -> dict[int, np.ndarray]:
    return K.held(label, lambda: {slot: np.frombuffer(field, np.uint8) for slot, field in broadcast.value.items()})


def _score(broadcast, label: str, slots: int, n_train: int, n_types: int, fold: int, of: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        t = Tokens(left, slots)
        answers = {p[1]: p[2:] for p in map(K.unpack, right.column("payload").to_pylist())}
        known = np.zeros(len(t.words), np.int64)
        for slot, at in t.word_parts:
            known[at] = answers[slot][0]
        level = np.zeros(len(t.sent.distinct), np.uint8)
        for slot, at in t.sent.parts:
            level[at] = answers[slot][1] if broadcast is None else probed(_segments(broadcast, label)[slot], t.sent.distinct[at] >> np.uint64(32))
        lower = np.concatenate([[0.0], LEVEL_STARTS])[level]
        upper = np.concatenate([[0.0], LEVEL_STARTS[1:] - 1, LEVEL_STARTS[-1:]])[level]
        base = ((known + 0.5) / (n_train + 0.5 * (n_types + 1)))[t.word]
        c1, c2 = upper[t.before_one], np.where(t.before_two < 0, 0.0, upper[t.before_two])
        n2, n3 = np.minimum(lower[t.pair], c1), np.minimum(lower[t.triple], c2)
        begins = t.ends - t.counts
        total = lambda x: np.add.reduceat(x, begins) if len(begins) else np.zeros(0)
        each = [total(np.log10(base))]
        for m2, m3 in PRIORS:
            two = (n2 + m2 * base) / (c1 + m2)
            each.append(total(np.log10((n3 + m3 * two) / (c2 + m3))))
        each = np.stack(each)
        top = each.max(axis=0)
        score = top + np.log10(np.mean(10.0 ** (each - top), axis=0))
        ids = pa.array([None if i == K.NULL_ID else i for i in t.ids.tolist()], pa.int64())
        columns = [ids, pa.array(folds(t.ids, of) == fold), pa.array(t.counts), pa.array(total((known > 0)[t.word].astype(np.int64)).astype(np.int64)), pa.array(np.full(len(t.ids), n_train)), pa.array(each[0]), pa.array(score)]
        scored = pa.Table.from_arrays(columns, schema=_SCORES)
        return scored.take(pa.array(np.repeat(np.arange(len(t.ids)), t.times)))

    return run


def filter_bound(texts: DataFrame) -> int:
    """Bytes that the filter of these texts can't pass: a key for each occurrence of an n-gram at most."""
    gaps = F.octet_length("text") - F.octet_length(F.translate("text", " \t\n\x0b\x0c\r", ""))
    tokens = texts.agg(F.sum(F.coalesce(gaps, F.lit(0)) + 2)).first()[0] or 0
    return int((3 * tokens + 1) * BITS_PER_KEY / 8) + 1


def score_texts(docs: DataFrame, fold: int = 1, of: int = 5, max_filter_bytes: int = MAX_FILTER_BYTES, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """log10 probabilities of all texts under a model of those outside the held-out fold.

    Held out: crc32 of the id as text, modulo ``of``, is ``fold``.  Returns per input
    row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.
    """
    texts = X.select_texts(docs, id_col, text_col)
    n = X.parts_of(texts, chunk_bytes)
    resident = filter_bound(texts) > max_filter_bytes
    packed = X.chunked(texts, n)
    counted = packed.applyInArrow(_count(fold, of, n), K.PACKED).groupBy("slot").applyInArrow(_merge(resident), TABLE)
    counted = materialise(counted, "counts")
    shards = counted.filter("kind = 1")
    n_train, n_types = shards.agg(F.coalesce(F.sum("n_tokens"), F.lit(0)), F.coalesce(F.sum("n_types"), F.lit(0))).first()
    filter_ = None
    if not resident:
        filter_ = docs.sparkSession.sparkContext.broadcast({r.slot: bytes(r.payload) for r in shards.select("slot", "payload").collect()})
    answers = counted.filter("kind = 0").select("slot", "payload").groupBy("slot")
    return packed.cogroup(answers).applyInArrow(_score(filter_, uuid.uuid4().hex, n, n_train, n_types, fold, of), SCORES)

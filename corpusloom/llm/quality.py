"""Quality classifier: supervised subword embeddings.

Words, word pairs and the 3- to 5-grams of characters within words (with the space on
either side as their border) are hashed to ``BUCKETS`` learned vectors; a document is
their mean, a softmax layer on it gives the label.  A pair is hashed by the difference of
its words' hashes, so pairs of equal words share one vector, whatever the word.  Training
is plain stochastic gradient descent in numpy on a bounded sample of labelled documents (the
``max_train`` with the least id hashes, whole texts).  Since the mean and the layer are
linear, a trained vector counts only by one number, and scoring is a table lookup for
each feature, one pass over the texts without any exchange.

Cases: a null or empty text has no features and gets the model's bias; labels that are
null or of unknown documents are left out; with no label, or one class only, the score
is the share of label 1 (0.5 without any); a null id falls in the held-out fold when
crc32 of the empty text does; an empty table gives an empty result; other columns pass
through ``keep_good`` and are otherwise ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.llm import exchange as X
from corpusloom.llm import kernels as K
from corpusloom.runtime import ship_package

BUCKETS = 1 << 17
DIMENSIONS = 8
GRAMS = (3, 4, 5)
THRESHOLD = 0.3


def _inside(edges: np.ndarray, width: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Of ``n`` runs of ``width`` values, the first of each document and the one after its last."""
    starts = np.minimum(edges[:-1], n)
    return starts, np.maximum(np.minimum(edges[1:] - width + 1, n), starts)


def _characters(docs: K.Docs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A number for each character, white space as 32, with a space before, between and after the documents;
    which are white space; and where each document's characters begin."""
    data = docs.data
    first = (data & 0xC0) != 0x80
    first[docs.offsets[:-1][np.diff(docs.offsets) > 0]] = True
    starts = np.flatnonzero(first)
    lengths = np.diff(starts, append=len(data))
    value = data[starts].astype(np.uint64)
    for k in range(1, 4):
        more = lengths > k
        value[more] |= data[starts[more] + k].astype(np.uint64) << np.uint64(8 * k)
    begins = np.searchsorted(starts, docs.offsets)
    space = np.insert(K.WHITE[data[starts]], begins, True)
    value = np.insert(value, begins, 32)
    value[space] = 32
    return value, space, begins + np.arange(len(begins)) + 1


def _features(docs: K.Docs) -> tuple[list[np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
    """For each kind of feature: its buckets, and where each document's own begin and end."""
    starts, ends, first = docs.words()
    words = K.word_hashes(docs.data, starts, ends)
    kinds, bounds = [words, words[1:] - words[:-1]], [_inside(first, 1, len(words)), _inside(first, 2, max(0, len(words) - 1))]
    value, space, begins = _characters(docs)
    rolling = K.Rolling(K.mix(value))
    spaces = np.concatenate([[0], np.cumsum(space)])
    for width in GRAMS:
        n = max(0, len(value) - width + 1)
        inner = spaces[width - 1 : n + width - 1] == spaces[1 : n + 1]  # no space but at the ends
        kinds.append(rolling.every(width)[inner])
        number = np.concatenate([[0], np.cumsum(inner)])
        # From the space before a document to the one after it.
        low = np.minimum(begins[:-1] - 1, n)
        bounds.append((number[low], number[np.clip(begins[1:] - width + 1, low, n)]))
    out = []
    for kind, h in enumerate(kinds):
        out.append((K.mix(h + np.uint64(kind + 1)) >> np.uint64(20)).astype(np.int64) % BUCKETS)
    return out, bounds


def _sums(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0.0], np.cumsum(values, dtype=np.float64)])
    return total[ends] - total[starts]


@dataclass
class Model:
    """What a trained model comes to: a number for each bucket, and a bias."""

    weights: np.ndarray
    bias: float

    def scores(self, docs: K.Docs) -> np.ndarray:
        """Each document's probability of label 1, whichever documents stand beside it."""
        total, count = np.zeros(len(docs)), np.zeros(len(docs))
        for buckets, (starts, ends) in zip(*_features(docs), strict=True):
            total += _sums(self.weights[buckets], starts, ends)
            count += ends - starts
        return 1 / (1 + np.exp(-np.clip(self.bias + total / np.maximum(count, 1), -500, 500)))


def single(docs: K.Docs):
    """The documents one by one."""
    for k in range(len(docs)):
        a, b = docs.offsets[k], docs.offsets[k + 1]
        yield K.Docs(docs.ids[k : k + 1], docs.data[a:b], np.array([0, b - a]))


def _sample(batches):
    K.clear()
    for docs in K.documents(batches):
        ids, payloads = [], []
        for one in single(docs):
            buckets, counts = np.unique(np.concatenate(_features(one)[0]), return_counts=True)
            ids.append(int(one.ids[0]))
            payloads.append(K.pack(buckets.astype(np.int32), K.narrow(counts)))
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(payloads, pa.binary())], names=["doc_id", "payload"])


def fit(examples: list[tuple[np.ndarray, np.ndarray, int]], epochs: int = 6, rate: float = 0.3, seed: int = 7) -> Model:
    """Stochastic gradient descent on (buckets, counts, label) examples.

    A document's step on its vectors is divided by the squared length of its feature
    weights, so that long texts learn as fast as short ones.
    """
    labels = np.array([e[2] for e in examples])
    share = float(labels.mean()) if len(labels) else 0.5
    if len(set(labels.tolist())) < 2:
        prior = min(max(share, 1e-6), 1 - 1e-6)
        return Model(np.zeros(BUCKETS, np.float32), float(np.log(prior / (1 - prior))))
    r = np.random.default_rng(seed)
    vectors = r.normal(0, 0.1, (BUCKETS, DIMENSIONS)).astype(np.float32)
    layer = r.normal(0, 0.5, (DIMENSIONS, 2)).astype(np.float32)
    bias = np.log(np.array([1 - share, share], np.float32))
    ready = []
    for buckets, counts, label in examples:
        if len(buckets):
            weight = (counts / counts.sum()).astype(np.float32)
            ready.append((buckets.astype(np.int64), weight, weight / (weight @ weight), label))
    steps, step = epochs * len(ready), 0
    for _ in range(epochs):
        for k in r.permutation(len(ready)):
            buckets, weight, pull, label = ready[k]
            now = np.float32(rate * (1 - step / steps))
            step += 1
            own = vectors[buckets]
            hidden = (own * weight[:, None]).sum(axis=0)  # a product this small is slower on several threads
            logits = hidden @ layer + bias
            p = np.exp(logits - logits.max())
            p /= p.sum()
            p[label] -= 1
            back = now * (layer @ p)
            layer -= now * np.outer(hidden, p)
            bias -= now * np.float32(0.1) * p
            vectors[buckets] = own - np.outer(pull, back)
    return Model((vectors @ (layer[:, 1] - layer[:, 0])).astype(np.float32), float(bias[1] - bias[0]))


def _split(of: int):
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % of


def train(docs: DataFrame, labels: DataFrame, fold: int = 0, of: int = 5, max_train: int = 3000, label_col: str = "quality") -> Model:
    """Fit on labelled documents outside the held-out fold, ``max_train`` at most."""
    ship_package(docs.sparkSession)
    wanted = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label_col).cast("int").alias("label"))
    wanted = wanted.filter(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & (_split(of) != fold))
    wanted = wanted.groupBy("doc_id").agg(F.min("label").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_train)
    chosen = {r.doc_id: r.label for r in wanted.collect()}  # max_train rows at most
    sample = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    ids = docs.sparkSession.createDataFrame([(i,) for i in chosen], "doc_id long")
    found = sample.join(F.broadcast(ids), "doc_id").mapInArrow(_sample, "doc_id long, payload binary").collect()
    return fit([(*K.unpack(bytes(r.payload)), chosen[r.doc_id]) for r in sorted(found, key=lambda r: (r.doc_id, bytes(r.payload)))])


SCORES = "doc_id long, held_out boolean, score double, predicted int"


def _score(broadcast):
    def run(batches):
        K.clear()
        for docs in K.documents(batches, 1 << 20):
            score = broadcast.value.scores(docs)
            ids = pa.array([None if i == K.NULL_ID else i for i in docs.ids.tolist()], pa.int64())
            yield pa.RecordBatch.from_arrays([ids, pa.array(score)], names=["doc_id", "score"])

    return run


def score_quality(docs: DataFrame, labels: DataFrame, fold: int = 0, of: int = 5, threshold: float = THRESHOLD, max_train: int = 3000) -> DataFrame:
    """Per document: doc_id, held_out, score (0 to 1), predicted."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, fold, of, max_train))
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    scored = texts.mapInArrow(_score(model), "doc_id long, score double")
    return scored.select("doc_id", (_split(of) == fold).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, max_train: int = 3000) -> DataFrame:
    """The documents, all columns, whose score reaches the threshold."""
    model = docs.sparkSession.sparkContext.broadcast(train(docs, labels, max_train=max_train))
    id_at, text_at = docs.columns.index("doc_id"), docs.columns.index("text")

    def run(batches):
        K.clear()
        for batch in batches:
            parts = [model.value.scores(p) for p in K.pieces(K.from_arrow(batch.column(id_at).cast(pa.int64()), batch.column(text_at)), 1 << 20)]
            yield batch.filter(pa.array(np.concatenate([np.zeros(0), *parts]) >= threshold))

    return X.map_rows(docs, run)

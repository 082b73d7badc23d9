"""Language-model scores against exact counts."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusloom.llm import exchange as X
from corpusloom.llm import ngram_lm as L

SCHEMA = "doc_id long, text string, score string, slot int"


def tokens(text):
    return "".join(c.lower() if c.isascii() else c for c in text or "").encode().split() + [None]


def corpus():
    r = random.Random(1)
    vocabulary = ["w%d" % k for k in range(200)] + ["É%d" % k for k in range(20)]
    texts = [None, "", "  \n", "unseen words Only"]
    for _ in range(150):
        seq, w = [], r.choice(vocabulary)
        for _ in range(r.randint(1, 80)):
            seq.append(w.upper() if r.random() < 0.1 else w)
            w = vocabulary[(vocabulary.index(w) * 7 + r.choice([1, 1, 1, 2, 5])) % len(vocabulary)]
        texts.append(" ".join(seq))
    return [(k, t, "x", 0) for k, t in enumerate(texts)] + [(7, texts[7], None, None), (None, "w1 w2", "", 3)]


fold = lambda i: zlib.crc32(b"" if i is None else str(i).encode()) % 5


def scores_expected(rows):
    """The model by its formula, with counts in place of probes."""
    one, two, three = Counter(), Counter(), Counter()
    for i, t, *_ in rows:
        if fold(i) != 1:
            w = tokens(t)
            one.update(w)
            two.update(zip([0, *w], w))
            three.update(zip([1, 0, *w], [0, *w], w))
    contexts = Counter(one) + Counter({0: sum(fold(r[0]) != 1 for r in rows)})
    n, v = sum(one.values()), len(one)
    starts = L.LEVEL_STARTS.tolist()
    low = lambda c: max([0, *(s for s in starts if s <= c)])
    high = lambda c: min(s for s in starts if s > c) - 1 if c else 0
    out = []
    for i, t, *_ in rows:
        w = tokens(t)
        b = [(one[x] + 0.5) / (n + 0.5 * (v + 1)) for x in w]
        logs = [sum(map(math.log10, b))]
        for m2, m3 in L.PRIORS:
            total = 0
            for x, y, z, p in zip([1, 0, *w], [0, *w], w, b):
                p2 = (min(low(two[y, z]), high(contexts[y])) + m2 * p) / (high(contexts[y]) + m2)
                c = high(two[x, y]) if x != 1 else 0
                total += math.log10((min(low(three[x, y, z]), c) + m3 * p2) / (c + m3))
            logs.append(total)
        top = max(logs)
        out.append((-1 if i is None else i, fold(i) == 1, len(w), sum(one[x] > 0 for x in w), n, logs[0], top + math.log10(sum(10 ** (x - top) for x in logs) / len(logs))))
    return sorted(out)


@pytest.mark.parametrize("limit", [128 << 20, 0])
@pytest.mark.parametrize("chunk_bytes", [1 << 20, 3000])
def test_scores(spark, limit, chunk_bytes):
    """Broadcast or resident, in one chunk or many: exact counts, and scores but for the filter's false positives."""
    rows = corpus()
    got = L.score_texts(spark.createDataFrame(rows, SCHEMA), max_filter_bytes=limit, chunk_bytes=chunk_bytes).collect()
    got = sorted((-1 if r.doc_id is None else r.doc_id, *r[1:]) for r in got)
    off = []
    for g, e in zip(got, scores_expected(rows), strict=True):
        assert g[:5] == e[:5] and g[5] == pytest.approx(e[5], abs=1e-8)
        off.append(g[6] - e[6])
    assert abs(np.median(off)) < 0.01 and np.mean(np.abs(off)) < 0.3
    assert np.mean([g[6] - g[5] for g in got if g[1]]) > 0


def test_edges(spark):
    assert L.score_texts(spark.createDataFrame([], SCHEMA)).collect() == []
    rows = [(k, "a b " * 50_000 if k == 3 else "the same", "", 0) for k in range(40)] + [(5, "the same", "", 0)] * 30
    got = sorted((r.doc_id, *r[1:6]) for r in L.score_texts(spark.createDataFrame(rows, SCHEMA), chunk_bytes=2000).collect())
    assert [g[:5] for g in got] == [e[:5] for e in scores_expected(rows)]


def test_probabilities_add_up():
    """Of all words after any two, the model's probabilities sum to one at most."""
    r = random.Random(3)
    text = [r.choice("abcdef") for _ in range(400)]
    three, two, one = Counter(zip(text, text[1:], text[2:])), Counter(zip(text, text[1:])), Counter(text)
    low = lambda c: float(L.LEVEL_STARTS[L._levels(np.array([c]))[0] - 1]) if c else 0.0
    high = lambda c: float(L.LEVEL_STARTS[L._levels(np.array([c]))[0]] - 1) if c else 0.0
    base = {x: (one[x] + 0.5) / (400 + 0.5 * 7) for x in "abcdefz"}
    for m2, m3 in L.PRIORS:
        for u in "abcdefz":
            for v in "abcdefz":
                p2 = {x: (min(low(two[v, x]), high(one[v])) + m2 * base[x]) / (high(one[v]) + m2) for x in base}
                c = high(two[u, v])
                assert sum((min(low(three[u, v, x]), c) + m3 * p2[x]) / (c + m3) for x in base) <= 1 + 1e-9


def test_pairs_seen_once(spark):
    """A held-out text whose pairs were each seen once scores above its words in another order."""
    held = [k for k in range(100) if zlib.crc32(str(k).encode()) % 5 == 1][:2]
    trained = next(k for k in range(100) if k not in held and zlib.crc32(str(k).encode()) % 5 != 1)
    words = ["w%d" % k for k in range(60)]
    mixed = words[::-1]
    rows = [(trained, " ".join(words), "", 0), (held[0], " ".join(words), "", 0), (held[1], " ".join(mixed), "", 0)]
    got = {r.doc_id: r for r in L.score_texts(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got[held[0]].base_score == pytest.approx(got[held[1]].base_score)
    assert got[held[0]].score > got[held[1]].score + 30


def test_filter_levels():
    from corpusloom.llm import kernels as K

    grams = K.mix(np.arange(3000, dtype=np.uint64))
    level = L._levels(np.arange(3000) % 40)
    found = L.probed(L.segment(grams[level > 0], level[level > 0]), grams)
    assert (found >= level).all() and (found > level).mean() < 0.03


def test_segments_decide(spark):
    """Scores rise above the words' own, and the bound on the filter holds."""
    rows = corpus()
    docs = spark.createDataFrame(rows, SCHEMA)
    whole = {(r.doc_id, r.base_score): r.score for r in L.score_texts(docs).collect()}
    assert sum(s > b for (_, b), s in whole.items()) > 0.8 * len(whole)
    assert L.filter_bound(X.select_texts(docs, "doc_id", "text")) >= 3 * sum(len(tokens(r[1])) for r in rows) * L.BITS_PER_KEY / 8

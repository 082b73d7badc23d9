"""SimHash fingerprints and components against brute force."""

import random

import xxhash

from corpusloom.llm.components import connected_components
from corpusloom.llm.simhash import simhash_duplicates

SCHEMA = "doc_id long, text string, bits long, component_id string"


def fingerprint(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[k : k + 4]) for k in range(max(1, len(words) - 3))]
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def expected(rows):
    prints = [fingerprint(t) for _, t, *_ in rows]
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    distinct = sorted(set(prints))
    for k, a in enumerate(distinct):
        for b in distinct[:k]:
            if (a ^ b).bit_count() <= 4:
                label[root(a)] = root(b)
    least = {}
    for (i, *_), p in zip(rows, prints):
        least[root(p)] = min(least.get(root(p), 1 << 60), i)
    return sorted((i, f"{p:016x}", least[root(p)]) for (i, *_), p in zip(rows, prints))


def test_simhash(spark):
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefÉZ") for _ in range(r.randint(1, 6)))
    texts = [None, "", " ", "one", "one two three", "One Two THREE four", "a b c d " * 50]
    for _ in range(12):
        words = [word() for _ in range(r.randint(60, 250))]
        for _ in range(r.randint(1, 9)):
            texts.append(" ".join(words))
            words = list(words)
            words[r.randrange(len(words))] = word()
    ids = r.sample(range(1000), len(texts))
    rows = [(i, t, 1, "x") for i, t in zip(ids, texts)]
    rows.append(rows[9])
    got = simhash_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(map(tuple, got)) == expected(rows)
    assert simhash_duplicates(spark.createDataFrame([], SCHEMA)).collect() == []
    only = simhash_duplicates(spark.createDataFrame([(None, "a b", 1, "")], SCHEMA)).collect()[0]
    assert only.doc_id is None and only.component_id is None


def test_large_group(spark):
    """Beyond the group size that is compared by offset, the search must reach all."""
    from corpusloom.llm import simhash as S

    old, S.SMALL_GROUP = S.SMALL_GROUP, 2
    try:
        import numpy as np
        import pyarrow as pa

        from corpusloom.llm import kernels as K

        bits = np.array([0, 3, 15, 63, 255, 1 << 40, (1 << 40) + 7, 1 << 50], np.uint64)
        owner = np.arange(8)
        table = pa.table({"payload": [K.pack(np.full(8, v, np.uint8), bits, owner) for v in range(63, 41, -1)]})
        edges = S._links(4)(table).to_pydict()
        assert set(zip(edges["a"], edges["b"])) == {(k, 0) for k in range(1, 8)}
    finally:
        S.SMALL_GROUP = old


def test_components(spark):
    chain = [(k, k + 1) for k in range(100, 160)] + [(5, 900), (900, 7), (3, 3), (20, 21)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(chain, "a long, b long")).collect()}
    assert got == {**{k: 100 for k in range(100, 161)}, 5: 5, 900: 5, 7: 5, 20: 20, 21: 20}

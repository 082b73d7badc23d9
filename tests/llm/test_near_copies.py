"""The pipeline's near-duplicate stage against brute-force Jaccard groups."""

import random

import corpus_pipeline
from corpusloom.llm import near_copies as N

SCHEMA = "doc_id long, text string, source string"


def shingles(text):
    words = "".join(c.lower() if c.isascii() else c for c in text or "").encode().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def groups(rows):
    sets = [shingles(t) for _, t, *_ in rows]
    label = list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    for k, a in enumerate(sets):
        for j in range(k):
            common = len(a & sets[j])
            if a == sets[j] or 9 * common >= 4 * (len(a) + len(sets[j])) and common:
                label[root(k)] = root(j)
    return [root(k) for k in range(len(rows))]


def corpus(n=14, seed=8):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    shared = " ".join(word() for _ in range(40))
    texts = [None, "", " ", "one", "One", "one two three four", "one two three four five six"]
    for _ in range(n):
        words = [word() for _ in range(r.choice([6, 12, 40, 90, 300]))]
        for _ in range(r.randint(1, 7)):
            texts.append(" ".join(words))
            changed = list(words)
            for _ in range(r.randint(1, max(1, len(words) // 40))):
                changed[r.randrange(len(words))] = word()
            texts.append(" ".join(changed) + (" " + shared if r.random() < 0.2 else ""))
            words = changed if r.random() < 0.5 else words
    return list(zip(r.sample(range(1000), len(texts)), texts, ["s"] * len(texts)))


def test_groups_of_jaccard(spark):
    rows = corpus()
    least = {}
    label = groups(rows)
    for (i, *_), g in zip(rows, label):
        least[g] = min(least.get(g, 1 << 60), i)
    assert 5 < len(least) < len(rows) - 20
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.columns == docs.columns and sorted(r.doc_id for r in got.collect()) == sorted(least.values())
    assert corpus_pipeline.near_duplicates(spark, docs.limit(0), "").collect() == []


def test_rows_that_share_an_id(spark):
    """Only copies of another row's text go, whatever the ids; the least row of a group stays."""
    r = random.Random(4)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    texts = [" ".join(word() for _ in range(50)) for _ in range(9)]
    near = lambda t: t + " " + word()
    rows = [(1, texts[0]), (1, texts[1]), (1, texts[2]), (None, texts[3]), (None, texts[4]), (None, texts[5]), (6, near(texts[3])), (7, near(texts[4])), (8, texts[6]), (8, near(texts[6])), (1, texts[7]), (9, texts[7]), (1, texts[0])]
    source = ["s"] * 12 + ["r"]
    for parts in (1, 5):
        docs = spark.createDataFrame([(i, t, x) for (i, t), x in zip(rows, source)], SCHEMA).repartition(parts)
        got = corpus_pipeline.near_duplicates(spark, docs, "").collect()
        kept = [(x.doc_id, x.text) for x in got]
        assert [x.source for x in got if x.text == texts[0]] == ["r"]
        eight = [x for x in kept if x[0] == 8]
        assert len(eight) == 1 and eight[0] in rows
        assert sorted(map(str, set(kept) - set(eight))) == sorted(map(str, {*rows[:6], rows[10]})) and len(kept) == 8
        assert parts == 1 or eight == before
        before = eight


def test_sides_agree():
    """The search gives the same groups whether it counts by elements or by open sets."""
    import numpy as np

    r = random.Random(2)
    base = [r.sample(range(60), 25) for _ in range(5)]
    sets = [frozenset(x for x in r.choice(base) if r.random() < 0.95) for _ in range(80)]
    sizes = np.array([len(s) for s in sets])
    owner = np.repeat(np.arange(len(sets)), sizes)
    got = N.similar_groups(sizes, owner, np.array([x for s in sets for x in s], np.uint64)).tolist()
    label = list(range(len(sets)))
    for _ in sets:
        for k, a in enumerate(sets):
            for j, b in enumerate(sets):
                if 9 * len(a & b) >= 4 * (len(a) + len(b)):
                    label[k] = label[j] = min(label[k], label[j])
    assert got == label


def test_fingerprints_of_sets():
    """Bits set in over half of a set's hashes, however many hashes are laid open at once."""
    import numpy as np

    from corpusloom.llm import simhash as S

    r = np.random.default_rng(3)
    counts = np.array([0, 1, 2, 5, 0, 700, 3])
    hashes = r.integers(0, 1 << 63, counts.sum(), np.uint64) * np.uint64(2) + np.uint64(1)
    parts = np.split(hashes, np.cumsum(counts)[:-1])
    expected = [sum(1 << b for b in range(64) if 2 * sum(int(h) >> b & 1 for h in part) > len(part)) for part in parts]
    before = S.HASHES_AT_ONCE
    try:
        for S.HASHES_AT_ONCE in (1, 6, before):
            assert S.majorities(hashes, counts).tolist() == expected
    finally:
        S.HASHES_AT_ONCE = before


def test_fingerprints_find_copies(spark, monkeypatch):
    """SimHash alone links texts that differ in little; with or without its reach, and with false candidates, the groups are those of Jaccard."""
    rows = corpus()
    label = groups(rows)
    docs = spark.createDataFrame(rows, SCHEMA).repartition(3)

    def classes(**options):
        found = {}
        for x in N.near_copies(docs, **options).collect():
            found.setdefault(x.component, set()).add(x.doc_id)
        return sorted(map(sorted, found.values()))

    whole = classes()
    expected = {}
    for (i, *_), g in zip(rows, label):
        expected.setdefault(g, []).append(i)
    assert whole == sorted(map(sorted, expected.values()))
    assert classes(distance=0) == whole == classes(distance=40)
    monkeypatch.setattr(N, "_probes", lambda slots: lambda batches: iter(()))
    alone = classes(distance=10)
    pairs = lambda found: {(a, b) for c in found for a in c for b in c if a < b}
    copies = pairs(classes(distance=0))
    assert copies < pairs(alone) <= pairs(whole) and 2 * len(pairs(alone) - copies) > len(pairs(whole) - copies)

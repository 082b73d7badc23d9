"""Token files, classifier, top-k, decontamination, mixing and the pipeline."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from corpusloom.llm import mixing, quality, token_output
from corpusloom.llm.decontamination import contaminated, remove_contaminated, tiles
from corpusloom.llm.queries import TOKENIZER, op4_quality_classifier
from corpusloom.llm.topk import top_inner_products

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def texts(n=60, seed=2):
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefghéñ") for _ in range(r.randint(1, 8)))
    return [" ".join(word() + r.choice(["", "", ",", ".\n"]) for _ in range(r.randint(1, 90))) for _ in range(n)]


def test_token_files(spark):
    from tokenizers import Tokenizer

    odd = [None, "", " ", "a  b\n\n c", "it's we'll\t\tgo  ", "emoji 😀 中文 text", "x<|endoftext|>y", "¼ ²  é\xa0\xa0z", "word " * 3000]
    rows = [(k * 3, t, "en", "s", 0) for k, t in enumerate(texts() + odd)] + [(None, "null id", "", "", 0), (3, "again", "", "", 1), (3, "again", "", "", 1)]
    random.Random(1).shuffle(rows)
    manifest = token_output.write_tokens(spark.createDataFrame(rows, DOCS), TOKENIZER, length=128)
    got = sorted(map(tuple, token_output.read_documents(manifest).collect()), key=lambda x: x[1])
    t = Tokenizer.from_file(TOKENIZER)
    at, expected = 0, []
    for i, text, *_ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        expected.append((i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    assert got == expected
    first = sorted(manifest.collect())[0]
    shard = token_output.Shard(first.path + ".arrow")
    ids, mask = shard.sequence(len(shard) - 1)
    assert len(ids) == len(mask) == 128 and sum(mask.to_pylist()) == (first.n_tokens - 1) % 128 + 1
    assert shard.tokens(100, 300).tolist() == np.concatenate([shard.sequence(k)[0] for k in range(4)])[100:400].tolist()
    empty = spark.createDataFrame([], DOCS)
    assert token_output.read_documents(token_output.write_tokens(empty, TOKENIZER)).collect() == []


def test_quality(spark):
    sf = "/root/testdata/sf0.1"
    got = {r.doc_id: r for r in op4_quality_classifier(spark, sf).collect()}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    assert len(got) == spark.read.parquet(f"{sf}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in got.items())
    held = [(got[i].predicted, q) for i, q in labels.items() if got[i].held_out]
    assert len(held) > 500 and np.mean([a == b for a, b in held]) > 0.97
    assert np.mean([a for a, b in held if b == 1]) > 0.98


def test_latin1_pieces():
    """The written-out pattern cuts Latin-1 texts as the vocabulary's own does."""
    import regex

    r, own, new = random.Random(1), regex.compile(token_output.WORDS).findall, token_output._latin1_pieces().findall
    for _ in range(5000):
        t = "".join(chr(r.randrange(256)) if r.random() < 0.5 else r.choice(" 'sta1\n.é") for _ in range(r.randint(0, 30)))
        assert own(t) == new(t)


def test_quality_neighbours():
    """A text's score is the same alone and among others."""
    from corpusloom.llm import kernels as K

    r = np.random.default_rng(3)
    bodies = [t.encode() for t in ["", "a", "ab cd", "x" * 7, "", "one two two three", " ", "é", *texts(20, 4)]]
    at = np.cumsum([0, *map(len, bodies)])
    docs = K.Docs(np.arange(len(bodies)), np.frombuffer(b"".join(bodies), np.uint8), at)
    model = quality.Model(r.normal(0, 1, quality.BUCKETS).astype(np.float32), 0.2)
    alone = np.concatenate([model.scores(one) for one in quality.single(docs)])
    assert np.allclose(model.scores(docs), alone, atol=1e-9) and alone[0] == alone[4] == pytest.approx(1 / (1 + np.exp(-0.2)))


def test_quality_edges(spark):
    rows = [(1, None, "", "", 0), (2, "", "", "", 0), (None, "abc", "", "", 0), (4, "z" * 100_000, "", "", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    none = spark.createDataFrame([(9, 1), (None, 0), (1, None)], "doc_id long, quality int")
    assert {r.score for r in quality.score_quality(docs, none).collect()} == {0.5}
    assert quality.keep_good(docs, none).count() == 4
    assert quality.score_quality(spark.createDataFrame([], DOCS), none).collect() == []


@pytest.mark.parametrize("block", [16_384, 3])
def test_topk(spark, block, monkeypatch):
    monkeypatch.setattr("corpusloom.llm.topk.BLOCK_QUERIES", block)
    r = np.random.default_rng(4)
    rows = [(k, [float(x) for x in r.normal(0, 0.2, 6)], k % 7) for k in range(300)]
    rows += [(300, rows[50][1], 0), (301, None, 0), (302, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0), (303, [float("nan")] * 6, 0), (350, [1.0, 2.0], 0), (304, [0.5, 0.25], 1), (None, [0.1] * 6, 1)]
    got = top_inner_products(spark.createDataFrame(rows, "vec_id long, embedding array<double>, score int"), F.col("vec_id") % 50 == 0).collect()
    whole = {k: np.floor(256 * np.array(v)) for k, v, _ in rows if k is not None and v is not None and None not in v and np.isfinite(v).all()}
    expected = []
    for q in (k for k in whole if k % 50 == 0):
        best = sorted((-int(whole[q] @ v), k) for k, v in whole.items() if k != q and len(v) == len(whole[q]))[:5]
        expected += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert sorted(map(tuple, got)) == sorted(expected)


def test_topk_edges(spark):
    """No rows, vectors of zeros, fewer candidates than k, sums past 2**53, columns of the same names."""
    schema = "vec_id long, embedding array<double>, score int, cell string"
    assert top_inner_products(spark.createDataFrame([], schema), F.col("vec_id") % 50 == 0).collect() == []
    zeros = [(k, [0.0, 0.0], 1, "x") for k in (0, 1, 50)]
    got = top_inner_products(spark.createDataFrame(zeros, schema), F.col("vec_id") % 50 == 0).collect()
    assert sorted(map(tuple, got)) == [(0, 1, 1, 0), (0, 2, 50, 0), (50, 1, 0, 0), (50, 2, 1, 0)]
    large = [(k, [float(10**6 + k), float(3 * 10**5 - k * k)], 0, "") for k in range(60)]
    got = sorted(map(tuple, top_inner_products(spark.createDataFrame(large, schema), F.col("vec_id") % 50 == 0, scale=2.0**8).collect()))
    whole = {k: [int(256 * x) for x in v] for k, v, *_ in large}
    expected = []
    for q in (0, 50):
        best = sorted((-sum(x * y for x, y in zip(whole[q], v)), k) for k, v in whole.items() if k != q)[:5]
        expected += [(q, n + 1, k, -s) for n, (s, k) in enumerate(best)]
    assert got == expected
    with pytest.raises(Exception, match="64 bits"):
        top_inner_products(spark.createDataFrame([(k, [1e9, 1e9], 0, "") for k in range(3)], schema), F.col("vec_id") % 50 == 0).collect()


def test_topk_eliminates():
    """Candidates in clumps: the carried score and the stored distances leave most pairs unevaluated."""
    from corpusloom.llm import topk

    r = np.random.default_rng(2)
    centres = r.normal(0, 300, (20, 8))
    vectors = np.floor(np.repeat(centres, 100, axis=0) + r.normal(0, 5, (2000, 8)))
    ids = np.arange(2000)
    pivots = topk.far_apart(vectors[::50], topk.PIVOTS)
    queries = topk.Queries(ids[::50], vectors[::50], pivots, (ids[::7], vectors[::7]), 5)
    best, table, evaluated = topk.Best(40, 5), topk._distance(vectors, pivots).astype(np.float32), 0
    for a in range(0, 2000, 400):
        evaluated += queries.scan(best, ids[a : a + 400], vectors[a : a + 400], table[a : a + 400])
    for q in range(40):
        value = vectors @ vectors[50 * q]
        order = [k for k in np.lexsort((ids, -value)) if k != 50 * q][:5]
        assert best.ids[q].tolist() == order
    assert evaluated < 0.3 * 40 * 2000


def brute_tiles(doc, item, least):
    free_d, free_i, out = [True] * len(doc), [True] * len(item), []
    while True:
        best = (0, 0, 0)
        for i in range(len(item)):
            for d in range(len(doc)):
                n = 0
                while d + n < len(doc) and i + n < len(item) and doc[d + n] == item[i + n] and free_d[d + n] and free_i[i + n]:
                    n += 1
                if n >= least and n > best[2]:
                    best = (d, i, n)
        if not best[2]:
            return out
        out.append(best)
        for k in range(best[2]):
            free_d[best[0] + k] = free_i[best[1] + k] = False


def test_tiles():
    r = random.Random(0)
    for _ in range(60):
        item = [r.randint(0, 6) for _ in range(30)]
        doc = [r.randint(0, 6) for _ in range(20)] + item[15:] + [r.randint(0, 6)] + item[:15]
        assert tiles(np.array(doc), np.array(item), 3) == brute_tiles(doc, item, 3)
    for doc, item in (([1] * 90 + [2] + [1] * 40, [1] * 50), ([1, 2] * 40, [2, 1] * 9), ([1, 2], [1, 2, 3, 4]), ([], [1, 2, 3])):
        assert tiles(np.array(doc, np.int64), np.array(item), 3) == brute_tiles(doc, item, 3)


def test_tiles_of_repetitive_text():
    """Places are never paired: a long run of one word against another takes no time."""
    assert tiles(np.ones(300_000, np.int64), np.ones(5000, np.int64), 5) == [(0, 0, 5000)]


@pytest.mark.parametrize("block_bytes", [1 << 20, 300])
def test_decontamination_by_brute_force(spark, block_bytes):
    """The query's pairs and columns against tiling every document with every item."""
    import re

    words = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    r = random.Random(12)
    pool = ["alpha", "beta", "Gamma", "délta", "x", "y1"]
    items = [" ".join(r.choice(pool) for _ in range(r.choice([1, 2, 3, 4, 5, 6, 9, 14, 20]))) for _ in range(30)] + [None, "", "?!"]
    bodies = [" ".join(r.choice(pool) + r.choice(["", ",", ". -"]) for _ in range(r.randint(0, 40))) for _ in range(40)]
    bodies += [f"{items[k]} zz {items[k + 1]}" for k in range(20)] + [None, "", bodies[0], "alpha " * 2000]
    ids = [None, *range(1, len(bodies) - 1), 1]
    expected = []
    for i, t in zip(ids, bodies):
        for k, item in enumerate(items):
            w, it = words(t), words(item)
            found = brute_tiles(w, it, min(5, len(it))) if it else []
            n = sum(x[2] for x in found)
            if n and n >= 0.8 * len(it) and (len(it) >= 5 or n == len(it)):
                expected.append((-1 if i is None else i, k, round(n / len(it), 9), len(found), n, len(it)))
    docs = spark.createDataFrame([(i, t, "", "", 0) for i, t in zip(ids, bodies)], DOCS)
    bench = spark.createDataFrame([(k, t, 0.5) for k, t in enumerate(items)], "item_id long, text string, coverage double")
    got = contaminated(docs, bench, block_bytes=block_bytes).collect()
    assert sorted((-1 if x.doc_id is None else x.doc_id, x.item_id, round(x.coverage, 9), x.n_tiles, x.matched_words, x.item_words) for x in got) == sorted(expected)


@pytest.mark.parametrize("block_bytes", [1 << 20, 400])
def test_decontamination(spark, block_bytes):
    plain = texts(30, 5)
    items = [" ".join(t.split()[:40]) for t in texts(12, 9) if len(t.split()) >= 40]
    half = lambda t: (t.split()[: len(t.split()) // 2], t.split()[len(t.split()) // 2 :])
    moved = [" ".join([*half(t)[1], "between", *half(t)[0]]) for t in items]
    docs = [(k, t, "", "", 0) for k, t in enumerate(plain)]
    docs += [(100 + k, plain[k] + " " + t.upper() + " end", "", "", 0) for k, t in enumerate(items)]
    docs += [(200 + k, t + ". " + plain[k], "", "", 0) for k, t in enumerate(moved)]
    docs += [(300 + k, " ".join(t.split()[:25]), "", "", 0) for k, t in enumerate(items)] + [(None, items[0], "", "", 0), (400, None, "", "", 0)]
    bench = [(k, t, 1) for k, t in enumerate(items)] + [(50, None, 1), (51, "too short", 1), (52, "", 1)]
    docs, bench = spark.createDataFrame(docs, DOCS), spark.createDataFrame(bench, "item_id long, text string, doc_id long")
    got = {(r.doc_id, r.item_id) for r in contaminated(docs, bench, block_bytes=block_bytes).collect()}
    assert got == {(100 + k, k) for k in range(len(items))} | {(200 + k, k) for k in range(len(items))} | {(None, 0)}
    kept = remove_contaminated(docs, bench, block_bytes=block_bytes)
    assert kept.count() == docs.count() - len(got) and kept.columns == docs.columns
    assert contaminated(docs, bench.limit(0)).collect() == [] and remove_contaminated(docs, bench.limit(0)).count() == docs.count()


def reachable(counts, taken):
    sums = {sum(n * c for n, c in taken.items())}
    for n, c in counts.items():
        sums = {s + n * k for s in sums for k in range(c - taken[n] + 1)}
    return sums


def test_fit_budget():
    r = random.Random(8)
    for _ in range(100):
        counts = {r.randint(1, 40): r.randint(1, 6) for _ in range(r.randint(1, 8))}
        budget = r.randint(0, sum(n * c for n, c in counts.items()))
        taken = mixing.fit_budget(dict(counts), budget)
        share = mixing.even_share(counts, max(0, budget - 2 * max(counts)))
        assert all(0 <= share[n] <= taken[n] <= counts[n] or budget == sum(n * c for n, c in counts.items()) for n in counts)
        assert sum(n * c for n, c in taken.items()) == max(s for s in reachable(counts, share) if s <= budget)


def test_fit_budget_at_every_size():
    """The mix of lengths is the same for few documents and for many, and the budget is met."""
    r = random.Random(3)
    lengths = [r.randint(1, 3000) for _ in range(400)]
    for scale in (1, 50, 5000):
        counts = {n: scale * r.randint(1, 9) for n in lengths}
        total = sum(n * c for n, c in counts.items())
        budget = total * 37 // 100
        taken = mixing.fit_budget(dict(counts), budget)
        assert sum(n * c for n, c in taken.items()) == budget
        if scale > 1:
            off = [abs(taken[n] / c - 0.37) for n, c in counts.items()]
            assert np.mean(off) < 0.02


def test_mixing_takes_seeded_documents(spark):
    """Which rows are taken, against the fit and the hash order; columns of any name."""
    rows = [(k, "w " * (1 + k % 7 * 3), "a" if k % 3 else "b", k, k, "u") for k in range(400)]
    names = ["doc_id", "text", "source", "salt", "extra", "draw"]
    docs = spark.createDataFrame(rows, names)
    got = mixing.mix_sources(docs).withColumn("h", F.xxhash64(F.lit(11), "doc_id", "text")).collect()
    assert got[0].__fields__[:9] == [*names, "size", "source_size", "target"]
    assert {(r.doc_id, r.salt, r.extra, r.draw) for r in got} == {(k, k, k, "u") for k in range(400)}
    for source in "ab":
        own = [r for r in got if r.source == source]
        size, goal = own[0].source_size, own[0].target
        times = int(goal // size)
        counts = {}
        for r in own:
            counts[r["size"]] = counts.get(r["size"], 0) + 1
        fit = mixing.fit_budget(dict(counts), int(goal - times * size))
        for n in counts:
            ranked = sorted((r for r in own if r["size"] == n), key=lambda r: ((r.h % (1 << 64)) >> 40) % mixing.SALTS << 64 | r.h + (1 << 63))
            assert [r.copies - times for r in ranked] == [1] * fit.get(n, 0) + [0] * (len(ranked) - fit.get(n, 0))
    clash = docs.withColumn("size", F.lit("mine")).withColumn("c0", F.lit(5)).withColumn("source_key", F.lit(6))
    again = mixing.mix_sources(clash).collect()
    assert {r.c0 for r in again} == {5} and {r.source_key for r in again} == {6} and sorted(r["size"] for r in again) == sorted(r["size"] for r in got)


def test_mixing_same_id(spark):
    """Rows of one id and one length but other texts are told apart, so reruns agree."""
    docs = spark.createDataFrame([(5, f"a{k} b c", "en", "s", 0) for k in range(200)] + [(5, "x", "en", "t", 0)], DOCS)
    one = sorted((r.text, r.copies) for r in mixing.mix_sources(docs).collect())
    assert one == sorted((r.text, r.copies) for r in mixing.mix_sources(docs.repartition(7)).collect())


def test_mixing(spark):
    r = random.Random(6)
    rows = [(k, " ".join("w" for _ in range(r.choice([0, 1, 5, 5, 5, 30, 200]))), "en", r.choice(["a", "b", "é", "z", None]), 0) for k in range(600)]
    rows += [(1000 + k, "x y z", "", "b", 0) for k in range(300)] + [(7, "one two", "", "a", 0)] * 2 + [(None, None, None, None, None), (2000, "", "", "empty", 0)]
    docs = spark.createDataFrame(rows, DOCS)
    got = mixing.mix_sources(docs).collect()
    assert len(got) == len(rows)
    sizes = {}
    for r_ in got:
        assert r_["size"] == len((r_.text or "").split()) and r_.taken in (0, r_["size"], 2 * r_["size"])
        sizes[r_.source] = sizes.get(r_.source, 0) + r_["size"]
    goal = mixing.targets(sizes)
    assert sum(goal.values()) == pytest.approx(1.5 * sum(sizes.values()))
    for s, size in sizes.items():
        own = [x for x in got if x.source == s]
        assert {(x.source_size, x.target) for x in own} == {(size, goal[s])}
        assert abs(sum(x.taken for x in own) - goal[s]) <= 5
    again = mixing.mix_sources(docs.repartition(3)).collect()
    key = lambda x: (str(x.doc_id), x.taken)
    assert sorted(map(key, got)) == sorted(map(key, again))
    assert mixing.mix_sources(spark.createDataFrame([], DOCS)).collect() == []


def test_pipeline(spark):
    """Every stage's decisions against its operator's own results."""
    from test_near_copies import groups

    from corpusloom.llm.decontamination import contaminated as pairs

    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels, bench = spark.read.parquet(f"{sf}/labels.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet")
    ids = lambda df: {r.doc_id for r in df.select("doc_id").collect()}
    stages = [f for _, f in corpus_pipeline.STAGES]
    good = stages[0](spark, docs, sf).cache()
    assert ids(good) == ids(quality.score_quality(docs, labels).filter("predicted = 1")) and good.columns == docs.columns
    single = stages[1](spark, good, sf).cache()
    rows = sorted((r.doc_id, r.text) for r in good.collect())
    least = {}
    for (i, _), g in zip(rows, groups(rows)):
        least.setdefault(g, i)
    assert ids(single) == set(least.values()) and single.count() == len(least) < len(rows)
    clean = stages[2](spark, single, sf).cache()
    assert ids(clean) == ids(single) - ids(pairs(single, bench))
    mixed = stages[3](spark, clean, sf).cache()
    assert sorted(r.doc_id for r in mixed.collect()) == sorted(r.doc_id for r in mixing.mix_sources(clean).collect() for _ in range(r.copies))
    assert corpus_pipeline.run(spark, sf).count() == mixed.count() > 0


def test_pipeline_edges(spark):
    """Nulls, equal rows, rows of one id, columns of any name and empty tables, stage by stage."""
    long = " ".join(f"w{k} x{k * 7 % 31}" for k in range(4000))
    rows = [(None, None, None, 1, "a"), (None, None, "s", 1, "b"), (1, "", None, 2, "c"), (2, long, "s", 3, "d"), (2, long, "s", 3, "d"), (2, "a b c d e f g", "t", 4, "e"), (3, long + " end", "s", 5, "f")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, key long, `co.py` string")
    for name in ("row", "hash", "component", "size", "copies", "salt"):
        docs = docs.withColumn(name, F.lit(name))
    sf = "/root/testdata/sf0.001"
    stages = dict(corpus_pipeline.STAGES)
    known = lambda df: {(r.doc_id, r.text, r.key, r["co.py"]) for r in df.collect()}
    for name in list(stages)[:4]:
        out = stages[name](spark, docs, sf)
        assert out.columns == docs.columns and stages[name](spark, docs.limit(0), sf).collect() == []
        assert all(r[c] == c for r in out.collect() for c in ("row", "hash", "component", "size", "copies", "salt"))
    single = known(stages["near-duplicate removal"](spark, docs, sf))
    assert single == {(None, None, 1, "a"), (2, long, 3, "d"), (2, "a b c d e f g", 4, "e")}
    assert {r[0] for r in known(stages["source mixing"](spark, docs, sf))} <= {2, 3}
    assert stages["token output"](spark, docs, sf).count() == len(rows) and stages["token output"](spark, docs.limit(0), sf).count() == 0

"""Claims, citations, overlap measures, papers, the rate limiter and streaming ingest."""

import difflib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import answers as A
from corpusloom.operators.evaluation import multiset_f1
from corpusloom.functions import papers as P
from corpusloom.operators import verification
from corpusloom.streaming import ingest, limiter


def one(spark, c):
    return spark.range(1).select(c.alias("v")).first().v


def test_claims(spark):
    text = "# Head\n**Bold only**\n- **Label:** The delay fell by a lot [1]. See Smith et al. (2020) in Fig. 2 here.\nThe papers report this:\nToo short.\nSources:\n- This is never read at all."
    assert one(spark, A.claims(F.lit(text))) == ["The delay fell by a lot.", "See Smith et al. (2020) in Fig. 2 here."]
    assert one(spark, A.claims(F.lit(None).cast("string"))) == [] and one(spark, A.content_words(F.lit("The GPT-2 of it, and x."))) == ["gpt-2", "x."]


def test_verification(spark):
    answers = spark.createDataFrame([("a", "Cats eat fish every day. Dogs fly over the moon."), ("b", "No."), ("c", "Cats eat fish every day.")], "answer_id string, answer string")
    sources = spark.createDataFrame([("a", 1, "Cats eat fish every day. "), ("a", 0, "Cats sleep."), ("b", 0, "x")], "answer_id string, source_index int, text string")
    got = verification.verify_claims(answers, sources)
    rows = {(r.answer_id, r.claim_no): (r.supported, r.source_index, round(r.entailment, 3)) for r in got.collect()}
    assert rows == {("a", 0): (True, 1, 1.0), ("a", 1): (False, 0, 0.0), ("c", 0): (False, None, 0.0)}
    assert {r.answer_id: (r.num_claims, r.num_unsupported, r.faithfulness) for r in verification.faithfulness(answers, got).collect()} == {"a": (2, 1, 0.5), "b": (0, 0, None), "c": (1, 1, 0.0)}


def test_citations(spark):
    sources = F.array(F.struct(F.array(F.lit("Aicha Saadi"), F.lit("N. Abghour")).alias("authors"), F.lit("2025").alias("year")))
    strip = lambda t: tuple(one(spark, A.strip_citations(F.lit(t), sources)))
    assert strip("It holds (Saadi et al., 2025, methodology).") == ("It holds (Saadi et al., 2025, methodology).", 0)
    assert strip("According to Smith (2019), it works (a CNN).") == ("It works (a CNN).", 1)
    assert strip("One (Saadi, 2024) , two. Abghour and Li (2025) agree (X, n.d.).") == ("One, two. Abghour and Li (2025) agree.", 2)
    authors = F.array(F.lit("Jacob Devlin"), F.lit("Li"), F.lit("K Lee"), F.lit("T O"))
    assert one(spark, A.inline_citation(authors, F.lit(2018), F.lit("results"), F.lit("9"))) == "(Devlin et al., 2018, Results, p.9)"
    assert one(spark, A.reference_entry(F.lit(1), F.lit("BERT"), authors, F.lit(None).cast("int"), F.lit(""), F.lit(None).cast("string"))) == "[1] Devlin, J., Li, Lee, K., et al. (n.d.). BERT."
    assert one(spark, A.bibtex_key(authors, F.lit(0), F.lit("The Art"))) == "devlinndart" and one(spark, A.bibtex_key(F.array().cast("array<string>"), F.lit(3), F.lit("of"))) == "unknown3paper"


def test_overlaps(spark):
    r = random.Random(1)
    for _ in range(40):
        a, b = ([r.choice("abc") for _ in range(r.randint(0, 12))] for _ in range(2))
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert A.common_subsequence(a, b) == table[-1][-1]
        assert A.common_run(a, b) == difflib.SequenceMatcher(None, a, b, autojunk=False).find_longest_match(0, len(a), 0, len(b)).size
    words = lambda t: F.split(F.lit(t), " ")
    assert tuple(one(spark, A.coverage(words("a b c d e f"), words("x b c d e")))) == (pytest.approx(4 / 6), pytest.approx(4 / 5))
    a, g = (A.rouge_tokens(F.col(c)) for c in ("a", "g"))
    pairs = spark.createDataFrame([(1, "the cat sat", "the cat ran off"), (2, "", None), (3, "x x x", "x x")], "k int, a string, g string")
    scored = {r.k: tuple(r)[1:] for r in multiset_f1(pairs, ["k"], one=(a, g), two=(A.ngrams(a, 2), A.ngrams(g, 2))).collect()}
    assert scored == {1: (pytest.approx(4 / 7), pytest.approx(2 / 5)), 2: (0.0, 0.0), 3: (pytest.approx(4 / 5), pytest.approx(2 / 3))}
    assert one(spark, A.rouge_l(A.rouge_tokens(F.lit("the cat sat")), A.rouge_tokens(F.lit("the cat ran off")))) == pytest.approx(4 / 7)
    assert one(spark, A.clean_answer(F.lit('<think>a\nb</think>"Answer: Unanswerable here"'))) == "Unanswerable" and one(spark, A.clean_answer(F.lit(None).cast("string"))) == ""


def brute_limit(times, limit, length):
    start, count, out = None, 0, []
    for t in times:
        if start is None or t - start >= length:
            start, count = t, 0
        out.append(count < limit)
        count += out[-1]
    return out


def test_limiter(spark, tmp_path):
    r = random.Random(2)
    rows = [(k, t) for k in "abc" for t in (r.randint(0, 500) for _ in range(200 if k == "a" else 20))] + [(None, 1), ("d", None)]
    requests = spark.createDataFrame(rows, "key string, ts long")
    times = {k: sorted(t for x, t in rows if x == k) for k in "abc"}
    expected = [(k, t, ok) for k in "abc" for t, ok in zip(times[k], brute_limit(times[k], 15, 60), strict=True)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert sorted(map(tuple, limiter.rate_limit(requests).collect())) == sorted(expected)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    start, count, pieces = None, 0, []
    for part in np.array_split(np.array([t for k, t, _ in expected if k == "a"]), 9):
        allowed, start, count = limiter.admit(part, start, count, 15, 60)
        pieces += allowed.tolist()
    assert pieces == [ok for k, _, ok in expected if k == "a"]
    requests.write.parquet(str(tmp_path / "in"))
    stream = limiter.rate_limit_stream(spark.readStream.schema("key string, ts long").parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("limited").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination(120)
    got = spark.table("limited").collect()
    assert len(got) == len(expected) and {r.key for r in got} == set("abc")


def test_ingest(spark, tmp_path):
    (tmp_path / "in").mkdir()
    run = lambda: ingest.ingest(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "c")).awaitTermination(120)
    for k in range(2):
        (tmp_path / "in" / f"{k}.txt").write_text(f"# Part {k}\nsome words")
        run()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_papers(spark):
    def told(text):
        return P.with_structure(spark.createDataFrame([(text,)], "text string")).first().s

    text = "RESEARCH\nOpen Access\nA Very Long Title About\nGraph Walks\nAda B. Lovelace1*, Jan van der Berg2 and O'Neil Smith3\n1 LIS Labs, Hassan University\n\nAbstract\nwe did"
    got = told(text)
    assert got.title == "A Very Long Title About Graph Walks"
    assert got.authors == ["Ada B. Lovelace", "Jan van der Berg", "O'Neil Smith"]
    assert told("# A Title of Some Length\n\nJane Doe\n\n## Abstract").authors == []
    assert told("# A Title of Some Length\n\nJane Doe\njd@x.org\n\n## Abstract").authors == ["Jane Doe"]
    text = "# Neural Model Walks\n\n## 3.1 Results\n$x$ ![f](y)\n\n# Thanks\n|a|b|"
    got = told(text).sections
    assert [tuple(s)[2:] for s in got] == [(1, "Neural Model Walks", "other", False, False, False), (2, "Results", "results", True, False, True), (1, "Thanks", "other", False, True, False)]
    assert [(s.start, s.end) for s in got] == [(0, 22), (22, 50), (50, len(text))]
    lone = "Introduction\nx\n\n3.2 Reward design\nx\n\nTable 2\n\nIntroduction\n\nA sentence."
    assert [(s.start, s.title, s.kind) for s in told(lone).sections] == [(0, "Introduction", "introduction"), (16, "Reward design", "other")]
    assert tuple(told("")) == tuple(told(None)) == (None, [], [])
    short = "Two Words\n\nA Longer Heading That Counts\n\nfoo@bar.org"
    assert told(short).title == "A Longer Heading That Counts" and told("Word One\nhttp://x.y").title is None


def test_stems(spark):
    """The examples of the publication."""
    from corpusloom.functions.stems import measure, stem, stems

    assert [measure(w) for w in ("tree", "by", "trouble", "oats", "ivy", "troubles", "private", "oaten")] == [0, 0, 1, 1, 1, 2, 2, 2]
    told = "caresses caress ponies poni caress caress cats cat feed feed agreed agre plastered plaster bled bled motoring motor sing sing conflated conflat troubled troubl sized size hopping hop tanned tan falling fall hissing hiss fizzed fizz failing fail filing file happy happi sky sky relational relat conditional condit rational ration valenci valenc digitizer digit radicalli radic vietnamization vietnam operator oper feudalism feudal decisiveness decis hopefulness hope formaliti formal sensitiviti sensit triplicate triplic formative form electriciti electr goodness good revival reviv allowance allow inference infer airliner airlin adjustable adjust irritant irrit replacement replac adoption adopt homologou homolog effective effect bowdlerize bowdler probate probat rate rate cease ceas controll control roll roll".split()
    assert [stem(w) for w in told[::2]] == told[1::2]
    assert one(spark, stems(F.array(F.lit("cats"), F.lit("was"), F.lit("running")))) == ["cat", "was", "run"]


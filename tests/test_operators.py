"""Operators on small tables with values worked out by hand."""

import pytest
from pyspark.sql import functions as F

from corpusloom.functions import text as X
from corpusloom.operators import evaluation, retrieval, store
from corpusloom.operators.chunking import chunk_document, sections, split_long
from corpusloom.operators.filters import apply_filters, delete_by_filter, scoped
from corpusloom.sources.files import discover, read_texts


def test_filters(spark):
    rows = [("a", 2020, ["x", "y"]), ("b", 2022, ["y"]), ("c", None, None)]
    df = spark.createDataFrame(rows, "chunk_id string, year int, authors array<string>")
    ids = lambda f: "".join(sorted(r.chunk_id for r in apply_filters(df, f).collect()))
    assert ids(None) == ids({}) == ids({"year": []}) == ids({"year": {"$like": 3}}) == "abc"
    assert ids({"year": 2020}) == "a" and ids({"authors": "y"}) == "ab" and ids({"authors": ["x", "z"]}) == "a"
    assert ids({"year": {"$gte": 2020, "$lt": 2022}}) == "a" and ids({"nowhere": 1}) == ""
    assert [r.chunk_id for r in delete_by_filter(df, {"year": {"$gte": 2021}}).orderBy("chunk_id").collect()] == ["a", "c"]
    with pytest.raises(ValueError):
        delete_by_filter(df, {})
    own = {"year": 1}
    assert scoped(own, "u") == {"year": 1, "user_id": "u"} and own == {"year": 1} and scoped(None, None) is None


def test_bm25_floor_and_ties(spark):
    docs = spark.createDataFrame([(1, "common apple"), (2, "common pear"), (3, "common pear"), (4, "common")], "chunk_id int, text string")
    idf = {r.term: r.idf for r in retrieval.idf(docs).collect()}
    import math

    raw = {"common": math.log(0.5) - math.log(4.5), "apple": math.log(3.5) - math.log(1.5), "pear": 0.0}
    assert idf["common"] == pytest.approx(0.25 * sum(raw.values()) / 3)
    asked = spark.createDataFrame([(1, "APPLE apple")], "query_id int, text string")
    assert [(r.chunk_id, r["rank"]) for r in retrieval.bm25(asked, docs).collect()] == [(1, 1)]


def test_fusion(spark):
    hits = lambda rows: spark.createDataFrame(rows, "query_id int, chunk_id string, score double, rank int")
    v = hits([(1, "a", 0.9, 1), (1, "b", 0.8, 2), (2, "q", 0.4, 1)])
    b = hits([(1, "b", 7.0, 1), (1, "c", 6.0, 2), (3, "r", 5.0, 1)])
    got = {(r.query_id, r.chunk_id): (r.score, r["rank"]) for r in retrieval.fuse(v, b).collect()}
    assert got[1, "b"] == (pytest.approx(0.7 / 62 + 0.3 / 61), 1)
    assert got[1, "a"] == (pytest.approx(0.7 / 61), 2) and got[1, "c"] == (pytest.approx(0.3 / 62), 3)
    assert got[2, "q"] == (0.4, 1) and got[3, "r"] == (5.0, 1)


def test_metrics(spark):
    hits = spark.createDataFrame([(1, c, k + 1) for k, c in enumerate("axby")], "query_id int, chunk_id string, rank int")
    truth = spark.createDataFrame([(1, "a"), (1, "b"), (2, "z")], "query_id int, chunk_id string")
    got = {r.query_id: r for r in evaluation.ranking_metrics(hits, truth, (3, 5)).collect()}
    assert got[1].rr == 1 and got[1].ap == pytest.approx(5 / 6) and got[1].precision3 == pytest.approx(2 / 3) and got[1].precision5 == 0.4
    assert got[1].ndcg3 == pytest.approx(1.5 / (1 + 1 / 1.584962500721156)) and got[2].rr == got[2].ndcg5 == 0


def test_bootstrap_and_gate(spark):
    scores = spark.createDataFrame([("c", k, 0.0, 1.0) for k in range(20)] + [("same", k, 0.5, 0.5) for k in range(20)], "comparison string, query_id int, a double, b double")
    got = {r.comparison: r for r in evaluation.paired_bootstrap(scores, 500).collect()}
    assert got["c"].significant and got["c"].ci_low == 1 and got["same"].p_value == 1 and not got["same"].significant
    kv = lambda d: spark.createDataFrame(list(d.items()), "key string, value double")
    ok = {r.key: r.ok for r in evaluation.gate(kv({"a": 0.49, "b": 0.4, "claims.supported_flagged": 0.3}), kv({"a": 0.5, "b": 0.5, "claims.supported_flagged": 0.2, "gone": 1.0})).collect()}
    assert ok == {"a": True, "b": False, "claims.supported_flagged": False, "gone": False}


def test_chunks():
    text = "intro\n# A\none\n```\n# not a heading\n```\n### B\ntwo | three\n# C\nend"
    assert [(s["path"], s["code"], s["tables"]) for s in sections(text)] == [("", False, False), ("A", True, False), ("A > B", False, True), ("C", False, False)]
    words = lambda n: " ".join(["w"] * n)
    merged = chunk_document(f"# A\n{words(150)}\n# B\n{words(150)}\n# C\n{words(10)}")
    assert [c["n"] for c in merged[:1]] == [300] and merged[0]["merged"] and len(merged) == 2 and merged[1]["overlap"]
    assert [p.count("w") for p in split_long(". ".join([words(60)] * 3) + ".", 130)] == [120, 60]
    assert chunk_document("") == [] and len(chunk_document(words(900))) == 1


def test_context(spark):
    rows = [(1, k, "user", "m%d" % k) for k in range(9)] + [(2, 0, "assistant", "x" * 600)]
    got = {r.conv_id: r.context for r in store.context(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string")).collect()}
    assert got[1].split("\n") == ["User: m%d" % k for k in range(3, 9)] and got[2] == "Assistant: " + "x" * 500 + "..."


def test_text_functions(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(X.clean_whitespace(F.lit("      a   b \t\n\tc"))) == "    a b\n c"
    assert one(X.clean_unicode(F.lit("“a”…​– b"))) == '"a"...- b'
    assert one(X.squad_normal(F.lit("The  Cat, a dog!"))) == "cat dog"
    assert one(X.source_windows(F.array(*[F.lit(str(k)) for k in range(7)]))) == ["0 1 2 3", "2 3 4 5", "4 5 6"]
    assert one(X.citation_author(F.array(F.lit("Ann Lee"), F.lit("Bo Ray"), F.lit("C D")))) == "Lee et al."


def test_sources(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_bytes("grün".encode())
    (tmp_path / "b.md").write_bytes(b"caf\xe9")
    (tmp_path / "c.exe").write_bytes(b"x")
    found = discover(spark, str(tmp_path)).collect()
    assert [(r.extension, r.error is None) for r in found] == [("md", True), ("exe", False), ("txt", True)]
    assert sorted(r.text for r in read_texts(spark, str(tmp_path)).collect()) == ["café", "grün"]


def test_chunks_by_a_tokenizer(spark):
    """Another counter changes where texts are cut."""
    import public_tokenizers

    from corpusloom.operators.chunking import TokenizerCounter, chunk_documents, count_tokens

    text = "\n\n".join("Unbelievably antidisestablishmentarian paragraphs. " * 12 for _ in range(12))
    docs = spark.createDataFrame([("d", text), ("e", None)], "document_id string, text string")
    count = TokenizerCounter(str(public_tokenizers.path("byte_bpe_50k.json")))
    plain, own = chunk_documents(docs).collect(), chunk_documents(docs, count=count).collect()
    assert len(own) > len(plain) and all(r.token_count <= 900 for r in own) and count("a b c") == 3 and count_tokens("a b c") == 3

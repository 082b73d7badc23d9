"""Retrieval pipeline, grounding, evaluation runs and answers on small tables with known values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from corpusloom.functions import expansion as W
from corpusloom.operators import benchmark as M
from corpusloom.operators import evaluation as E
from corpusloom.operators import generation as G
from corpusloom.operators import grounding, pipeline as P
from corpusloom.operators import retrieval as R

CHUNKS = "chunk_id string, document_id string, text string, embedding array<double>, year int, authors array<string>, section_type string"


def chunks(spark):
    rows = [("a", "d1", "graph walks find paths", [1.0, 0.0], 2020, ["Ada"], "results"), ("b", "d1", "paths in a graph", [0.8, 0.6], 2021, ["Bob", "Ada"], None), ("c", "d2", "cooking with graph paper", [0.0, 1.0], 2021, None, "methodology"), ("d", "d2", "nothing of note", None, None, [], None), ("e", "d3", None, [0.0, 0.0], 2021, [], None)]
    rows += [(f"x{k}", "d9", f"filler words number {k}", [-1.0, 0.1 * k], 1999, [], None) for k in range(9)]
    return spark.createDataFrame(rows, CHUNKS)


def questions(spark, *rows):
    return spark.createDataFrame(list(rows), "query_id int, text string, query array<double>")


def test_modes(spark):
    q = questions(spark, (1, "graph paths", [1.0, 0.0]), (2, "", [0.0, 0.0]))
    hits = lambda mode, **o: [(r.chunk_id, r.rank) for r in P.retrieve(q, chunks(spark), 3, P.Settings.of_mode(mode, **o)).orderBy("query_id", "rank").collect() if r.query_id == 1]
    assert hits("fast") == [("a", 1), ("b", 2), ("c", 3)] and hits("balanced")[:2] == [("a", 1), ("b", 2)]
    rows = P.retrieve(q, chunks(spark), 3, P.Settings.of_mode("accurate")).collect()
    assert {r.query_id for r in rows} == {1} and [r.stages for r in rows][0] == ["query_processing", "hybrid_search", "reranking"]
    best = min(rows, key=lambda r: r["rank"])
    assert best.chunk_id == "a" and best.rerank_score == best.score == 1.0 and best.fusion_score == pytest.approx(0.7 / 61 + 0.3 / 61, abs=1e-3)
    with pytest.raises(ValueError):
        P.Settings.of_mode("quick")
    assert P.Settings(candidates=None).depth(7) == 28 and P.Settings().depth(7) == 40 and P.Settings().depth(70) == 70


def test_inferred_filters_widen(spark):
    q = questions(spark, (1, "graph paths by Ada in 2021", [1.0, 0.0]))
    rows = P.retrieve(q, chunks(spark), 2, P.Settings.of_mode("balanced")).collect()
    assert [(r.chunk_id, r.widened) for r in sorted(rows, key=lambda r: r["rank"])] == [("b", False), ("a", True)]
    own = P.retrieve(q, chunks(spark), 5, P.Settings.of_mode("balanced"), {"year": 2021}).collect()
    assert {r.chunk_id for r in own} <= {"b", "c"} and not any(r.chunk_id == "a" for r in own)  # the caller's filter always holds
    told = P.process(q, P.Settings(), {"year": 2020}).first()
    assert told.inferred.year_eq is None and told.inferred.author == "Ada" and told.inferred.section_type is None


def test_embedder_and_scorer(spark):
    e = P.hashed_words(8)
    df = spark.createDataFrame([("one two",), ("  ",), (None,)], "text string").select(e.passages(F.col("text")).alias("p"), e.queries(F.col("text")).alias("q")).collect()
    assert np.linalg.norm(df[0].p) == pytest.approx(1, abs=1e-6) and df[1].p is None and df[2].q == [0.0] * 8
    seen = []

    def predict(pairs):
        seen.append(len(pairs))
        return [len(t) for _, t in pairs]

    import pandas as pd

    assert P.pair_scorer(predict, 2).func(pd.Series(["q"] * 3), pd.Series(["ccc", "a", None])).tolist() == [3, 1, 0] and seen == [2, 1]


def test_vector_search_edges(spark):
    q = questions(spark, (1, "", [1.0, 0.0]), (2, "", None), (3, "", [1.0, None]), (4, "", [1.0, 2.0, 3.0]), (5, "", [0.0, 0.0]))
    got = R.vector_search(q, chunks(spark), 2).collect()
    assert {(r.query_id, r.chunk_id) for r in got} == {(1, "a"), (1, "b")}
    assert R.vector_search(q.limit(0), chunks(spark)).collect() == [] and R.vector_search(q, chunks(spark).limit(0)).collect() == []
    far = R.vector_search(questions(spark, (1, "", [1.0, 0.0])), chunks(spark), 1, metric="euclidean").first()
    assert far.chunk_id == "a" and far.score == 0
    one = spark.range(1).select(R.similarity(F.array(F.lit(1.0), F.lit(0.5)), F.array(F.lit(1.0), F.lit(0.5))).alias("s"), R.similarity(F.array(F.lit(-1.0)), F.array(F.lit(1.0))).alias("z")).first()
    assert (one.s, one.z) == (1.0, 0.0)
    assert [r.chunk_id for r in R.search_document(questions(spark, (1, "", [1.0, 0.0])), chunks(spark), "d2").collect()] == ["c"]


def test_breaker():
    b = P.Breaker()

    def fail(e):
        raise e

    assert b.call(lambda x: x, 3) == 3 and b.call(fail, TimeoutError(), default=0) == 0 and b.open
    assert b.call(fail, PermissionError(), default="d") == "d" and not b.open and b.call(lambda: 1, default=2) == 2
    assert (b.attempted, b.succeeded) == (3, 1)


def test_wordings(spark):
    one = spark.createDataFrame([("Loss of a model",), ("nothing",)], "q string").select(W.academic_expansion(F.col("q")).alias("w")).collect()
    assert one[0].w == ["Loss of a model", "loss function of a model", "objective function of a model", "loss of a network"] and one[1].w == ["nothing"]
    reply = spark.createDataFrame([("1. 'What is it?'\n\n- same\n3) more", "same")], "r string, q string")
    assert reply.select(W.variations(F.col("r"), F.col("q")).alias("v")).first().v == ["What is it?", "more"]
    told = spark.createDataFrame([("Intent: Factual\nConfidence: 0.9\nStrategy: keyword",), ("no idea",), ("Confidence: high",)], "r string").select(W.intent(F.col("r")).alias("i"), W.rewritten(F.lit(' " "'), F.col("r")).alias("x")).collect()
    assert [tuple(r.i) for r in told] == [("factual", 0.9, "keyword"), ("conversational", 0.5, "hybrid"), ("conversational", 0.5, "hybrid")]


def test_grounding(spark):
    words = " ".join(f"w{k}" for k in range(60))
    parts = words.split()
    rows = [("p", "a", "A  “Quote” " + words), ("p", "b", " ".join(parts[:25])), ("p", "c", " ".join(parts[25:] + ["end"] * 90)), ("q", "d", words), ("r", "e", " ".join(parts[:20] + [f"y{k}" for k in range(90)]))]
    held = spark.createDataFrame(rows, "paper string, chunk_id string, text string")
    evidence = spark.createDataFrame([(1, "p", 'a "quote" w0'), (2, "q", words), (3, "r", words), (4, "p", ""), (5, "p", "unknown here"), (6, "p", words + " beyond")], "item_id int, paper string, text string")
    got = {(r.item_id, r.chunk_id, r.how) for r in grounding.ground(evidence, held, ["paper"]).collect()}
    assert got == {(1, "a", "contained"), (2, "d", "contained"), (3, "e", "best"), (6, "a", "covered"), (6, "b", "covered"), (6, "c", "covered")}
    passages = spark.createDataFrame([(1, "b c"), (2, "b c"), (3, ""), (4, "zz")], "item_id int, passage string")
    bodies = spark.createDataFrame([(7, "a b c d b c"), (8, None), (9, "")], "doc_id int, body string")
    assert sorted(map(tuple, grounding.containing(passages, bodies).collect())) == [(1, 7), (2, 7)]
    claims = spark.createDataFrame([("p", 1, ["x"]), ("p", 2, ["x", "y"]), ("p", 3, ["z"])], "paper_id string, question_id int, evidence array<string>")
    assert {(r.question_id, r.other_id) for r in grounding.other_evidence(claims).collect()} <= {(1, 3), (2, 3), (3, 1), (3, 2)}


def test_official_scores(spark):
    gold = spark.createDataFrame([("q1", 0, False, [], "a cat", None, ["p", "FLOAT SELECTED: T"]), ("q1", 1, False, ["dog", "cow"], "", None, ["r"]), ("q2", 0, True, [], "", None, ["x"]), ("q3", 0, False, [], "", False, ["x"])], "question_id string, place int, unanswerable boolean, extractive_spans array<string>, free_form_answer string, yes_no boolean, evidence array<string>")
    told = M.gold_answers(gold)
    assert {(r.question_id, r.answer, r.type, tuple(r.evidence)) for r in told.collect()} == {("q1", "a cat", "abstractive", ("p",)), ("q1", "dog, cow", "extractive", ("r",)), ("q2", "Unanswerable", "none", ()), ("q3", "No", "boolean", ("x",))}
    said = spark.createDataFrame([("q1", "the cat!", ["p"]), ("q2", "unanswerable", [])], "question_id string, answer string, evidence array<string>")
    scores = M.official_scores(told, said)
    assert {tuple(r) for r in scores.collect()} == {("q1", 1.0, 1.0, "abstractive", False), ("q2", 1.0, 1.0, "none", False), ("q3", 0.0, 0.0, None, True)}
    whole = M.official_summary(scores).first()
    assert (whole.n, whole.missing, whole.n_none, whole.n_boolean) == (3, 1, 1, 0) and whole.answer_f1 == pytest.approx(2 / 3)
    with pytest.raises(Exception, match="holds no answer"):
        M.gold_answers(spark.createDataFrame([("q", 0, False, [], "", None, [])], gold.schema)).collect()


def test_samples_and_summaries(spark):
    got = M.custom_samples(spark, [{"query": "q", "evidence": ["a"]}, {"query": "r", "answer": "x"}]).collect()
    assert [tuple(r) for r in got] == [(0, "q", "", ["a"], []), (1, "r", "x", [], [])]
    asked = spark.createDataFrame([("p1", "T", "q1", 0, "Q?", ["yes"], ["e"], False), ("p1", "T", "q2", 1, "R?", [], ["FLOAT SELECTED: x"], False), ("p2", "", "q3", 0, "S?", None, [], True)], "paper_id string, title string, question_id string, place int, question string, answers array<string>, evidence array<string>, is_unanswerable boolean")
    assert [(r.question_id, r.reference_answer, r.source_papers) for r in M.paper_samples(asked).collect()] == [("q1", "yes", ["T"]), ("q2", "", ["T"])]
    assert M.paper_samples(asked, False, 1).count() == 1
    assert [tuple(r) for r in M.eligible_papers(asked, 5).collect()] == [(0, "p1")]
    many = spark.createDataFrame([(f"p{k:02}", "q", ["e"], False) for k in range(30)], "paper_id string, question_id string, evidence array<string>, is_unanswerable boolean")
    import random

    drawn = [r.paper_id for r in M.eligible_papers(many, 4).orderBy("place").collect()]
    assert drawn == random.Random(M.SEED).sample([f"p{k:02}" for k in range(30)], 4)
    assert sorted(r.id for r in M.spread(spark.range(50).withColumn("place", F.col("id")), 50, 6).collect()) == sorted(random.Random(M.SEED).sample(range(50), 6))
    found = spark.createDataFrame([("q1", 0, "c1"), ("q1", 0, "c2")], "question_id string, place int, chunk_id string")
    s = M.corpus_summary(asked, found).first()
    assert (s.questions_seen, s.dropped_unanswerable, s.dropped_no_evidence, s.questions_kept, s.evidence_total, s.evidence_mapped, s.mean_relevant_chunks) == (3, 1, 1, 1, 1, 1, 2.0)
    f = M.faithfulness_summary(spark.createDataFrame([(2, 1, 0.5), (1, 0, 1.0), (0, 0, None)], "num_claims long, num_unsupported long, faithfulness double")).first()
    assert (f.answers_checked, f.answers_with_claims, f.mean_faithfulness, f.claims_verified, f.claim_level_faithfulness, f.answers_fully_verified) == (3, 2, 0.75, 2, 0.6667, 1)
    hits = spark.createDataFrame([(1, "a", 1)], "query_id int, chunk_id string, rank int")
    truth = spark.createDataFrame([(1, "a"), (2, "b")], "query_id int, chunk_id string")
    means = M.retrieval_means(E.ranking_metrics(hits, truth).select("query_id", "rr"), hits).first()
    assert (means.n_answered, means.n, means.rr_answered, means.rr_all) == (1, 2, 1.0, 0.5)
    with pytest.raises(Exception, match="different questions"):
        E.aligned(spark.createDataFrame([(1, 0.5)], "query_id int, a double"), spark.createDataFrame([(2, 0.5)], "query_id int, b double")).collect()
    assert [r.p for r in spark.createDataFrame([("x/ab12cd34_2001.00001.md",), ("p7.md",)], "f string").select(M.paper_of(F.col("f")).alias("p")).collect()] == ["2001.00001", "p7"]
    lat = E.latency_summary(spark.createDataFrame([("k", float(v)) for v in (1, 2, 3, 9, 9, 9)] + [("l", 4.0)], "key string, v double"), "key", "v").collect()
    assert {(r.key, r["mean"], r.median) for r in lat} == {("k", 5.5, 9.0), ("l", 4.0, 4.0)}


def test_evaluate(spark):
    samples = M.custom_samples(spark, [{"query": "how long are walks", "answer": "walks are short", "evidence": ["a"], "source_papers": ["Lovelace on walks"]}, {"query": "who", "evidence": ["b"]}, {"query": "none"}])
    hits = spark.createDataFrame([(0, "x", 1), (0, "a", 2)], "query_id long, chunk_id string, rank int")
    answers = spark.createDataFrame([(0, "Walks are long (Lovelace, 2020)"), (1, "")], "query_id long, answer string")
    got = {k: v.first() for k, v in M.evaluate(samples, hits, answers).items()}
    assert (got["retrieval"].n_answered, got["retrieval"].n, got["retrieval"].rr_answered, got["retrieval"].rr_all) == (1, 2, 0.5, 0.25)
    a = got["answers"]
    assert (a.n, a.citation_f1, a.has_citations, a.answer_length) == (1, 1.0, True, 31) and a.completeness == 1.0 and a.token_overlap == pytest.approx(2 * 2 / 8)


def test_responses(spark):
    told = spark.createDataFrame([("a", "Graph Walks", ["Ada Lovelace", "Alan Turing", "Emmy Noether"], 2020, "ACL", "results", "Walks are short. They end."), ("b", "Unknown Document", [], None, None, "unknown", "No title here.")], "chunk_id string, paper_title string, authors array<string>, year int, venue string, section_type string, text string")
    q = spark.createDataFrame([(1, "How long are walks?"), (2, "Who?")], "query_id int, text string")
    hits = spark.createDataFrame([(1, "a", 0.9, 1), (1, "b", -2.0, 2)], "query_id int, chunk_id string, score double, rank int")
    got = {r.query_id: r for r in G.respond(q, hits, told, G.first_sentences).collect()}
    one = got[1]
    assert one.answer == "Walks are short. (Lovelace et al., 2020, results)" and one.has_citations and one.papers_cited == ["Graph Walks"] and not one.is_multi_paper
    assert one.reference_list == "[1] Lovelace, A., Turing, A., Noether, E. (2020). Graph Walks. ACL." and one.bibtex.startswith("@inproceedings{lovelace2020graph,") and one.num_sources == 2
    assert got[2].answer == G.NO_HITS and got[2].confidence == 0 and got[2].query == "Who?"
    assert G.respond(q, hits, told, G.first_sentences, error="disk full").first().answer == "Retrieval failed: disk full. Unable to find relevant documents."
    invented = G.respond(q, hits, told, lambda p, s: F.lit("It is so (Gauss, 1936). Walks end (Lovelace, 2020)."), verify=False).filter("query_id = 1").first()
    assert "Gauss" not in invented.answer and invented.citations_removed == 1 and invented.has_citations
    failed = G.respond(q, hits, told, lambda p, s: F.lit(None).cast("string"), mode="compare", verify=False).filter("query_id = 1").first()
    assert failed.answer == G.FAILED["compare"] and failed.is_multi_paper
    conflicts = G.respond(q, hits, told, lambda p, s: F.lit("none (Gauss, 1936)"), mode="conflicts", verify=False).filter("query_id = 1").first()
    assert conflicts.answer == "none (Gauss, 1936)" and conflicts.confidence == 0.5 and conflicts.query == G.CONFLICTS_QUERY
    with pytest.raises(ValueError):
        G.model_registry({"own": G.first_sentences})("other")


def test_chat(spark):
    messages = spark.createDataFrame([("c", t, "user" if t % 2 == 0 else "assistant", f"m{t}") for t in range(9)], "conv_id string, turn int, role string, text string")
    asked = spark.createDataFrame([("c", "next?"), ("new", "hello")], "conv_id string, text string")
    turns = G.chat_turns(messages, asked)
    got = {r.conv_id: r for r in turns.collect()}
    assert got["c"].turn_number == 4 and got["c"].context.startswith("Assistant: m3") and (got["new"].turn_number, got["new"].context) == (1, None)
    added = G.chat_messages(messages, asked, asked.select("conv_id", F.lit("yes").alias("answer"))).collect()
    assert {(r.conv_id, r.turn, r.role) for r in added} == {("c", 9, "user"), ("c", 10, "assistant"), ("new", 0, "user"), ("new", 1, "assistant")}
    assert [(r.conv_id, r.messages, r.last_turn, r.title) for r in G.conversation_list(messages).collect()] == [("c", 9, 8, "m0")]

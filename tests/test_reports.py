"""Cleaning, prompts, annotated papers, enrichment and report checks on values worked out by hand."""

import json
import re

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from corpusloom.functions import preprocess as C
from corpusloom.functions import prompts
from corpusloom.operators import enrichment, evaluation, report
from corpusloom.operators.cleaning import preprocess
from corpusloom.sources.annotated import gold_answers, questions, read_papers


def test_preprocess(spark):
    texts = ["“a”  b ```\n  x   y\n``` c\n\n\n\nd…\r\n é", "```\nnot  closed", " \n", None, "Page one\n" * 5 + "end", "\U0010fffd  ```k```", ""]
    df = spark.createDataFrame(list(enumerate(texts)), "k int, text string")
    got = [r.cleaned for r in preprocess(df, F.col("text")).orderBy("k").collect()]
    assert [r.text for r in got] == ['"a" b ```\n  x   y\n``` c\n\nd...\n é', "```\nnot closed", "", "", "end", "\U0010fffd ```k```", ""]
    assert [r.code_blocks for r in got] == [1, 0, 0, 0, 0, 1, 0] and got[0].newlines_removed == 2 and got[0].unicode_changes == 3
    assert got[4].lines_removed == 5 and [r.error for r in got] == [None, None, "Empty input", "Empty input", None, None, "Empty input"]
    kept = preprocess(df.filter("k = 4"), F.col("text"), artifacts=False).first().cleaned
    assert kept.text == texts[4] and kept.reduction_percent == 0


def test_evidence_normal(spark):
    one = lambda c: spark.range(1).select(c.alias("v")).first().v
    assert one(C.evidence_normal(F.lit("  ﬁne  “Straße”\n–"))) == 'fine "strasse" -'
    assert one(C.evidence_normal(F.lit(None).cast("string"))) is None


def test_perturb_number(spark):
    texts = ["F1 of 0.75 on 12 items", "none at all v1.2b3", "0", "9.99", "", None, "7" * 30, "7" * 60]
    got = [r.v for r in spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", C.perturb_number(F.col("t")).alias("v")).orderBy("k").collect()]
    assert got[1] is got[4] is got[5] is None and int(got[2]) > 0 and re.fullmatch(r"\d+\.\d\d", got[3]) and got[3] != "9.99"
    changed = [a != b for a, b in zip(texts[0].split(), got[0].split(), strict=True)]
    assert sum(changed) == 1 and (changed[2] or changed[4]) and "-" not in got[0]
    assert got[6] != texts[6] and got[7] != texts[7]


SOURCE = "array<struct<paper_title string, authors array<string>, year int, venue string, section_type string, text string>>"


def test_prompts(spark):
    rows = [([("P", ["Ann Lee", "Bo Ray"], 2020, "ACL", "results", "x"), (None, None, None, None, None, "y"), ("P", ["A B", "C D", "E F"], None, None, "unknown", "z")],), ([],)]
    df = spark.createDataFrame(rows, f"s {SOURCE}")
    got = df.select(prompts.context(F.col("s")).alias("c"), prompts.context_by_paper(F.col("s")).alias("p"), prompts.prompt(F.lit("Q?"), F.lit("C"), F.lit("M")).alias("m")).collect()
    assert got[0].c == "[Source 1] Paper: P | Authors: Ann Lee and Bo Ray | Year: 2020 | Venue: ACL | Section: results\nCite this source as: (Ann Lee and Bo Ray, 2020, results)\nx\n\n---\n[Source 2]\ny\n\n---\n[Source 3] Paper: P | Authors: B et al.\nCite this source as: (B et al., n.d.)\nz\n"
    assert got[0].p == "\n\n" + "=" * 50 + "=== PAPER: P ===\nAuthors: Ann Lee and Bo Ray | Year: 2020 | Venue: ACL\n\n[results] x\n\n[unknown] z\n\n=== PAPER: Unknown Document ===\n\n[unknown] y"
    assert got[1].c == "" and got[0].m.endswith("SOURCE DOCUMENTS:\nC\n\nADDITIONAL CONTEXT:\nM\n\nQUESTION: Q?\n\nANSWER (with citations):")


def _answer(**kw):
    return {"answer": {"unanswerable": False, "extractive_spans": [], "free_form_answer": "", "yes_no": None, "evidence": []} | kw}


def test_annotated_papers(spark, tmp_path):
    qas = [
        {"question": "q1", "question_id": "a", "answers": [_answer(extractive_spans=["one", " two"], evidence=["E1 ", "FLOAT SELECTED: t"]), _answer(yes_no=False, evidence=["E1", "E2"]), _answer(unanswerable=True)]},
        {"question": "q2", "question_id": "b", "answers": [_answer(unanswerable=True)]},
        {"question": "q3", "question_id": "c", "answers": [_answer(free_form_answer=" f ") | {"evidence": ["beside"]}]},
    ]
    data = {"p1": {"title": "T", "abstract": "A", "full_text": [{"section_name": "X ::: Y", "paragraphs": [" one ", "", None]}], "qas": qas}, "p2": {"title": None, "full_text": {"Intro": ["[1] x"], "Solo": "text"}, "qas": []}}
    (tmp_path / "d.json").write_text(json.dumps(data))
    papers = read_papers(spark, str(tmp_path / "d.json"))
    got = {r.paper_id: r for r in papers.withColumn("md", C.markdown(F.col("title"), F.col("abstract"), F.col("sections"))).collect()}
    assert got["p1"].md == "# T\n\n## Abstract\n\nA\n\n### Y\n\none\n" and got["p2"].md == "## Intro\n\n[1] x\n\n## Solo\n\ntext\n"
    asked = {r.question_id: r for r in questions(papers).collect()}
    assert asked["a"].answers == ["one", "two", "No"] and asked["a"].body_evidence == ["E1", "E2"] and len(asked["a"].evidence) == 3 and asked["a"].answer_type == "yes_no"
    assert asked["b"].is_unanswerable and asked["b"].answer_type == "unanswerable" and asked["c"].answers == ["f"] and asked["c"].evidence == ["beside"] and not asked["a"].is_unanswerable
    gold = {r.question_id: [(x.answer, x.type) for x in r.references] for r in gold_answers(papers).collect()}
    assert gold == {"a": [("one,  two", "extractive"), ("No", "boolean"), ("Unanswerable", "none")], "b": [("Unanswerable", "none")], "c": [(" f ", "abstractive")]}
    assert read_papers(spark, str(tmp_path / "gone.json")).count() == 0
    (tmp_path / "e.json").write_text(json.dumps({"p": {"qas": [{"question_id": "x", "answers": [_answer()]}]}}))
    with pytest.raises(PySparkException):
        gold_answers(read_papers(spark, str(tmp_path / "e.json"))).collect()


def test_enrich_and_merge(spark):
    chunks = spark.createDataFrame([("d", "see [1]", "Results", "", 0), ("d", "$x$", None, "", 50), ("e", "", None, None, None)], "document_id string, text string, header string, header_path string, start_char int")
    papers = spark.createDataFrame([("d", "about", [(40, 60, "abstract")], "T", ["A"], "ACL", 2020, None, None, "journal", 0.9), ("e", None, [], None, [], None, None, None, None, None, 0.5)], "document_id string, abstract string, sections array<struct<start int, end int, kind string>>, title string, authors array<string>, venue string, year int, doi string, arxiv_id string, paper_type string, confidence double")
    got = sorted((r.text, r.section_type, r.has_equations, r.has_citations, r.is_abstract) for r in enrichment.enrich_chunks(chunks, papers).collect() if r.document_id == "d")
    assert got == [("$x$", "abstract", True, False, True), ("see [1]", "results", False, True, False)]
    assert enrichment.enrich_chunks(chunks, papers).filter("document_id = 'e' and section_type is null and paper_title is null").count() == 1
    merged = enrichment.merge_properties(papers.select("document_id", "title", "authors"), spark.createDataFrame([("d", "U", "X", 3), ("e", "V", "A B, C", 4)], "document_id string, title string, author string, total_pages int"))
    assert {r.document_id: (r.title, r.authors, r.total_pages) for r in merged.collect()} == {"d": ("T", ["A"], 3), "e": ("V", ["A B", "C"], 4)}


def test_report(spark):
    assert [r.g for r in spark.createDataFrame([(0.7,), (0.69,), (0.3,), (0.1,), (None,)], "v double").select(report.grade(F.col("v")).alias("g")).collect()] == ["Excellent", "Good", "Fair", "Needs Improvement", None]
    schema = "retrieved_ids array<int>, relevant_ids array<int>, generated_answer string"
    got = report.sample_warnings(spark.createDataFrame([([1], [1], None), ([], [1], "")], schema)).collect()
    assert sorted((r.measure, r.scorable, r.total) for r in got) == [("answers", 0, 2), ("retrieval", 1, 2)]
    assert report.sample_warnings(spark.createDataFrame([([1], [1], "a")], schema)).count() == 0 and report.sample_warnings(spark.createDataFrame([], schema)).count() == 2
    rows = spark.createDataFrame([("d", "me"), ("e", "you"), ("f", None)], "document_id string, user_id string")
    vectors = spark.createDataFrame([("d", "me"), ("gone", "me"), ("e", "you")], "document_id string, user_id string")
    docs, chunks, left = report.reset_tenant("me", rows, rows, vectors)
    assert [sorted(r.document_id for r in t.collect()) for t in (docs, chunks, left)] == [["e", "f"], ["e", "f"], ["e"]]
    report.check_reset("me", docs, chunks, left)
    with pytest.raises(RuntimeError):
        report.check_reset("me", rows)
    assert {r.name: r.ok for r in report.integrity(rows, rows, rows, vectors.limit(2)).collect()} == {"papers_ingested": True, "documents_stored": True, "vectors_stored": False}


def test_auc_of_many_scores(spark):
    rows = [(k % 3 == 0, (k * 7919 % 1000) // 2) for k in range(1000)]
    pairs = [(p > n) + (p == n) / 2 for a, p in rows if a for b, n in rows if not b]
    got = evaluation.roc_auc(spark.createDataFrame([(int(a), float(s)) for a, s in rows], "label int, score double")).first().auc
    assert got == pytest.approx(sum(pairs) / len(pairs))
    assert evaluation.roc_auc(spark.createDataFrame([], "label int, score double")).first().auc is None

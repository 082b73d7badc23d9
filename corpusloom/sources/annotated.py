"""Papers with annotated questions: one JSON object of papers a file."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.preprocess import strip

ANSWER = "struct<unanswerable boolean, extractive_spans array<string>, free_form_answer string, yes_no boolean, evidence array<string>>"
QUESTION = f"struct<question string, question_id string, answers array<struct<answer {ANSWER}, evidence array<string>>>>"
PAPERS = f"map<string, struct<title string, abstract string, full_text string, qas array<{QUESTION}>>>"
#: Fixed value: evidence that points at a figure or table.
FLOAT = "FLOAT SELECTED"


def _no(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _sections(c: Column) -> Column:
    """Sections of a list of section objects, or of an object of name and paragraphs."""

    def clean(name: Column, raw: Column) -> Column:
        listed = F.when(raw.startswith("["), F.from_json(raw, "array<string>"))
        texts = F.filter(F.transform(F.array_compact(F.coalesce(listed, F.array(raw))), strip), lambda p: p != "")
        return F.struct(strip(F.coalesce(name, F.lit(""))).alias("section"), texts.alias("paragraphs"))

    listed = F.transform(F.array_compact(F.from_json(c, "array<struct<section_name string, paragraphs string>>")), lambda s: clean(s["section_name"], s["paragraphs"]))
    named = F.transform(F.map_entries(F.from_json(c, "map<string, string>")), lambda e: clean(e["key"], e["value"]))
    return F.coalesce(F.when(F.ltrim(c).startswith("["), listed).otherwise(named), _no("struct<section string, paragraphs array<string>>"))


def read_papers(spark: SparkSession, path: str) -> DataFrame:
    """(paper_id, title, abstract, sections, qas); a path that does not exist has no papers.

    A file is one record, so it must fit a task; split larger collections into several files.
    """
    try:
        files = spark.read.text(path, wholetext=True)
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        files = spark.createDataFrame([], "value string")
    papers = files.select(F.explode(F.from_json("value", PAPERS)).alias("paper_id", "p"))
    text = lambda c: F.coalesce(F.col(c), F.lit(""))
    return papers.select("paper_id", text("p.title").alias("title"), text("p.abstract").alias("abstract"), _sections(F.col("p.full_text")).alias("sections"), F.coalesce("p.qas", _no(QUESTION)).alias("qas"))


def answer_kind(a: Column) -> Column:
    """What an annotation answers with; null when it has no answer."""
    return F.when(a["unanswerable"], "unanswerable").when(a["yes_no"].isNotNull(), "yes_no").when(F.size(a["extractive_spans"]) > 0, "extractive").when(a["free_form_answer"] != "", "free_form")


def _texts(a: Column) -> Column:
    kind = answer_kind(a)
    spans = F.filter(F.transform(F.array_compact(a["extractive_spans"]), strip), lambda s: s != "")
    return F.when(kind == "yes_no", F.array(F.when(a["yes_no"], "Yes").otherwise("No"))).when(kind == "extractive", spans).when(kind == "free_form", F.array(strip(a["free_form_answer"]))).otherwise(_no("string"))


def questions(papers: DataFrame) -> DataFrame:
    """Each question with the answers of all annotators and the union of their evidence, in order.

    The kind is that of the last answer; a question is unanswerable only if nobody answered it.
    """
    rows = papers.select("paper_id", "title", F.explode("qas").alias("q"))
    each = F.coalesce(F.col("q.answers"), _no(f"struct<answer {ANSWER}, evidence array<string>>"))
    kinds = F.array_compact(F.transform(each, lambda e: answer_kind(e["answer"])))
    given = F.filter(kinds, lambda k: k != "unanswerable")
    refused = (F.size(given) == 0) & (F.size(kinds) > 0)
    inside = lambda e: F.when(F.size(e["answer"]["evidence"]) > 0, e["answer"]["evidence"])
    evidence = F.flatten(F.transform(each, lambda e: F.coalesce(inside(e), e["evidence"], _no("string"))))
    kept = F.array_distinct(F.filter(F.transform(F.array_compact(evidence), strip), lambda x: x != ""))
    return rows.select(
        "paper_id",
        F.col("title").alias("paper_title"),
        F.coalesce("q.question_id", F.lit("")).alias("question_id"),
        F.coalesce("q.question", F.lit("")).alias("question"),
        F.flatten(F.transform(each, lambda e: _texts(e["answer"]))).alias("answers"),
        kept.alias("evidence"),
        F.filter(kept, lambda x: ~x.startswith(FLOAT)).alias("body_evidence"),
        refused.alias("is_unanswerable"),
        F.coalesce(F.try_element_at(given, F.lit(-1)), F.when(refused, "unanswerable").otherwise("free_form")).alias("answer_type"),
    )


def gold_answers(papers: DataFrame, text_evidence_only: bool = True) -> DataFrame:
    """(question_id, references) with answer, evidence and type of each annotation.

    Spans go before free text, that before yes or no; an annotation without an answer is an error.
    """

    def reference(e: Column) -> Column:
        a = e["answer"]
        spans = F.size(a["extractive_spans"]) > 0
        none, free = F.coalesce(a["unanswerable"], F.lit(False)), a["free_form_answer"] != ""
        answer = F.when(none, "Unanswerable").when(spans, F.array_join(a["extractive_spans"], ", ")).when(free, a["free_form_answer"]).when(a["yes_no"], "Yes").when(~a["yes_no"], "No").otherwise(F.raise_error(F.lit("an annotation does not contain an answer")).cast("string"))
        kind = F.when(none, "none").when(spans, "extractive").when(free, "abstractive").otherwise("boolean")
        cited = F.coalesce(a["evidence"], _no("string"))
        if text_evidence_only:
            cited = F.filter(cited, lambda x: ~x.contains(FLOAT))
        return F.struct(answer.alias("answer"), F.when(none, _no("string")).otherwise(cited).alias("evidence"), kind.alias("type"))

    rows = papers.select(F.explode("qas").alias("q"))
    return rows.select("q.question_id", F.transform("q.answers", reference).alias("references"))

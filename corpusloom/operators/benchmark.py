"""Evaluation runs: samples, batch means, official answer scores, corpus statistics, ladders."""

from __future__ import annotations

import random

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions.answers import citation_scores, completeness, has_citation, paragraph_f1
from corpusloom.functions.text import set_f1, squad_normal
from corpusloom.operators.evaluation import multiset_f1, ranking_metrics

SEED = 20260827
SAMPLES = "query_id long, query string, reference_answer string, relevant_ids array<string>, source_papers array<string>"
# Markers of evidence that is a figure or a table, and the answer types.
FLOAT_MARKER, TYPES = "FLOAT SELECTED", ("extractive", "abstractive", "boolean", "none")


def custom_samples(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """Entries of query, answer, evidence (relevant ids) and source_papers as samples."""
    rows = [(k, e["query"], e.get("answer", ""), list(e.get("evidence", [])), list(e.get("source_papers", []))) for k, e in enumerate(entries)]
    return spark.createDataFrame(rows, SAMPLES)


def paper_samples(questions: DataFrame, skip_unanswerable: bool = True, most: int | None = None) -> DataFrame:
    """Questions (paper_id, title, question_id, place, question, answers, evidence, is_unanswerable) as samples.

    Relevant ids stay empty: they are known once chunks are. Order: paper, place.
    """
    kept = questions.filter(~F.col("is_unanswerable")) if skip_unanswerable else questions
    none = F.array().cast("array<string>")
    titles = F.when(F.col("title") != "", F.array("title")).otherwise(none)
    out = kept.select("paper_id", "question_id", "place", F.col("question").alias("query"), F.coalesce(F.get("answers", F.lit(0)), F.lit("")).alias("reference_answer"), none.alias("relevant_ids"), "evidence", titles.alias("source_papers"))
    return out.orderBy("paper_id", "place").limit(most) if most else out


def eligible_papers(questions: DataFrame, n: int, seed: int = SEED, least: int = 1) -> DataFrame:
    """``n`` papers drawn from those with ``least`` answerable questions that have body evidence.

    Ids come to the driver in order, for the draw to be that of a seeded sequential generator.
    """
    body = F.size(F.filter("evidence", lambda e: ~e.startswith(FLOAT_MARKER))) > 0
    counted = questions.groupBy("paper_id").agg(F.count_if(~F.col("is_unanswerable") & body).alias("n")).filter(F.col("n") >= least)
    ids = [r.paper_id for r in counted.select("paper_id").orderBy("paper_id").collect()]
    drawn = ids if n >= len(ids) else random.Random(seed).sample(ids, n)
    return questions.sparkSession.createDataFrame(list(enumerate(drawn)), f"place int, paper_id {questions.schema['paper_id'].dataType.simpleString()}")


def spread(samples: DataFrame, n: int, limit: int | None, seed: int = SEED) -> DataFrame:
    """``limit`` of ``n`` samples, by their ``place`` from 0 on, drawn over all of them."""
    if not limit or limit >= n:
        return samples
    places = samples.sparkSession.createDataFrame([(k,) for k in sorted(random.Random(seed).sample(range(n), limit))], "place long")
    return samples.join(F.broadcast(places), "place", "left_semi")


def retrieval_means(metrics: DataFrame, hits: DataFrame) -> DataFrame:
    """Means over questions that have results, and beside them over all (no result counts 0).

    metrics: one row a question with its measures (0 without hits).
    """
    answered = metrics.join(hits.select("query_id").distinct().withColumn("answered", F.lit(True)), "query_id", "left")
    names = [c for c in metrics.columns if c != "query_id"]
    some = F.col("answered").isNotNull()
    return answered.agg(F.count_if(some).alias("n_answered"), F.count("*").alias("n"), *[F.avg(F.when(some, F.col(c))).alias(f"{c}_answered") for c in names], *[F.avg(c).alias(f"{c}_all") for c in names])


def answer_means(scored: DataFrame) -> DataFrame:
    """A10: means of rouge1, rouge2, rougeL, citation_precision, citation_recall, citation_f1, token_overlap and completeness.

    ``has_citations`` holds if all answers have one; the mean length is rounded down.
    Answers that are empty don't count.
    """
    means = ("rouge1", "rouge2", "rougeL", "citation_precision", "citation_recall", "citation_f1", "token_overlap", "completeness")
    out = scored.filter(F.length("answer") > 0)
    return out.agg(F.count("*").alias("n"), *[F.avg(c).alias(c) for c in means if c in scored.columns], F.bool_and("has_citations").alias("has_citations"), F.floor(F.sum(F.length("answer")) / F.count("*")).alias("answer_length"))


def evaluate(samples: DataFrame, hits: DataFrame, answers: DataFrame | None = None) -> dict[str, DataFrame]:
    """One row of retrieval means over samples that have relevant ids and results, and one of answer means over those with an answer.

    samples: query_id, query, reference_answer, relevant_ids, source_papers; hits: query_id,
    chunk_id, rank; answers: query_id, answer.
    """
    relevant = samples.select("query_id", F.explode("relevant_ids").alias("chunk_id"))
    out = {"retrieval": retrieval_means(ranking_metrics(hits.withColumn("chunk_id", F.col("chunk_id").cast("string")), relevant), hits)}
    if answers is not None:
        words = lambda c: F.filter(F.split(F.lower(c), r"(?U)\s+"), lambda w: w != "")
        told = answers.filter(F.length("answer") > 0).join(samples, "query_id")
        cited = citation_scores(F.col("answer"), F.col("source_papers"))
        scored = told.select("answer", set_f1(words(F.col("answer")), words(F.col("reference_answer"))).alias("token_overlap"), completeness(F.col("answer"), F.col("query")).alias("completeness"), cited["precision"].alias("citation_precision"), cited["recall"].alias("citation_recall"), cited["f1"].alias("citation_f1"), has_citation(F.col("answer")).alias("has_citations"))
        out["answers"] = answer_means(scored)
    return out


def gold_answers(annotations: DataFrame) -> DataFrame:
    """question_id, place, answer, evidence (without figures) and type of each annotation.

    annotations: question_id, place, unanswerable, extractive_spans, free_form_answer, yes_no, evidence.
    An annotation without any answer is an error.
    """
    spans, free, yes = F.size("extractive_spans") > 0, F.col("free_form_answer") != "", F.col("yes_no")
    none = F.raise_error(F.lit("an annotation holds no answer")).cast("string")
    answer = F.when(F.col("unanswerable"), "Unanswerable").when(spans, F.array_join("extractive_spans", ", ")).when(free, F.col("free_form_answer")).when(yes, "Yes").when(yes.isNotNull(), "No").otherwise(none)
    kind = F.when(F.col("unanswerable"), "none").when(spans, "extractive").when(free, "abstractive").otherwise("boolean")
    body = F.when(F.col("unanswerable"), F.array().cast("array<string>")).otherwise(F.filter("evidence", lambda e: ~e.contains(FLOAT_MARKER)))
    return annotations.select("question_id", "place", answer.alias("answer"), body.alias("evidence"), kind.alias("type"))


def official_scores(gold: DataFrame, predicted: DataFrame) -> DataFrame:
    """Per question answer_f1, evidence_f1, the type of its best annotator and whether a prediction is missing.

    gold: question_id, place, answer, evidence, type; predicted: question_id, answer, evidence.
    The best annotation decides each score; ties go to the first one.
    """
    p = predicted.select("question_id", F.col("answer").alias("said"), F.col("evidence").alias("shown"))
    both = gold.join(p.withColumn("there", F.lit(True)), "question_id", "left")
    words = lambda c: F.filter(F.split(squad_normal(F.coalesce(c, F.lit(""))), " "), lambda w: w != "")
    f1 = multiset_f1(both, ["question_id", "place"], answer_f1=(words(F.col("said")), words(F.col("answer"))))
    scored = both.join(f1, ["question_id", "place"]).withColumn("evidence_f1", paragraph_f1(F.col("shown"), F.col("evidence")))
    there = F.coalesce("there", F.lit(False))
    best = scored.groupBy("question_id").agg(F.bool_or(there).alias("there"), F.min_by(F.struct("answer_f1", "type"), F.struct(-F.col("answer_f1"), "place")).alias("b"), F.max("evidence_f1").alias("evidence_f1"))
    real = lambda c: F.when(F.col("there"), c).otherwise(F.lit(0.0))
    return best.select("question_id", real(F.col("b.answer_f1")).alias("answer_f1"), real(F.col("evidence_f1")).alias("evidence_f1"), F.when(F.col("there"), F.col("b.type")).alias("type"), (~F.col("there")).alias("missing"))


def official_summary(scores: DataFrame) -> DataFrame:
    """One row: means over all questions, missing predictions, and by type the mean answer F1 and the number."""
    by = [x for t in TYPES for x in (F.coalesce(F.avg(F.when(F.col("type") == t, F.col("answer_f1"))), F.lit(0.0)).alias(f"answer_f1_{t}"), F.count_if(F.col("type") == t).alias(f"n_{t}"))]
    return scores.agg(F.count("*").alias("n"), F.coalesce(F.avg("answer_f1"), F.lit(0.0)).alias("answer_f1"), F.coalesce(F.avg("evidence_f1"), F.lit(0.0)).alias("evidence_f1"), F.count_if("missing").alias("missing"), *by)


def corpus_summary(questions: DataFrame, grounded: DataFrame) -> DataFrame:
    """What a corpus keeps and drops: questions seen, unanswerable, without (found) evidence, kept; evidence found; mean relevant chunks.

    questions: question_id, is_unanswerable, evidence; grounded: question_id, place (of the evidence), chunk_id.
    """
    body = F.filter("evidence", lambda e: ~e.startswith(FLOAT_MARKER))
    found = grounded.groupBy("question_id").agg(F.countDistinct("place").alias("mapped"), F.countDistinct("chunk_id").alias("relevant"))
    q = questions.select("question_id", "is_unanswerable", F.size(body).alias("n_evidence")).join(found, "question_id", "left")
    open_, some = ~F.col("is_unanswerable"), F.col("relevant").isNotNull()
    kept = open_ & (F.col("n_evidence") > 0) & some
    return q.agg(
        F.count("*").alias("questions_seen"), F.count_if("is_unanswerable").alias("dropped_unanswerable"), F.count_if(open_ & ~kept).alias("dropped_no_evidence"), F.count_if(kept).alias("questions_kept"),
        F.coalesce(F.sum(F.when(open_, F.col("n_evidence"))), F.lit(0)).alias("evidence_total"), F.coalesce(F.sum(F.when(open_, F.col("mapped"))), F.lit(0)).alias("evidence_mapped"), F.coalesce(F.avg(F.when(kept, F.col("relevant"))), F.lit(0.0)).alias("mean_relevant_chunks"),
    )


def faithfulness_summary(per_answer: DataFrame) -> DataFrame:
    """Mean over answers with claims, share of all claims, answers without an unsupported one."""
    some = F.col("faithfulness").isNotNull()
    claims, bad = F.sum(F.when(some, F.col("num_claims"))), F.sum(F.when(some, F.col("num_unsupported")))
    return per_answer.agg(F.count("*").alias("answers_checked"), F.count_if(some).alias("answers_with_claims"), F.round(F.avg("faithfulness"), 4).alias("mean_faithfulness"), claims.alias("claims"), (claims - bad).alias("claims_verified"), F.round((claims - bad) / claims, 4).alias("claim_level_faithfulness"), F.count_if(some & (F.col("num_unsupported") == 0)).alias("answers_fully_verified"))


def ladder(arms: dict[str, DataFrame], first: str | None = None) -> DataFrame:
    """arms' mean measures (one row each) in one table, with what each gains on the first."""
    out = None
    for place, (arm, means) in enumerate(arms.items()):
        row = means.withColumn("arm", F.lit(arm)).withColumn("place", F.lit(place))
        out = row if out is None else out.unionByName(row)
    names = [c for c in out.columns if c not in ("arm", "place")]
    base = out.filter(F.col("arm") == (first or next(iter(arms)))).select(*[F.col(c).alias(f"{c}_first") for c in names])
    both = out.join(F.broadcast(base), how="cross")  # one row
    return both.select("arm", "place", *names, *[(F.col(c) - F.col(f"{c}_first")).alias(f"{c}_delta") for c in names])


def rounded(df: DataFrame, places: int = 4) -> DataFrame:
    """Fractions as reports write them."""
    return df.select(*[F.round(c, places).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def paper_of(stem: Column) -> Column:
    """A paper's id from its file name, ``<id>_<paper>.md`` or ``<paper>.md``."""
    return F.regexp_extract(stem, r"(?:^|/)(?:[0-9a-f]{8}_)?([^/]+?)(?:\.[A-Za-z0-9]+)?$", 1)


def preprocess_totals(stats: DataFrame) -> DataFrame:
    """Totals of a cleaning run over rows with success, chars_before, chars_after and tokens; the mean is rounded down."""
    good = F.col("success")
    n = F.count_if(good)
    return stats.agg(F.count("*").alias("files"), n.alias("succeeded"), F.count_if(~good).alias("failed"), F.coalesce(F.sum(F.when(good, F.col("chars_before") - F.col("chars_after"))), F.lit(0)).alias("chars_removed"), F.coalesce(F.floor(F.sum(F.when(good, F.col("tokens"))) / F.nullif(n, F.lit(0))), F.lit(0)).alias("avg_tokens"))

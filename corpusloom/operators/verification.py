"""Claim verification: each claim against the best windows of its answer's own sources."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.answers import claims, content_words, split_sentences
from corpusloom.functions.text import source_windows


def word_share(window: Column, claim: Column) -> tuple[Column, Column]:
    """A stand-in for an entailment model: the share of the claim's words in the window."""
    words = content_words(claim)
    return F.when(F.size(words) > 0, F.size(F.array_intersect(words, content_words(window))) / F.size(words)).otherwise(F.lit(0.0)), F.lit(0.0)


def verify_claims(answers: DataFrame, sources: DataFrame, score: Callable[[Column, Column], tuple[Column, Column]] = word_share, threshold: float = 0.5, most: int = 4) -> DataFrame:
    """One row per claim of ``answers`` (answer_id, answer).

    ``sources`` (answer_id, source_index, text) are the few an answer was made from; a
    claim's ``most`` windows with the largest word overlap are scored (ties to the
    earlier), and its best one decides.  A claim without windows is unsupported with 0.
    """
    asked = answers.select("answer_id", F.posexplode(claims(F.col("answer"))).alias("claim_no", "claim"))
    told = sources.select("answer_id", "source_index", split_sentences(F.col("text")).alias("parts")).filter(F.size("parts") > 0)
    told = told.select("answer_id", "source_index", F.posexplode(source_windows(F.col("parts"))).alias("window_no", "window"))
    told = told.withColumn("window_words", content_words(F.col("window")))
    shared = F.size(F.array_intersect(F.col("claim_words"), F.col("window_words")))
    order = Window.partitionBy("answer_id", "claim_no").orderBy(F.desc("shared"), "source_index", "window_no")
    near = asked.withColumn("claim_words", content_words(F.col("claim"))).join(told, "answer_id").withColumn("shared", shared)
    near = near.withColumn("place", F.row_number().over(order)).filter(F.col("place") <= most)
    entailment, contradiction = score(F.col("window"), F.col("claim"))
    scored = near.withColumn("entailment", entailment).withColumn("contradiction", contradiction)
    best = F.min_by(F.struct("entailment", "source_index", F.col("window").alias("evidence")), F.struct(-F.col("entailment"), "place"))
    verdict = scored.groupBy("answer_id", "claim_no").agg(best.alias("b"), F.max("contradiction").alias("contradiction")).select("answer_id", "claim_no", "b.*", "contradiction")
    out = asked.join(verdict, ["answer_id", "claim_no"], "left").withColumn("entailment", F.coalesce("entailment", F.lit(0.0))).withColumn("contradiction", F.coalesce("contradiction", F.lit(0.0)))
    return out.withColumn("supported", F.col("evidence").isNotNull() & (F.col("entailment") >= threshold))


def faithfulness(answers: DataFrame, verdicts: DataFrame) -> DataFrame:
    """Per answer: number of claims, unsupported ones, share supported (null without claims)."""
    counts = verdicts.groupBy("answer_id").agg(F.count("*").alias("n"), F.count_if(~F.col("supported")).alias("bad"))
    out = answers.select("answer_id").join(counts, "answer_id", "left")
    return out.select("answer_id", F.coalesce("n", F.lit(0)).alias("num_claims"), F.coalesce("bad", F.lit(0)).alias("num_unsupported"), (1 - F.col("bad") / F.col("n")).alias("faithfulness"))

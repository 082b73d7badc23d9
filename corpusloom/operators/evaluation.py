"""Ranking and answer metrics, significance, thresholds."""

from __future__ import annotations

import random
from statistics import fmean

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import ship_package

#: Ranges of scores that are ranked apart.
BUCKETS = 200


def ranking_metrics(hits: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (5, 10)) -> DataFrame:
    """M1-M5 for every query with a relevant chunk: hits (query_id, chunk_id, rank), relevant (query_id, chunk_id).

    A query without hits scores 0 everywhere; precision divides by k.
    """
    truth = relevant.select("query_id", "chunk_id").distinct().withColumn("relevant", F.lit(1))
    sizes = truth.groupBy("query_id").agg(F.count("*").alias("n_relevant"))
    judged = hits.join(truth, ["query_id", "chunk_id"]).withColumn("found", F.row_number().over(Window.partitionBy("query_id").orderBy("rank")))
    sums = [F.min("rank").alias("first"), F.sum(F.col("found") / F.col("rank")).alias("ap")]
    for k in ks:
        sums += [F.count_if(F.col("rank") <= k).alias(f"hits{k}"), F.sum(F.when(F.col("rank") <= k, 1 / F.log2(F.col("rank") + 1))).alias(f"dcg{k}")]
    out = sizes.join(judged.groupBy("query_id").agg(*sums), "query_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    columns = [zero(1 / F.col("first")).alias("rr"), zero(F.col("ap") / F.col("n_relevant")).alias("ap")]
    for k in ks:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_relevant").cast("int"))), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        columns += [zero(F.col(f"hits{k}") / F.lit(k)).alias(f"precision{k}"), zero(F.col(f"hits{k}") / F.col("n_relevant")).alias(f"recall{k}"), zero(F.col(f"dcg{k}") / ideal).alias(f"ndcg{k}")]
    return out.select("query_id", *columns)


def multiset_f1(pairs: DataFrame, keys: list[str], **measures: tuple[Column, Column]) -> DataFrame:
    """By name, the F1 of two token arrays as multisets; ``keys`` tell the rows apart.

    Rows are dealt out by their keys once; each token of a row is counted on either side.
    """
    none = F.array().cast("array<string>")
    side = lambda name, c, b: F.transform(F.coalesce(c, none), lambda t: F.struct(F.lit(name).alias("measure"), t.alias("token"), F.lit(b).alias("b")))
    both = F.concat(*[side(name, c, b) for name, columns in measures.items() for b, c in enumerate(columns)])
    each = pairs.select(*keys, both.alias("tokens")).repartition(*keys).select(*keys, F.explode_outer("tokens").alias("x"))
    counts = each.groupBy(*keys, "x.measure", "x.token").agg(F.count_if(F.col("x.b") == 0).alias("a"), F.count_if(F.col("x.b") == 1).alias("b"))
    own = lambda name, c: F.sum(F.when(F.col("measure") == name, c))
    f1 = lambda name: F.coalesce(2 * own(name, F.least("a", "b")) / own(name, F.col("a") + F.col("b")), F.lit(0.0))
    return counts.groupBy(*keys).agg(*[f1(name).alias(name) for name in measures])


def roc_auc(scored: DataFrame) -> DataFrame:
    """A15 on (label, score): share of pairs in order, ties a half; null when a class is missing.

    By rank sums over distinct scores, so pairs are never formed; ranks are counted within
    ranges of scores, to which the totals of the ranges below (at most BUCKETS) are added.
    """
    by_score = scored.groupBy("score").agg(F.count_if(F.col("label") == 1).alias("pos"), F.count_if(F.col("label") == 0).alias("neg"))
    bounds = scored.agg(F.percentile_approx("score", [k / BUCKETS for k in range(1, BUCKETS)])).first()[0] or []
    ranges = by_score.withColumn("bucket", F.size(F.filter(F.array(*[F.lit(b) for b in bounds]), lambda b: b < F.col("score"))))
    before = lambda w: F.coalesce(F.sum("neg").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = ranges.groupBy("bucket").agg(F.sum("neg").alias("neg")).select("bucket", before(Window.orderBy("bucket")).alias("base"))
    below = F.col("base") + before(Window.partitionBy("bucket").orderBy("score"))
    wins = ranges.join(F.broadcast(bases), "bucket").select("pos", "neg", (F.col("pos") * (below + F.col("neg") / 2)).alias("wins"))
    return wins.agg((F.sum("wins") / F.nullif(F.sum("pos") * F.sum("neg"), F.lit(0))).alias("auc"))


def threshold_sweep(scored: DataFrame) -> DataFrame:
    """A16 on (supported 0/1, score): a claim is flagged below the threshold."""
    each = scored.withColumn("percent", F.explode(F.sequence(F.lit(5), F.lit(95), F.lit(5)))).withColumn("flag", F.col("score") < F.col("percent") / 100)
    sums = each.groupBy("percent").agg(F.count_if(F.expr("flag and supported = 0")).alias("tp"), F.count_if(F.expr("flag and supported = 1")).alias("fp"), F.count_if(F.expr("not flag and supported = 0")).alias("fn"), F.count_if(F.expr("not flag and supported = 1")).alias("tn"))
    p, r = F.try_divide("tp", F.col("tp") + F.col("fp")), F.try_divide("tp", F.col("tp") + F.col("fn"))
    kept = F.try_divide("tn", F.col("tn") + F.col("fp"))
    return sums.select("percent", p.alias("precision"), r.alias("recall"), F.try_divide(2 * p * r, p + r).alias("f1"), kept.alias("supported_kept"), ((r + kept) / 2).alias("balanced_accuracy"))


def aligned(a: DataFrame, b: DataFrame) -> DataFrame:
    """Two arms' scores (query_id, a) and (query_id, b) side by side; other questions on either side are an error."""
    both = a.join(b, "query_id", "full_outer")
    wrong = F.col("a").isNull() | F.col("b").isNull()
    return both.select("query_id", *[F.when(wrong, F.raise_error(F.lit("the arms answered different questions")).cast("double")).otherwise(F.col(c)).alias(c) for c in ("a", "b")])


def _bootstrap(iterations: int, seed: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("query_id")
        diffs = (pdf["b"] - pdf["a"]).tolist()
        n, r = len(diffs), random.Random(seed)
        delta = fmean(diffs)
        means = sorted(sum(diffs[r.randrange(n)] for _ in range(n)) / n for _ in range(iterations))
        low, high = means[int(0.025 * iterations)], means[min(int(0.975 * iterations), iterations - 1)]
        extreme = sum(abs(sum(d if r.random() < 0.5 else -d for d in diffs) / n) >= abs(delta) - 1e-12 for _ in range(iterations))
        return pd.DataFrame({"comparison": [pdf["comparison"].iloc[0]], "delta": [delta], "ci_low": [low], "ci_high": [high], "p_value": [(extreme + 1) / (iterations + 1)], "significant": [low > 0 or high < 0]})

    return run


def paired_bootstrap(scores: DataFrame, iterations: int = 10_000, seed: int = 20260827) -> DataFrame:
    """M14 on (comparison, query_id, a, b): mean difference, percentile interval, sign-flip p value."""
    ship_package(scores.sparkSession)
    return scores.groupBy("comparison").applyInPandas(_bootstrap(iterations, seed), "comparison string, delta double, ci_low double, ci_high double, p_value double, significant boolean")


def latency_summary(df: DataFrame, key: str, value: str) -> DataFrame:
    """Mean and upper median (the upper of two middle values) of each key.

    Equal values are counted first, and a value's rank comes from these counts.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(key, value).agg(F.count("*").alias("n"))
    whole = Window.partitionBy(key)
    upto = F.sum("n").over(whole.orderBy(value).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = counts.withColumn("upto", upto).withColumn("total", F.sum("n").over(whole))
    median = F.min(F.when(F.col("upto") > F.floor(F.col("total") / 2), F.col(value)))
    return ranked.groupBy(key).agg((F.sum(F.col(value) * F.col("n")) / F.sum("n")).alias("mean"), median.alias("median"))


def gate(now: DataFrame, baseline: DataFrame, lower_is_better: tuple[str, ...] = ("claims.supported_flagged",), tolerance: float = 0.02) -> DataFrame:
    """Key, value, baseline, ok; a missing value fails."""
    both = baseline.select("key", F.col("value").alias("baseline")).join(now.select("key", "value"), "key", "left")
    worse = F.when(F.col("key").isin(list(lower_is_better)), F.col("value") - F.col("baseline")).otherwise(F.col("baseline") - F.col("value"))
    return both.withColumn("ok", F.coalesce(worse <= tolerance, F.lit(False)))

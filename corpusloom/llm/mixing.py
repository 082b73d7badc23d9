"""Mixing sources to target weights by subset-sum budget fitting.

Documents are counted by source and exact length.  A source takes all its documents as
often as its target holds its size, and fits the rest of the budget from the length
counts: first each length its even share, with what rounding leaves carried on from the
longest to the shortest, up to twice the longest length below the budget; then a bounded
knapsack over the documents that are left fills the gap exactly, or as nearly as their
lengths allow.  Which documents of a length are taken follows a seeded hash of id and
text, so reruns agree.

Only counts by (source, length, salt) are brought together; the salt is a part of the
hash, so a length that many documents share is ranked in ``SALTS`` parts.  A source's
distinct lengths meet in one task, one row each.

Cases: a null text has length 0 and is never taken; null is a source of its own, the
last; an empty source's target is 0; rows with the same id are documents each, and equal
rows are told apart by nothing, so it is left open which of them is taken; an empty table
gives an empty result; other columns pass through, whatever their names, but those called
like the five that are added, which these replace.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.runtime import ship_package

#: Parts in which documents of one source and length are ranked.
SALTS = 1024
ADDED = ("size", "source_size", "target", "taken", "copies")


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: dict[str | None, int], weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> dict[str | None, float]:
    """Each source's target: by weight, ``most`` times its size at most, the excess shared again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: weights[k % len(weights)] for k, s in enumerate(names)}
    budget, out, free = share * sum(sizes.values()), {}, list(names)
    while free:
        unit = budget / sum(weight[s] for s in free)
        over = [s for s in free if weight[s] * unit > most * sizes[s]]
        if not over:
            return out | {s: weight[s] * unit for s in free}
        for s in over:
            out[s] = most * sizes[s]
            budget -= out[s]
        free = [s for s in free if s not in out]
    return out


def even_share(counts: dict[int, int], budget: int) -> dict[int, int]:
    """Of each length its share of the budget; what rounding leaves is carried on to the next shorter length."""
    total, taken, ideal, real = sum(n * c for n, c in counts.items()), {}, 0, 0
    for n in sorted(counts, reverse=True):
        ideal += n * counts[n] * budget  # in parts of the total
        taken[n] = min(counts[n], max(0, (2 * (ideal - real * total) + n * total) // (2 * n * total)))
        real += n * taken[n]
    return taken


def fit_budget(counts: dict[int, int], budget: int) -> dict[int, int]:
    """How many documents of each length to take so that lengths sum up to the budget, or just under it."""
    counts = {n: c for n, c in counts.items() if n > 0 and c > 0}
    if budget >= sum(n * c for n, c in counts.items()):
        return counts
    taken = even_share(counts, max(0, budget - 2 * max(counts)))
    left = budget - sum(n * c for n, c in taken.items())
    # Bit s of a set: sum s can be reached; a length's count in powers of two.
    sets, choices, full = [1], [], (1 << (left + 1)) - 1
    for n in sorted(counts):
        spare, power = min(counts[n] - taken[n], left // n), 1
        while spare > 0 and not sets[-1] >> left & 1:
            part = min(power, spare)
            choices.append((n, part))
            sets.append((sets[-1] | sets[-1] << n * part) & full)
            spare, power = spare - part, 2 * power
    reached = sets[-1].bit_length() - 1
    for k in range(len(choices) - 1, -1, -1):
        n, part = choices[k]
        if not sets[k] >> reached & 1:
            taken[n] += part
            reached -= n * part
    return taken


ALLOCATED = "source_key string, size long, times long, extra long, source_size long, target double"


def _allocate(most: int):
    def run(lengths: pd.DataFrame) -> pd.DataFrame:
        goal, size = lengths["target"].iloc[0], lengths["source_size"].iloc[0]
        times = min(most, int(goal // size)) if size else 0
        rest = fit_budget(dict(zip(lengths["size"].tolist(), lengths["n"].tolist(), strict=True)), int(goal - times * size)) if times < most else {}
        out = lengths[["source_key", "size", "source_size", "target"]].assign(times=times)
        return out.assign(extra=[rest.get(n, 0) for n in lengths["size"].tolist()])[["source_key", "size", "times", "extra", "source_size", "target"]]

    return run


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, most: int = 2, seed: int = 11) -> DataFrame:
    """All rows with size, source_size, target (the source's), taken (words) and copies.

    The sources' sizes, one row each, come to the driver.
    """
    spark = docs.sparkSession
    ship_package(spark)
    own = [f"c{k}" for k in range(len(docs.columns))]
    doc_id, source, text = (F.col(own[docs.columns.index(c)]) for c in ("doc_id", "source", "text"))
    draw = F.xxhash64(F.lit(seed), doc_id, text)
    rows = docs.toDF(*own).select(*own, word_count(text).alias("size"), F.coalesce(F.concat(F.lit("s"), source), F.lit("n")).alias("source_key"), draw.alias("draw"))
    rows = rows.withColumn("salt", F.pmod(F.shiftrightunsigned("draw", 40), F.lit(SALTS)).cast("int"))
    keys = ["source_key", "size", "salt"]
    salted = rows.groupBy(*keys).agg(F.count("*").alias("n"))
    sizes = {r[0]: r[1] for r in salted.groupBy("source_key").agg(F.sum(F.col("size") * F.col("n"))).collect()}
    real = {k: None if k == "n" else k[1:] for k in sizes}
    goal = targets({real[k]: v for k, v in sizes.items()}, weights, share, float(most))
    wanted = spark.createDataFrame([(k, int(v), float(goal[real[k]])) for k, v in sizes.items()], "source_key string, source_size long, target double")
    lengths = salted.groupBy("source_key", "size").agg(F.sum("n").alias("n")).join(wanted, "source_key")
    allocated = lengths.groupBy("source_key").applyInPandas(_allocate(most), ALLOCATED)
    before = F.coalesce(F.sum("n").over(Window.partitionBy("source_key", "size").orderBy("salt").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    limits = salted.select(*keys, before.alias("before")).join(allocated, ["source_key", "size"])
    limits = limits.select(*keys, "times", (F.col("extra") - F.col("before")).alias("extra"), "source_size", "target")
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("draw", doc_id))
    copies = F.when(F.col("size") > 0, F.col("times") + (rank <= F.col("extra")).cast("long")).otherwise(F.lit(0))
    out = rows.join(limits, keys).withColumn("copies", copies)
    kept = [F.col(c).alias(name) for c, name in zip(own, docs.columns, strict=True) if name not in ADDED]
    return out.select(*kept, "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"), "copies")

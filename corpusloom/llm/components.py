"""Connected components of a graph that is too large for one machine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corpusloom.runtime import materialise


def connected_components(edges: DataFrame) -> DataFrame:
    """``node`` and ``root`` (the smallest node of its component) for edges ``a``, ``b``.

    Each round hooks every node to its least neighbour, follows the hooks twice and
    contracts the graph; what remains shrinks by a factor a round, even for paths.
    Rounds are cut by tables in the shared folder.  Nodes without edges don't occur.
    """
    edges = materialise(edges.filter("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        hook = materialise(both.groupBy("a").agg(F.min("b").alias("b")).select("a", F.least("a", "b").alias("r")), "hook")
        over = hook.select(F.col("a").alias("r"), F.col("r").alias("r2"))
        jumped = materialise(hook.join(over, "r").select("a", F.col("r2").alias("r")), "hook")
        over = jumped.select(F.col("a").alias("r"), F.col("r").alias("r2"))
        hook = materialise(jumped.join(over, "r").select("a", F.col("r2").alias("r")), "hook")
        hooks.append(hook)
        left, right = hook.select("a", F.col("r").alias("ra")), hook.select(F.col("a").alias("b"), F.col("r").alias("rb"))
        moved = edges.join(left, "a").join(right, "b").filter("ra != rb")
        edges = materialise(moved.select(F.greatest("ra", "rb").alias("a"), F.least("ra", "rb").alias("b")).distinct(), "edges")
    if not hooks:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    out = hooks[0].select(F.col("a").alias("node"), F.col("r").alias("root"))
    for hook in hooks[1:]:
        over = hook.select(F.col("a").alias("root"), F.col("r").alias("further"))
        out = out.join(over, "root", "left").select("node", F.coalesce("further", "root").alias("root"))
    return out

"""Report grades, warnings, and checks that a corpus is whole."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The least score of each grade, best first.
GRADES = {"Excellent": 0.7, "Good": 0.5, "Fair": 0.3}
WORST = "Needs Improvement"


def grade(c: Column) -> Column:
    """Null for a null score."""
    out = F.when(c.isNotNull(), F.lit(WORST))
    for name, least in reversed(GRADES.items()):
        out = F.when(c >= least, F.lit(name)).otherwise(out)
    return out


def sample_warnings(samples: DataFrame) -> DataFrame:
    """What the samples (retrieved_ids, relevant_ids, generated_answer) cannot give: measure, scorable, total, warning.

    One row a measure with samples missing; without any samples both measures warn.
    """
    filled = lambda c: F.coalesce(F.size(c), F.lit(0)) > 0
    n = samples.agg(F.count("*").alias("total"), F.count_if(filled("retrieved_ids") & filled("relevant_ids")).alias("retrieval"), F.count_if(F.col("generated_answer") != "").alias("answers"))
    rows = n.select("total", F.explode(F.create_map(F.lit("retrieval"), F.col("retrieval"), F.lit("answers"), F.col("answers"))).alias("measure", "scorable"))
    text = F.when(F.col("scorable") == 0, F.concat(F.lit("no sample can be scored for "), "measure")).otherwise(F.format_string("%s covers %d of %d samples", "measure", "scorable", "total"))
    return rows.filter("scorable = 0 or scorable < total").select("measure", "scorable", "total", text.alias("warning"))


def integrity(requested: DataFrame, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> DataFrame:
    """One row a check (name, expected, found, ok): papers asked for are stored, nothing else is, a vector a chunk."""
    count = lambda df, name: df.agg(F.count("*").alias(name))
    asked = requested.select("document_id").distinct()
    stored = documents.select("document_id").distinct()
    n = count(asked, "asked").join(count(asked.join(stored, "document_id", "left_semi"), "ingested")).join(count(documents, "stored")).join(count(chunks, "chunks")).join(count(vectors, "vectors"))
    check = lambda name, expected, found: F.struct(F.lit(name).alias("name"), F.col(expected).alias("expected"), F.col(found).alias("found"))
    rows = n.select(F.inline(F.array(check("papers_ingested", "asked", "ingested"), check("documents_stored", "asked", "stored"), check("vectors_stored", "chunks", "vectors"))))
    return rows.withColumn("ok", F.col("expected") == F.col("found"))


def reset_tenant(user_id: str, documents: DataFrame, chunks: DataFrame, vectors: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The tables without a tenant's rows: chunks and vectors go by document and by tenant, orphans included.

    Rows of a null tenant stay.
    """
    own = documents.filter(F.col("user_id") == user_id).select("document_id").distinct()
    others = lambda df: df.filter(~F.col("user_id").eqNullSafe(F.lit(user_id)))
    return others(documents), others(chunks).join(own, "document_id", "left_anti"), others(vectors).join(own, "document_id", "left_anti")


def check_reset(user_id: str, *tables: DataFrame) -> None:
    """An error if any table still holds a row of the tenant."""
    left = sum(t.filter(F.col("user_id") == user_id).limit(1).count() for t in tables)
    if left:
        raise RuntimeError(f"{left} tables still hold rows of {user_id}")

"""Evidence paragraphs against the chunks that hold them."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.functions.answers import coverage
from corpusloom.functions.preprocess import evidence_normal
from corpusloom.operators.retrieval import top_k
from corpusloom.runtime import ship_package

# Shares of the longest common run at which a chunk counts, and at which the best one does.
COVERED, FALLBACK = 0.5, 0.3
#: Bytes of passages that are searched for in one pass over the texts.
BLOCK_BYTES = 16 << 20


def containing(passages: DataFrame, texts: DataFrame) -> DataFrame:
    """item_id and doc_id of passages (item_id, passage) that texts (doc_id, body) hold.

    The passages go out in blocks of bounded size as one automaton each, which goes over a
    text once whatever their number.  Empty passages are nowhere.
    """
    spark = texts.sparkSession
    ship_package(spark)
    asked = passages.select("item_id", "passage").filter(F.length("passage") > 0)
    size = asked.agg(F.sum(F.octet_length("passage"))).first()[0] or 0
    n, out = max(1, -(-size // BLOCK_BYTES)), None
    ddl = f"item_id {asked.schema['item_id'].dataType.simpleString()}, doc_id {texts.schema['doc_id'].dataType.simpleString()}"
    for b in range(n):
        own = asked if n == 1 else asked.filter(F.pmod(F.xxhash64("passage"), F.lit(n)) == b)
        by_text: dict[str, list] = {}
        for r in own.collect():
            by_text.setdefault(r.passage, []).append(r.item_id)
        block = spark.sparkContext.broadcast(by_text)

        def run(parts, block=block):
            import ahocorasick

            search = ahocorasick.Automaton()
            for passage, ids in block.value.items():
                search.add_word(passage, ids)
            search.make_automaton()
            for pdf in parts:
                rows = [(item, doc) for doc, body in zip(pdf["doc_id"], pdf["body"], strict=True) if body and block.value for item in {i for _, ids in search.iter(body) for i in ids}]
                yield pd.DataFrame(rows, columns=["item_id", "doc_id"])

        one = texts.select("doc_id", "body").mapInPandas(run, ddl)
        out = one if out is None else out.unionByName(one)
    return out


def ground(evidence: DataFrame, chunks: DataFrame, by: list[str]) -> DataFrame:
    """item_id, chunk_id and how ("contained", "covered", "best") for evidence (item_id, text) and chunks (chunk_id, text) of one paper.

    ``by`` names the columns that tell papers apart.  Where no chunk holds the paragraph in
    normal form, chunks count that share a run of tokens of half of either side, else the
    one with the largest share of the paragraph (ties to the smaller id), from 0.3 on.
    """
    items = evidence.select("item_id", *by, evidence_normal(F.col("text")).alias("passage")).filter("passage != ''")
    pairs = items.join(chunks.select("chunk_id", *by, evidence_normal(F.col("text")).alias("body")), by)
    held = pairs.filter(F.col("body").contains(F.col("passage"))).select("item_id", "chunk_id", F.lit("contained").alias("how"))
    words = lambda c: F.split(F.col(c), " ")
    rest = pairs.join(held.select("item_id").distinct(), "item_id", "left_anti").select("item_id", "chunk_id", coverage(words("passage"), words("body")).alias("c"))
    covered = rest.filter((F.col("c.of_evidence") >= COVERED) | (F.col("c.of_chunk") >= COVERED)).select("item_id", "chunk_id", F.lit("covered").alias("how"))
    left = rest.join(covered.select("item_id").distinct(), "item_id", "left_anti").filter(F.col("c.of_evidence") >= FALLBACK)
    best = top_k(left, 1, F.desc("c.of_evidence"), F.asc("chunk_id"), by="item_id").select("item_id", "chunk_id", F.lit("best").alias("how"))
    return held.unionByName(covered).unionByName(best)


def evidence_paragraphs(paragraphs: DataFrame, hits: DataFrame, score: Column, k: int = 2, top: int = 3, least: int = 20, normal: Callable[[Column], Column] = evidence_normal) -> DataFrame:
    """Each question's paragraphs that stand in its ``top`` best chunks, the best ``k`` by ``score``.

    paragraphs: query_id, place, text, and what ``score`` names; hits: query_id, rank, text.
    Texts are measured and compared in the form that ``normal`` gives them.
    """
    asked = paragraphs.withColumn("normal", normal(F.col("text"))).filter(F.length("normal") > least)
    near = hits.filter(F.col("rank") <= top).select("query_id", normal(F.col("text")).alias("chunk"))
    found = asked.join(near, "query_id").filter(F.col("chunk").contains(F.col("normal"))).drop("chunk", "normal").dropDuplicates(["query_id", "place"])
    return top_k(found.withColumn("score", score), k, F.desc("score"), F.asc("place")).select("query_id", "place", "text", "score", "rank")


def other_evidence(claims: DataFrame, seed: int = 7) -> DataFrame:
    """For each claim (paper_id, question_id, evidence) another question of its paper with no evidence in common, drawn by hash."""
    other = claims.select("paper_id", F.col("question_id").alias("other_id"), F.col("evidence").alias("other"))
    pairs = claims.join(other, "paper_id").filter((F.col("question_id") != F.col("other_id")) & ~F.arrays_overlap("evidence", "other"))
    drawn = pairs.groupBy("paper_id", "question_id").agg(F.min_by(F.struct("other_id", "other"), F.struct(F.md5(F.concat_ws("|", F.lit(seed), "question_id", "other_id").cast("binary")), F.col("other_id"))).alias("o"))
    return drawn.select("paper_id", "question_id", "o.other_id", F.col("o.other").alias("other_evidence"))

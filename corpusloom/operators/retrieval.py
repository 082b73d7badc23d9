"""BM25, vector search, fusion, widening and reranking over tables of queries."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.text import tokens
from corpusloom.operators.filters import apply_filters
from corpusloom.runtime import materialise, ship_package

K1, B, EPSILON = 1.5, 0.75, 0.25
RRF_K, VECTOR_WEIGHT, BM25_WEIGHT = 60, 0.7, 0.3
#: Query terms that are broadcast at most; more are joined by an exchange.
MOST_BROADCAST = 500_000
#: Queries of a vector search that are scored in one pass, about.
BLOCK_QUERIES = 4096


@dataclass
class Bm25Index:
    """What BM25 knows of a corpus: ``terms`` (term, df, idf), the number of chunks and their mean length."""

    terms: DataFrame
    n_docs: int
    avgdl: float


def bm25_index(chunks: DataFrame) -> Bm25Index:
    """One pass over the texts; a negative idf becomes a share of the vocabulary's mean.

    A chunk without text has length 0.
    """
    words = chunks.select(F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("words"))
    # The empty term, which no text has, counts the chunks and their lengths.
    each = words.select(F.size("words").alias("dl"), F.explode(F.array_append(F.array_distinct("words"), F.lit(""))).alias("term"))
    counted = materialise(each.groupBy("term").agg(F.count("*").alias("df"), F.sum(F.when(F.col("term") == "", F.col("dl"))).alias("total")), "bm25-terms")
    whole = counted.filter("term = ''").first()
    n, total = (whole.df, whole.total) if whole else (0, 0)
    raw = F.log(F.lit(n) - F.col("df") + 0.5) - F.log(F.col("df") + 0.5)
    terms = counted.filter("term != ''").select("term", "df", raw.alias("raw"))
    mean = terms.agg(F.avg("raw")).first()[0]
    idf = F.when(F.col("raw") < 0, F.lit(EPSILON * (mean or 0.0))).otherwise(F.col("raw"))
    return Bm25Index(terms.select("term", "df", idf.alias("idf")), n, total / n if n else math.nan)


def corpus_stats(chunks: DataFrame) -> DataFrame:
    """One row with the number of chunks and their mean length."""
    return chunks.agg(F.count("*").alias("n_docs"), F.avg(F.size(tokens(F.col("text")))).alias("avgdl"))


def idf(chunks: DataFrame) -> DataFrame:
    """Term, df, idf."""
    return bm25_index(chunks).terms


def top_k(df: DataFrame, k: int, *order: Column, by: str = "query_id", rank: str = "rank") -> DataFrame:
    """The k first rows of each query, ranked from 1."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(by).orderBy(*order))).filter(F.col(rank) <= k)


def steady_sum(c: Column) -> Column:
    """The sum of numbers that does not depend on their order, so that equal parts give equal sums.

    Whole parts (exact up to 2**53) and fractions, kept to 2**-40 each, are summed apart.
    """
    return F.sum(F.floor(c).cast("double")) + F.sum(F.rint((c - F.floor(c)) * 2.0**40).cast("long")) / 2.0**40


def bm25_scores(queries: DataFrame, chunks: DataFrame, index: Bm25Index, keep: tuple[str, ...] = ()) -> DataFrame:
    """query_id, chunk_id, score of all pairs that score over 0, with columns ``keep`` of the chunk.

    Chunks are dealt out by their id once; terms, scores and a later cut need no other exchange
    of them.  The queries' terms, whose number is checked, are broadcast.  Chunks with the same
    words score the same, whatever the order of the words or of the exchange.
    """
    asked = queries.select("query_id", F.explode(tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("times"))
    weighted = materialise(asked.join(index.terms.select("term", "idf"), "term").select("query_id", "term", (F.col("times") * F.col("idf")).alias("weight")), "bm25-asked")
    terms = weighted.select("term").distinct()
    small = weighted.count() <= MOST_BROADCAST
    near = F.broadcast if small else (lambda df: df)
    dealt = chunks.select("chunk_id", *keep, "text").repartition("chunk_id") if small else chunks.select("chunk_id", *keep, "text")
    parts = dealt.select("chunk_id", *keep, tokens(F.col("text")).alias("words"))
    parts = parts.select("chunk_id", *keep, F.size("words").alias("dl"), F.explode("words").alias("term")).join(near(terms), "term", "left_semi")
    hits = parts.groupBy("chunk_id", *keep, "dl", "term").agg(F.count("*").alias("tf"))
    part = F.col("weight") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(index.avgdl)))
    return hits.join(near(weighted), "term").groupBy("query_id", "chunk_id", *keep).agg(steady_sum(part).alias("score")).filter("score > 0")


def cut(scored: DataFrame, k: int) -> DataFrame:
    """The k best of each query; ties in the order of the chunks."""
    return top_k(scored, k, F.desc(F.round("score", 9)), F.asc("chunk_id")).select("query_id", "chunk_id", "score", "rank")


def bm25(queries: DataFrame, chunks: DataFrame, k: int = 10, filters: dict | None = None, index: Bm25Index | None = None) -> DataFrame:
    """query_id, chunk_id, score, rank.

    Statistics come from all chunks; the filter comes before the cut.
    """
    index = index or bm25_index(chunks)
    return cut(bm25_scores(queries, apply_filters(chunks, filters), index), k)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def similarity(a: Column, b: Column) -> Column:
    """Cosine of two unit vectors, clipped to 0 and 1."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), dot(a, b)))


def matrix(vectors: pa.Array, length: int) -> tuple[np.ndarray, np.ndarray]:
    """The rows whose vector has this length and no null, and these vectors."""
    sizes = pc.fill_null(pc.list_value_length(vectors), -1).to_numpy(zero_copy_only=False)
    rows = np.flatnonzero(sizes == length)
    taken = vectors.take(pa.array(rows))
    flat = taken.flatten()
    if flat.null_count:
        whole = np.array([not v.values.null_count for v in taken], bool)
        rows, flat = rows[whole], taken.filter(pa.array(whole)).flatten()
    return rows, flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(rows), length)


def _units(x: np.ndarray) -> np.ndarray:
    norms = np.sqrt(np.einsum("ij,ij->i", x, x))
    return x / np.where(norms > 0, norms, np.nan)[:, None]


def product(vectors: np.ndarray, queries: np.ndarray, metric: str) -> np.ndarray:
    """Scores of vectors (rows) and queries (columns); not a number where a cosine has no direction."""
    if metric == "dot":
        return vectors @ queries.T
    if metric == "euclidean":
        square = np.einsum("ij,ij->i", vectors, vectors)[:, None] + np.einsum("ij,ij->i", queries, queries)
        out = np.sqrt(np.maximum(square - 2 * (vectors @ queries.T), 0))
        close = np.argwhere(out < 1e-3 * np.sqrt(square) + 1e-9)  # where the difference of squares is not exact
        out[close[:, 0], close[:, 1]] = np.linalg.norm(vectors[close[:, 0]] - queries[close[:, 1]], axis=1)
        return -out
    return _units(vectors) @ _units(queries).T


def _search(blocks, k: int, threshold: float | None, metric: str, schema: pa.Schema):
    """For mapInArrow over (chunk_id, embedding): each task's k best of every query of a block."""

    def run(batches):
        best: dict[int, pa.Table] = {}
        for batch in batches:
            for length, (ids, queries) in blocks.value.items():
                rows, vectors = matrix(batch.column(1), length)
                if not len(rows):
                    continue
                score = product(vectors, queries, metric)
                score[~np.isfinite(score)] = -np.inf
                if threshold is not None:
                    score[score < threshold] = -np.inf
                order = np.round(score, 9)
                least = np.partition(order, max(0, len(rows) - k), axis=0)[max(0, len(rows) - k)]
                at, query = np.nonzero((order >= least) & np.isfinite(order))
                found = pa.table([ids.take(pa.array(query)), batch.column(0).take(pa.array(rows[at])), pa.array(score[at, query]), pa.array(query), pa.array(order[at, query])], names=[*schema.names, "query", "order"])
                both = pa.concat_tables([best[length], found]) if length in best else found
                both = both.sort_by([("query", "ascending"), ("order", "descending"), ("chunk_id", "ascending")])
                own = both.column("query").to_numpy()
                first = np.searchsorted(own, own)
                best[length] = both.filter(pa.array(np.arange(len(own)) - first < k))
        for table in best.values():
            yield from table.select(schema.names).cast(schema).combine_chunks().to_batches()

    return run


def vector_search(queries: DataFrame, vectors: DataFrame, k: int = 10, filters: dict | None = None, threshold: float | None = None, metric: str = "cosine") -> DataFrame:
    """Exact search of queries (query_id, query) over vectors (chunk_id, embedding).

    The filter comes first.  Queries go out in blocks of about ``BLOCK_QUERIES``; a block
    is one matrix product a batch of vectors, and only a task's k best of each query travel.
    Vectors that are null, hold a null, have another length or, for a cosine, no direction
    take no part.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    kept = apply_filters(vectors, filters).select("chunk_id", "embedding")
    asked = queries.select("query_id", "query")
    types = {"query_id": asked.schema["query_id"].dataType, "chunk_id": kept.schema["chunk_id"].dataType}
    ddl = f"query_id {types['query_id'].simpleString()}, chunk_id {types['chunk_id'].simpleString()}, score double"
    schema = spark.createDataFrame([], ddl).toArrow().schema
    n, found = max(1, -(-asked.count() // BLOCK_QUERIES)), None
    for b in range(n):
        own = asked.filter(F.pmod(F.xxhash64("query_id"), F.lit(n)) == b) if n > 1 else asked
        table = own.toArrow().combine_chunks()
        ids, column = (table.column(c).combine_chunks() if table.num_rows else pa.array([], table.schema.types[c]) for c in (0, 1))
        block = {}
        for length in pc.unique(pc.drop_null(pc.list_value_length(column))).to_pylist():
            rows, x = matrix(column, length)
            if length and len(rows):
                block[length] = ids.take(pa.array(rows)), x
        one = kept.mapInArrow(_search(spark.sparkContext.broadcast(block), k, threshold, metric, schema), ddl)
        found = one if found is None else found.unionByName(one)
    return cut(found, k)


def search_document(queries: DataFrame, vectors: DataFrame, document_id, k: int = 10, **options) -> DataFrame:
    """The same within one document."""
    return vector_search(queries, vectors, k, filters={**(options.pop("filters", None) or {}), "document_id": document_id}, **options)


def fuse(vector: DataFrame, lexical: DataFrame, k: int = 10) -> DataFrame:
    """Weighted reciprocal rank fusion.

    A query that only one side answered keeps that side's raw scores.
    """
    v = vector.select("query_id", "chunk_id", F.col("score").alias("vector_score"), F.col("rank").alias("vector_rank"))
    b = lexical.select("query_id", "chunk_id", F.col("score").alias("bm25_score"), F.col("rank").alias("bm25_rank"))
    both = v.join(b, ["query_id", "chunk_id"], "full_outer")
    side = Window.partitionBy("query_id")
    has = lambda c: F.count(c).over(side) > 0
    rrf = F.coalesce(F.lit(VECTOR_WEIGHT) / (RRF_K + F.col("vector_rank")), F.lit(0.0)) + F.coalesce(F.lit(BM25_WEIGHT) / (RRF_K + F.col("bm25_rank")), F.lit(0.0))
    score = F.when(has("vector_rank") & has("bm25_rank"), rrf).when(has("vector_rank"), F.col("vector_score")).otherwise(F.col("bm25_score"))
    return top_k(both.withColumn("score", score), k, F.desc(F.round("score", 12)), F.asc_nulls_last("vector_rank"), F.asc_nulls_last("bm25_rank"))


def widen(narrow: DataFrame, wide: DataFrame, least: int, k: int = 10) -> DataFrame:
    """Queries with fewer than ``least`` filtered hits get unfiltered ones behind them."""
    counts = narrow.groupBy("query_id").agg(F.count("*").alias("n"))
    extra = wide.join(narrow.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti").join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < least).drop("n")
    blocks = narrow.withColumn("block", F.lit(0)).unionByName(extra.withColumn("block", F.lit(1))).withColumnRenamed("rank", "old_rank")
    return top_k(blocks, k, F.asc("block"), F.asc("old_rank")).select("query_id", "chunk_id", "score", "block", "rank")


def rerank(hits: DataFrame, scores: Column, k: int = 10) -> DataFrame:
    """Order by a new score; rank_change is positive for hits that move up."""
    moved = hits.withColumn("rerank_score", scores).withColumnRenamed("rank", "old_rank")
    return top_k(moved, k, F.desc(F.round("rerank_score", 9)), F.asc("old_rank")).withColumn("rank_change", F.col("old_rank") - F.col("rank"))


def score_distribution(reranked: DataFrame) -> DataFrame:
    """A17."""
    return reranked.agg(F.count("*").alias("n"), F.min("rerank_score").alias("min_rerank"), F.max("rerank_score").alias("max_rerank"), F.avg("rerank_score").alias("mean_rerank"), F.max("rank_change").alias("max_up"), F.min("rank_change").alias("max_down"), F.avg(F.abs("rank_change")).alias("mean_abs_change"))

"""Registered queries of the retrieval pipeline, with the SQL that gives the same rows.

Chunks are the documents with the vectors of the same ids; questions are the benchmark's
passages with every fiftieth vector.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from corpusloom.operators import benchmark as M
from corpusloom.operators import evaluation as E
from corpusloom.operators import pipeline as P
from corpusloom.operators import retrieval as R
from corpusloom.plans.retrieval import _BM25, _EVIDENCE, _cut, _msql, bm25_index_of, ground_evidence

_t = lambda spark, sf, name: spark.read.parquet(f"{sf}/{name}.parquet")
MODES = ("fast", "balanced", "accurate")
SECTIONS = ("results", "methodology", "abstract", "other")


def _chunks(spark, sf):
    vectors = _t(spark, sf, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    docs = _t(spark, sf, "documents").join(vectors, "doc_id", "left")
    section = F.get(F.array(*map(F.lit, SECTIONS)), (F.col("doc_id") % 4).cast("int"))
    return docs.select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("document_id"), "text", "embedding", (2015 + F.col("doc_id") % 10).cast("int").alias("year"), section.alias("section_type"))


def _questions(spark, sf):
    vectors = _t(spark, sf, "embeddings").filter("vec_id % 50 = 0").select(F.expr("vec_id div 50").alias("query_id"), F.col("embedding").alias("query"))
    return _t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").join(vectors, "query_id")


def hybrid_search(spark, sf):
    hits = P.hybrid_search(_questions(spark, sf), _chunks(spark, sf), 10, bm25_index_of(spark, sf))
    return hits.select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def rrf_one_sided(spark, sf):
    """Questions that one side or the other leaves out keep the other's scores."""
    q, c = _questions(spark, sf), _chunks(spark, sf)
    vector = R.vector_search(q.filter("query_id % 3 != 0"), c.filter("embedding is not null"), 20)
    lexical = R.bm25(q.filter("query_id % 3 != 1"), c, 20, index=bm25_index_of(spark, sf))
    return R.fuse(vector, lexical).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _mode(spark, sf, mode, k=5, questions=None):
    return P.retrieve(questions or _questions(spark, sf), _chunks(spark, sf), k, P.Settings.of_mode(mode), index=bm25_index_of(spark, sf))


def retrieval_modes(spark, sf):
    out = None
    for mode in MODES:
        hits = _mode(spark, sf, mode).select(F.lit(mode).alias("mode"), "query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), F.array_join("stages", "+").alias("stages"))
        out = hits if out is None else out.unionByName(hits)
    return out


def _dated(spark, sf):
    """Questions of which some name a year, or years."""
    said = F.when(F.col("query_id") % 3 == 0, F.concat("text", F.lit(" in 2021"))).when(F.col("query_id") % 3 == 1, F.concat("text", F.lit(" from 2018 to 2020"))).otherwise(F.col("text"))
    return _questions(spark, sf).withColumn("text", said)


def inferred_filters(spark, sf):
    """Filters that the question states come first, what they leave out behind."""
    hits = P.retrieve(_dated(spark, sf), _chunks(spark, sf), 150, P.Settings.of_mode("balanced", candidates=None), index=bm25_index_of(spark, sf))
    return hits.select("query_id", "chunk_id", "rank", F.round("score", 6).alias("score"), "widened")


def document_search(spark, sf):
    found = R.search_document(_questions(spark, sf), _chunks(spark, sf), "src1", 5)
    return found.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


def _arm_metrics(spark, sf, mode, truth):
    return E.ranking_metrics(_mode(spark, sf, mode, 10), truth)


def _truth(spark, sf):
    """What a question's passage is contained in, and the chunks nearest to it in number."""
    near = _questions(spark, sf).select("query_id", F.explode(F.sequence(F.col("query_id") * 50 + 1, F.col("query_id") * 50 + 3)).alias("chunk_id"))
    held = ground_evidence(spark, sf).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id")).join(_questions(spark, sf).select("query_id"), "query_id", "left_semi")
    return held.unionByName(near).distinct()


def ablation_ladder(spark, sf):
    """Vectors alone, with the lexical side, with reranking; and what each gains on the first."""
    truth = _truth(spark, sf)
    arms = {arm: _arm_metrics(spark, sf, mode, truth).agg(F.avg("rr").alias("mrr"), F.avg("ndcg10").alias("ndcg10")) for arm, mode in (("vector", "fast"), ("hybrid", "balanced"), ("hybrid_rerank", "accurate"))}
    out = M.ladder(arms)
    return out.select("arm", "place", *[F.round(c, 6).alias(c) for c in ("mrr", "ndcg10", "mrr_delta", "ndcg10_delta")])


def retrieval_means(spark, sf):
    """M6: means over questions with results, and over all; a filter leaves some without."""
    truth = ground_evidence(spark, sf).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))
    chunks = _t(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "source")
    hits = R.bm25(_t(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text").filter("query_id % 4 != 0"), chunks, 10, {"source": ["src1", "src2", "src3"]}, bm25_index_of(spark, sf))
    means = M.retrieval_means(E.ranking_metrics(hits, truth).select("query_id", "rr", "ndcg10"), hits)
    return means.select("n_answered", "n", *[F.round(c, 6).alias(c) for c in ("rr_answered", "ndcg10_answered", "rr_all", "ndcg10_all")])


QUERIES = {f.__name__: f for f in (hybrid_search, rrf_one_sided, retrieval_modes, inferred_filters, document_search, ablation_ladder, retrieval_means)}

# ---- SQL ----
_ASKED = "SELECT item_id AS query_id, text, embedding AS query FROM benchmark JOIN embeddings ON vec_id = item_id * 50"


def _lexical(asked: str, where: str = "true") -> str:
    """BM25's CTEs over other questions (with columns query_id, text)."""
    own = _BM25.replace("SELECT item_id AS query_id, unnest", "SELECT query_id, unnest").replace("AS term FROM benchmark)", "AS term FROM asked)")
    assert "FROM asked)" in own
    return f"asked AS ({asked}), {own}"


_VEC = """ve AS (SELECT query_id, vec_id AS chunk_id, list_cosine_similarity(list_transform(embedding, lambda x: x::DOUBLE), list_transform(query, lambda x: x::DOUBLE)) AS score FROM embeddings JOIN documents ON doc_id = vec_id, asked)"""


def _top(name: str, source: str, k: int, where: str = "true") -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM {source} WHERE {where}) WHERE rank <= {k})"


def _fused(v: str, b: str, name: str, k: int) -> str:
    return f"""{name}_j AS (SELECT query_id, chunk_id, {v}.score AS vs, {b}.score AS bs, {v}.rank AS vr, {b}.rank AS br FROM {v} FULL OUTER JOIN {b} USING (query_id, chunk_id)),
{name}_n AS (SELECT *, count(vr) OVER (PARTITION BY query_id) AS nv, count(br) OVER (PARTITION BY query_id) AS nb FROM {name}_j),
{name}_s AS (SELECT query_id, chunk_id, vr, br, CASE WHEN nv > 0 AND nb > 0 THEN coalesce(0.7 / (60 + vr), 0) + coalesce(0.3 / (60 + br), 0) WHEN nv > 0 THEN vs ELSE bs END AS score FROM {name}_n),
{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vr ASC NULLS LAST, br ASC NULLS LAST) AS rank FROM {name}_s) WHERE rank <= {k})"""


def _both(k: int, name: str = "hy", v: str = "true", b: str = "true") -> str:
    return f"{_top('v_' + name, 've', 2 * k, v)}, {_top('b_' + name, 'scored', 2 * k, b)}, {_fused('v_' + name, 'b_' + name, name, k)}"


_TERMS = r"list_distinct(regexp_extract_all(lower({}), '[\p{{L}}\p{{N}}_]+'))"
_RERANK = f"""rr AS (SELECT hy.query_id, chunk_id, hy.rank AS old_rank, len(list_intersect({_TERMS.format('asked.text')}, {_TERMS.format('d.text')})) / len({_TERMS.format('asked.text')}) AS score FROM hy JOIN asked USING (query_id) JOIN documents d ON d.doc_id = chunk_id),
re AS (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, old_rank) AS rank FROM rr)"""
_OUT = "round(score, {0}) AS score, rank"
_DATED = f"SELECT query_id, text || CASE query_id % 3 WHEN 0 THEN ' in 2021' WHEN 1 THEN ' from 2018 to 2020' ELSE '' END AS text, query FROM ({_ASKED})"
_YEAR = "CASE query_id % 3 WHEN 0 THEN 2015 + chunk_id % 10 = 2021 WHEN 1 THEN 2015 + chunk_id % 10 BETWEEN 2018 AND 2020 ELSE true END"
_HELD = f"SELECT item_id AS query_id, doc_id AS chunk_id FROM ev JOIN asked ON item_id = query_id UNION SELECT query_id, query_id * 50 + unnest([1, 2, 3]) FROM asked"


def _ladder_arm(arm: str, place: int, hits: str) -> str:
    return f"SELECT '{arm}' AS arm, {place} AS place, * FROM (WITH {_lexical(_ASKED)}, {_VEC}, {_both(40)}, {_RERANK}, hits AS ({hits}), {_EVIDENCE}, {_msql(_HELD)} SELECT avg(rr) AS mrr, avg(ndcg10) AS ndcg10 FROM m)"


_VECTOR_HITS = "SELECT * FROM (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM ve) WHERE rank <= 10"

ORACLES = {
    "hybrid_search": f"WITH {_lexical(_ASKED)}, {_VEC}, {_both(10)} SELECT query_id, chunk_id, {_OUT.format(9)} FROM hy",
    "rrf_one_sided": f"WITH {_lexical(_ASKED)}, {_VEC}, {_top('v', 've', 20, 'query_id % 3 != 0')}, {_top('b', 'scored', 20, 'query_id % 3 != 1')}, {_fused('v', 'b', 'f', 10)} SELECT query_id, chunk_id, {_OUT.format(6)} FROM f",
    "retrieval_modes": f"""WITH {_lexical(_ASKED)}, {_VEC}, {_both(40)}, {_RERANK}, {_top('fa', 've', 5)}
SELECT 'fast' AS mode, query_id, chunk_id, rank, round(score, 6) AS score, 'vector_search' AS stages FROM fa UNION ALL
SELECT 'balanced', query_id, chunk_id, rank, round(score, 6), 'query_processing+hybrid_search' FROM hy WHERE rank <= 5 UNION ALL
SELECT 'accurate', query_id, chunk_id, rank, round(score, 6), 'query_processing+hybrid_search+reranking' FROM re WHERE rank <= 5""",
    "inferred_filters": f"""WITH {_lexical(_DATED)}, {_VEC}, {_both(600, 'na', _YEAR, _YEAR)}, {_both(600, 'wi')},
c AS (SELECT query_id, count(*) AS n FROM na GROUP BY query_id),
u AS (SELECT *, 0 AS block FROM na UNION ALL SELECT w.*, 1 FROM wi w ANTI JOIN na USING (query_id, chunk_id) LEFT JOIN c USING (query_id) WHERE query_id % 3 < 2 AND coalesce(n, 0) < 600)
SELECT query_id, chunk_id, rank, round(score, 6) AS score, block = 1 AS widened FROM (SELECT query_id, chunk_id, score, block, row_number() OVER (PARTITION BY query_id ORDER BY block, rank) AS rank FROM u) WHERE rank <= 150""",
    "document_search": f"WITH asked AS ({_ASKED}), {_VEC}, {_top('v', 've', 5, 'chunk_id IN (SELECT doc_id FROM documents WHERE source = ' + repr('src1') + ')')} SELECT query_id, chunk_id, {_OUT.format(6)} FROM v",
    "ablation_ladder": f"""WITH a AS ({_ladder_arm('vector', 0, _VECTOR_HITS)} UNION ALL {_ladder_arm('hybrid', 1, 'SELECT * FROM hy WHERE rank <= 10')} UNION ALL {_ladder_arm('hybrid_rerank', 2, 'SELECT * FROM re WHERE rank <= 10')})
SELECT a.arm, a.place, round(a.mrr, 6) AS mrr, round(a.ndcg10, 6) AS ndcg10, round(a.mrr - f.mrr, 6) AS mrr_delta, round(a.ndcg10 - f.ndcg10, 6) AS ndcg10_delta FROM a, (SELECT mrr, ndcg10 FROM a WHERE place = 0) f""",
    "retrieval_means": f"""WITH {_BM25}, {_cut('hits', "source IN ('src1', 'src2', 'src3') AND query_id % 4 != 0")}, {_EVIDENCE}, {_msql('SELECT item_id AS query_id, doc_id AS chunk_id FROM ev')},
n AS (SELECT m.*, query_id IN (SELECT query_id FROM hits) AS answered FROM m)
SELECT count(*) FILTER (answered) AS n_answered, count(*) AS n, round(avg(rr) FILTER (answered), 6) AS rr_answered, round(avg(ndcg10) FILTER (answered), 6) AS ndcg10_answered, round(avg(rr), 6) AS rr_all, round(avg(ndcg10), 6) AS ndcg10_all FROM n""",
}

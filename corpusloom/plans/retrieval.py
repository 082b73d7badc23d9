"""Registered retrieval and evaluation queries, with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.operators import evaluation as E
from corpusloom.operators import retrieval as R
from corpusloom.operators.filters import apply_filters, delete_by_filter
from corpusloom.operators.grounding import containing
from corpusloom.runtime import kept, state_of


#: Shifts which hard negative is drawn.
SEED = 20260827


def _table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _chunks(spark, sf):
    return _table(spark, sf, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source", "n_chars")


def _asked(spark, sf):
    return _table(spark, sf, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def _hits(df: DataFrame, *more: str) -> DataFrame:
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", *more)


def bm25_index_of(spark, sf):
    """The documents' index, built when it is first asked for, and again when their files change."""
    state = ("bm25", *state_of(_table(spark, sf, "documents")))
    if state not in kept:
        kept[state] = R.bm25_index(_chunks(spark, sf))
    return kept[state]


def _bm25(spark, sf, filters=None, k=10):
    return R.bm25(_asked(spark, sf), _chunks(spark, sf), k, filters, bm25_index_of(spark, sf))


def _vectors(spark, sf):
    return _table(spark, sf, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding", "label")


def _vector_queries(spark, sf):
    return _vectors(spark, sf).filter("chunk_id % 50 = 0").select(F.col("chunk_id").alias("query_id"), F.col("embedding").alias("query"))


def _vector(spark, sf, **options):
    return R.vector_search(_vector_queries(spark, sf), _vectors(spark, sf), **options)


def bm25_corpus_stats(spark, sf):
    index = bm25_index_of(spark, sf)
    return index.terms.agg(F.lit(index.n_docs).cast("long").alias("n_docs"), F.round(F.lit(index.avgdl), 6).alias("avgdl"), F.count("*").alias("vocabulary"))


def bm25_idf(spark, sf):
    return bm25_index_of(spark, sf).terms.select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_top10(spark, sf):
    return _hits(_bm25(spark, sf))


def bm25_top10_filtered(spark, sf):
    return _hits(_bm25(spark, sf, {"lang": "en", "n_chars": {"$gte": 500}}))


def vector_top10(spark, sf):
    return _hits(_vector(spark, sf))


def vector_top10_filtered(spark, sf):
    return _hits(_vector(spark, sf, filters={"label": [1, 2, 3]}))


def vector_threshold(spark, sf):
    return _hits(_vector(spark, sf, threshold=0.25))


def vector_euclidean(spark, sf):
    return _hits(_vector(spark, sf, metric="euclidean"))


def _ranked(spark, sf, keep: tuple[str, ...], *arms: tuple[dict | None, int]):
    """Several cuts of one scoring."""
    chunks = _chunks(spark, sf)
    scored = R.bm25_scores(_asked(spark, sf), chunks, bm25_index_of(spark, sf), keep)
    return [R.cut(apply_filters(scored, filters), k) for filters, k in arms]


def _sides(spark, sf):
    """Two rankings of the same chunks for fusion: English ones and long ones."""
    return _ranked(spark, sf, ("lang", "n_chars"), ({"lang": "en"}, 20), ({"n_chars": {"$gte": 1000}}, 20))


def rrf_fusion(spark, sf):
    return R.fuse(*_sides(spark, sf)).select("query_id", "chunk_id", F.round("score", 9).alias("score"), "rank")


def widened_search(spark, sf):
    narrow, wide = _ranked(spark, sf, ("source", "lang"), ({"source": "src1", "lang": ["de", "fr"]}, 10), (None, 10))
    return R.widen(narrow, wide, 10).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "block", "rank")


def rerank_change(spark, sf):
    hits = _bm25(spark, sf).join(_chunks(spark, sf).select("chunk_id", "n_chars"), "chunk_id")
    return R.rerank(hits, F.col("score") / F.log(F.col("n_chars") + 10.0)).select("query_id", "chunk_id", F.round("rerank_score", 6).alias("rerank_score"), "old_rank", "rank", "rank_change")


def rerank_distribution(spark, sf):
    hits = _bm25(spark, sf).join(_chunks(spark, sf).select("chunk_id", "n_chars"), "chunk_id")
    d = R.score_distribution(R.rerank(hits, F.col("score") / F.log(F.col("n_chars") + 10.0)))
    return d.select("n", *[F.round(c, 6).alias(c) for c in ("min_rerank", "max_rerank", "mean_rerank")], "max_up", "max_down", F.round("mean_abs_change", 6).alias("mean_abs_change"))


def _filtered(filters):
    return lambda spark, sf: apply_filters(_chunks(spark, sf), filters).select("chunk_id", "lang", "source", "n_chars")


def filter_delete(spark, sf):
    docs = _chunks(spark, sf).withColumn("lang", F.expr("nullif(lang, 'de')"))
    return delete_by_filter(docs, {"lang": "en"}).select("chunk_id", "lang")


def ground_evidence(spark, sf):
    """J6 by containment: evidence passages in normal form against documents in normal form."""
    normal = lambda c: F.trim(F.regexp_replace(F.lower(c), r"[ \t\n\r\f\x0B]+", " "))
    items = _table(spark, sf, "benchmark").select("item_id", normal("text").alias("passage"))
    return containing(items, _table(spark, sf, "documents").select("doc_id", normal("text").alias("body")))


def _metrics(spark, sf):
    truth = ground_evidence(spark, sf).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))
    return E.ranking_metrics(_bm25(spark, sf), truth)


METRICS = ("rr", "ap", "precision5", "recall5", "ndcg5", "precision10", "recall10", "ndcg10")


def retrieval_metrics(spark, sf):
    return _metrics(spark, sf).select("query_id", *[F.round(c, 6).alias(c) for c in METRICS])


def eval_summary(spark, sf):
    return _metrics(spark, sf).agg(F.count("*").alias("n"), *[F.round(F.avg(c), 6).alias(c) for c in METRICS])


def ablation_arms(spark, sf):
    """The same questions through several arms, by nearest labels."""
    truth = _vector_queries(spark, sf).select("query_id").join(_vectors(spark, sf).select(F.col("chunk_id").alias("query_id"), "label"), "query_id")
    truth = truth.join(_vectors(spark, sf).select("chunk_id", "label"), "label").filter("chunk_id != query_id")
    out = None
    for arm, options in {"cosine": {}, "euclidean": {"metric": "euclidean"}, "label_filter": {"filters": {"label": [0, 1, 2, 3, 4]}}}.items():
        m = E.ranking_metrics(_vector(spark, sf, **options), truth).agg(F.round(F.avg("rr"), 6).alias("mrr"), F.round(F.avg("ndcg10"), 6).alias("ndcg10")).withColumn("arm", F.lit(arm))
        out = m if out is None else out.unionByName(m)
    return out


def hard_negatives(spark, sf):
    """The second to fourth of the ranked chunks that are no evidence."""
    gold = ground_evidence(spark, sf).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))
    rest = _bm25(spark, sf, k=40).join(gold, ["query_id", "chunk_id"], "left_anti").withColumnRenamed("rank", "bm25_rank")
    return R.top_k(rest, 4, F.asc("bm25_rank")).filter("rank >= 2").select("query_id", "chunk_id", "rank")


def _scored(spark, sf):
    return _table(spark, sf, "labels").join(_table(spark, sf, "documents").select("doc_id", "n_chars"), "doc_id")


def roc_auc(spark, sf):
    return E.roc_auc(_scored(spark, sf).select(F.col("quality").alias("label"), F.col("n_chars").alias("score"))).select(F.round("auc", 6).alias("auc"))


def threshold_sweep(spark, sf):
    swept = E.threshold_sweep(_scored(spark, sf).select(F.col("quality").alias("supported"), F.least(F.lit(1.0), F.col("n_chars") / 4000.0).alias("score")))
    return swept.select("percent", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1", "supported_kept", "balanced_accuracy")])


def paired_bootstrap(spark, sf):
    truth = ground_evidence(spark, sf).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"))
    arms = _ranked(spark, sf, ("lang",), ({"lang": "en"}, 10), (None, 10))
    a, b = (E.ranking_metrics(h, truth).select("query_id", F.col("ndcg10").alias(n)) for n, h in zip("ab", arms, strict=True))
    return E.paired_bootstrap(E.aligned(a, b).withColumn("comparison", F.lit("english -> all")))


def training_pairs(spark, sf):
    """Each passage with each chunk that holds it, its hard negatives and the one that is drawn."""
    gold = ground_evidence(spark, sf).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("positive"))
    hard = hard_negatives(spark, sf).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "chunk_id"))).getField("chunk_id").alias("n"))
    paired = gold.join(hard, "query_id", "left").withColumn("n", F.coalesce("n", F.array().cast("array<bigint>")))
    drawn = F.get("n", ((F.col("query_id") + SEED) % F.greatest(F.size("n"), F.lit(1))).cast("int"))
    return paired.select("query_id", "positive", F.array_join("n", ",").alias("negatives"), drawn.alias("negative"))


def rerank_dev_samples(spark, sf):
    """The BM25 top 20 of every passage that some chunk holds, and which of them are positive."""
    gold = ground_evidence(spark, sf).select(F.col("item_id").alias("query_id"), F.col("doc_id").alias("chunk_id"), F.lit(True).alias("positive"))
    hits = _bm25(spark, sf, k=20).join(gold.select("query_id").distinct(), "query_id", "left_semi")
    return hits.join(gold, ["query_id", "chunk_id"], "left").select("query_id", "chunk_id", "rank", F.coalesce("positive", F.lit(False)).alias("positive"))


QUERIES = {
    **{f.__name__: f for f in (bm25_corpus_stats, bm25_idf, bm25_top10, bm25_top10_filtered, vector_top10, vector_top10_filtered, vector_threshold, vector_euclidean, rrf_fusion, widened_search, rerank_change, rerank_distribution, filter_delete, ground_evidence, retrieval_metrics, eval_summary, ablation_arms, hard_negatives, training_pairs, rerank_dev_samples, roc_auc, threshold_sweep, paired_bootstrap)},
    "filter_scalar": _filtered({"lang": "fr"}),
    "filter_any": _filtered({"source": ["src1", "src2"], "lang": []}),
    "filter_range": _filtered({"n_chars": {"$gt": 200, "$lte": 900, "$near": 5}}),
    "filter_missing": _filtered({"year": {"$gte": 2020}}),
}

# ---- SQL ----
TOKENS = r"regexp_extract_all(lower(text), '[\p{L}\p{N}_]+')"
_BM25 = rf"""
tok AS (SELECT doc_id AS chunk_id, lang, source, n_chars, unnest({TOKENS}) AS term FROM documents),
dl AS (SELECT doc_id AS chunk_id, len({TOKENS}) AS dl FROM documents),
st AS MATERIALIZED (SELECT count(*) AS n, avg(dl) AS avgdl FROM dl),
tf AS MATERIALIZED (SELECT chunk_id, lang, source, n_chars, term, count(*) AS tf FROM tok GROUP BY ALL),
raw AS MATERIALIZED (SELECT term, count(*) AS df, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM tf, st GROUP BY term),
mi AS MATERIALIZED (SELECT avg(raw) AS mean FROM raw),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * mean ELSE raw END AS idf FROM raw, mi),
q AS (SELECT query_id, term, count(*) AS times FROM (SELECT item_id AS query_id, unnest({TOKENS}) AS term FROM benchmark) GROUP BY ALL),
scored AS (SELECT query_id, chunk_id, any_value(lang) AS lang, any_value(source) AS source, any_value(n_chars) AS n_chars, sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) AS score FROM q JOIN idf USING (term) JOIN tf USING (term) JOIN dl USING (chunk_id), st GROUP BY query_id, chunk_id HAVING sum(times * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))) > 0)"""


def _cut(name: str, where: str = "true", k: int = 10) -> str:
    return f"{name} AS (SELECT * FROM (SELECT query_id, chunk_id, score, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, chunk_id) AS rank FROM scored WHERE {where}) WHERE rank <= {k})"


def _vsql(score: str, where: str = "true", k: int = 10) -> str:
    return f"""vq AS (SELECT vec_id AS query_id, list_transform(embedding, lambda x: x::DOUBLE) AS query FROM embeddings WHERE vec_id % 50 = 0),
vv AS (SELECT vec_id AS chunk_id, list_transform(embedding, lambda x: x::DOUBLE) AS e, label FROM embeddings),
scored AS (SELECT query_id, chunk_id, {score} AS score FROM vv, vq WHERE {where}), {_cut("hits", k=k)}"""


_COS = "list_cosine_similarity(e, query)"
_EVIDENCE = r"""ev AS (SELECT item_id, doc_id FROM (SELECT item_id, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS evidence FROM benchmark), (SELECT doc_id, trim(regexp_replace(lower(text), '[ \t\n\r\f\x0B]+', ' ', 'g')) AS body FROM documents) WHERE contains(body, evidence))"""


def _msql(truth: str) -> str:
    per = ", ".join(f"coalesce(count(*) FILTER (rank <= {k}), 0) / {k}.0 AS precision{k}, count(*) FILTER (rank <= {k}) / any_value(n)::DOUBLE AS recall{k}, coalesce(sum(1 / log2(rank + 1)) FILTER (rank <= {k}), 0) / any_value(ideal{k}) AS ndcg{k}" for k in (5, 10))
    ideal = ", ".join(f"list_sum(list_transform(range(1, least({k}, count(*)) + 1), lambda i: 1 / log2(i + 1))) AS ideal{k}" for k in (5, 10))
    return f"""truth AS ({truth}), sizes AS (SELECT query_id, count(*) AS n, {ideal} FROM truth GROUP BY query_id),
j AS (SELECT t.query_id, h.rank, row_number() OVER (PARTITION BY t.query_id ORDER BY h.rank) AS found FROM truth t JOIN hits h USING (query_id, chunk_id)),
m AS (SELECT s.query_id, coalesce(1.0 / min(rank), 0) AS rr, coalesce(sum(found / rank), 0) / any_value(n) AS ap, {per} FROM sizes s LEFT JOIN j USING (query_id) GROUP BY s.query_id)"""


_TRUTH = "SELECT item_id AS query_id, doc_id AS chunk_id FROM ev"
_LABELS = "SELECT a.vec_id AS query_id, b.vec_id AS chunk_id FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id != b.vec_id WHERE a.vec_id % 50 = 0"
_OUT = "SELECT query_id, chunk_id, round(score, 6) AS score, rank FROM hits"
_EUCLID = "-list_distance(e, query)"


def _rank(names) -> str:
    return ", ".join(f"round({c}, 6) AS {c}" for c in names)


_RERANK = f"""WITH {_BM25}, {_cut("hits")}, r AS (SELECT query_id, chunk_id, score / ln(n_chars + 10.0) AS rerank_score, rank AS old_rank FROM hits JOIN (SELECT doc_id AS chunk_id, n_chars FROM documents) USING (chunk_id)),
rr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(rerank_score, 9) DESC, old_rank) AS rank FROM r)"""

ORACLES = {
    "bm25_corpus_stats": f"WITH {_BM25} SELECT n AS n_docs, round(avgdl, 6) AS avgdl, (SELECT count(*) FROM idf) AS vocabulary FROM st",
    "bm25_idf": f"WITH {_BM25} SELECT term, df, round(idf, 6) AS idf FROM idf",
    "bm25_top10": f"WITH {_BM25}, {_cut('hits')} {_OUT}",
    "bm25_top10_filtered": f"WITH {_BM25}, {_cut('hits', 'lang = ' + repr('en') + ' AND n_chars >= 500')} {_OUT}",
    "vector_top10": f"WITH {_vsql(_COS)} {_OUT}",
    "vector_top10_filtered": f"WITH {_vsql(_COS, 'label IN (1, 2, 3)')} {_OUT}",
    "vector_threshold": f"WITH {_vsql(_COS, _COS + ' >= 0.25')} {_OUT}",
    "vector_euclidean": f"WITH {_vsql(_EUCLID)} {_OUT}",
    "rrf_fusion": f"""WITH {_BM25}, {_cut("v", "lang = 'en'", 20)}, {_cut("b", "n_chars >= 1000", 20)},
f AS (SELECT query_id, chunk_id, v.score AS vs, b.score AS bs, v.rank AS vr, b.rank AS br FROM v FULL OUTER JOIN b USING (query_id, chunk_id)),
g AS (SELECT *, count(vr) OVER (PARTITION BY query_id) AS nv, count(br) OVER (PARTITION BY query_id) AS nb FROM f),
s AS (SELECT query_id, chunk_id, vr, br, CASE WHEN nv > 0 AND nb > 0 THEN coalesce(0.7 / (60 + vr), 0) + coalesce(0.3 / (60 + br), 0) WHEN nv > 0 THEN vs ELSE bs END AS score FROM g)
SELECT query_id, chunk_id, round(score, 9) AS score, rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, vr ASC NULLS LAST, br ASC NULLS LAST) AS rank FROM s) WHERE rank <= 10""",
    "widened_search": f"""WITH {_BM25}, {_cut("narrow", "source = 'src1' AND lang IN ('de', 'fr')")}, {_cut("wide")},
c AS (SELECT query_id, count(*) AS n FROM narrow GROUP BY query_id),
u AS (SELECT *, 0 AS block FROM narrow UNION ALL SELECT w.*, 1 FROM wide w ANTI JOIN narrow USING (query_id, chunk_id) LEFT JOIN c USING (query_id) WHERE coalesce(n, 0) < 10)
SELECT query_id, chunk_id, round(score, 6) AS score, block, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY block, rank) AS r FROM u) WHERE r <= 10""",
    "rerank_change": f"{_RERANK} SELECT query_id, chunk_id, round(rerank_score, 6) AS rerank_score, old_rank, rank, old_rank - rank AS rank_change FROM rr",
    "rerank_distribution": f"{_RERANK} SELECT count(*) AS n, round(min(rerank_score), 6) AS min_rerank, round(max(rerank_score), 6) AS max_rerank, round(avg(rerank_score), 6) AS mean_rerank, max(old_rank - rank) AS max_up, min(old_rank - rank) AS max_down, round(avg(abs(old_rank - rank)), 6) AS mean_abs_change FROM rr",
    "filter_delete": "SELECT doc_id AS chunk_id, nullif(lang, 'de') AS lang FROM documents WHERE nullif(lang, 'de') IS DISTINCT FROM 'en'",
    "ground_evidence": f"WITH {_EVIDENCE} SELECT * FROM ev",
    "retrieval_metrics": f"WITH {_BM25}, {_cut('hits')}, {_EVIDENCE}, {_msql(_TRUTH)} SELECT query_id, {_rank(METRICS)} FROM m",
    "eval_summary": f"WITH {_BM25}, {_cut('hits')}, {_EVIDENCE}, {_msql(_TRUTH)} SELECT count(*) AS n, {', '.join(f'round(avg({c}), 6) AS {c}' for c in METRICS)} FROM m",
    "ablation_arms": " UNION ALL ".join(f"SELECT * FROM (WITH {_vsql(s, w)}, {_msql(_LABELS)} SELECT round(avg(rr), 6) AS mrr, round(avg(ndcg10), 6) AS ndcg10, '{arm}' AS arm FROM m)" for arm, s, w in (("cosine", _COS, "true"), ("euclidean", _EUCLID, "true"), ("label_filter", _COS, "label IN (0, 1, 2, 3, 4)"))),
    "hard_negatives": f"WITH {_BM25}, {_cut('hits', k=40)}, {_EVIDENCE}, rest AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM hits ANTI JOIN ({_TRUTH}) USING (query_id, chunk_id)) SELECT query_id, chunk_id, r AS rank FROM rest WHERE r BETWEEN 2 AND 4",
    "training_pairs": f"WITH {_BM25}, {_cut('hits', k=40)}, {_EVIDENCE}, rest AS (SELECT query_id, chunk_id, row_number() OVER (PARTITION BY query_id ORDER BY rank) AS r FROM hits ANTI JOIN ({_TRUTH}) USING (query_id, chunk_id)), g AS (SELECT query_id, list(chunk_id ORDER BY r) AS n FROM rest WHERE r BETWEEN 2 AND 4 GROUP BY query_id) SELECT query_id, t.chunk_id AS positive, coalesce(array_to_string(n, ','), '') AS negatives, n[(query_id + {SEED}) % greatest(coalesce(len(n), 0), 1) + 1] AS negative FROM ({_TRUTH}) t LEFT JOIN g USING (query_id)",
    "rerank_dev_samples": f"WITH {_BM25}, {_cut('hits', k=20)}, {_EVIDENCE}, t AS ({_TRUTH}) SELECT query_id, chunk_id, rank, (query_id, chunk_id) IN (SELECT (query_id, chunk_id) FROM t) AS positive FROM hits SEMI JOIN t USING (query_id)",
    "roc_auc": "SELECT round(avg(CASE WHEN a.n_chars > b.n_chars THEN 1.0 WHEN a.n_chars = b.n_chars THEN 0.5 ELSE 0.0 END), 6) AS auc FROM (SELECT n_chars FROM labels JOIN documents USING (doc_id) WHERE quality = 1) a, (SELECT n_chars FROM labels JOIN documents USING (doc_id) WHERE quality = 0) b",
    "threshold_sweep": """WITH s AS (SELECT quality AS supported, least(1.0, n_chars / 4000.0) AS score FROM labels JOIN documents USING (doc_id)), g AS (SELECT (range * 5)::INTEGER AS percent FROM range(1, 20)),
c AS (SELECT percent, count(*) FILTER (score < percent / 100.0 AND supported = 0) AS tp, count(*) FILTER (score < percent / 100.0 AND supported = 1) AS fp, count(*) FILTER (score >= percent / 100.0 AND supported = 0) AS fn, count(*) FILTER (score >= percent / 100.0 AND supported = 1) AS tn FROM s, g GROUP BY percent),
p AS (SELECT percent, tp / nullif(tp + fp, 0) AS p, tp / nullif(tp + fn, 0) AS r, tn / nullif(tn + fp, 0) AS k FROM c)
SELECT percent, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / nullif(p + r, 0), 6) AS f1, round(k, 6) AS supported_kept, round((r + k) / 2, 6) AS balanced_accuracy FROM p""",
    "filter_scalar": "SELECT doc_id AS chunk_id, lang, source, n_chars FROM documents WHERE lang = 'fr'",
    "filter_any": "SELECT doc_id AS chunk_id, lang, source, n_chars FROM documents WHERE source IN ('src1', 'src2')",
    "filter_range": "SELECT doc_id AS chunk_id, lang, source, n_chars FROM documents WHERE n_chars > 200 AND n_chars <= 900",
    "filter_missing": "SELECT doc_id AS chunk_id, lang, source, n_chars FROM documents WHERE false",
}

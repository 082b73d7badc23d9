"""The registered queries of this subpackage: one per operator, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm.decontamination import contaminated
from corpusloom.llm.line_dedup import dedup_lines
from corpusloom.llm.mixing import mix_sources
from corpusloom.llm.ngram_lm import score_texts
from corpusloom.llm.quality import score_quality
from corpusloom.llm.simhash import simhash_duplicates
from corpusloom.llm.substring_dedup import dedup_substrings
from corpusloom.llm.suffix_dedup import dedup_suffixes
from corpusloom.llm.token_output import read_documents, write_tokens
from corpusloom.llm.topk import top_inner_products

#: The byte-level vocabulary of op2; a path that is the same on all machines.
TOKENIZER = str(public_tokenizers.path("byte_bpe_50k.json"))


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(_table(spark, sf_dir, "documents"))


def op2_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read_documents(write_tokens(_table(spark, sf_dir, "documents"), TOKENIZER))


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_substrings(_table(spark, sf_dir, "documents"), window=20)
    return kept.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op5_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return top_inner_products(_table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op6_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_suffixes(_table(spark, sf_dir, "documents"), window=50)
    return kept.select("doc_id", "n_bytes", "n_removed", (F.size("spans") / 2).cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


def op7_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_duplicates(_table(spark, sf_dir, "documents"), shingle=4, distance=4)


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(_table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_lm_scoring, op2_token_output, op3_substring_dedup, op4_quality_classifier, op5_exact_topk, op6_suffix_array_dedup, op7_decontamination, op8_simhash, op9_line_dedup, op10_mixing)}


_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t\n\r\f\x0B]+'), lambda x: x != '')"

ORACLES = {
    "op3_substring_dedup": f"""WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS (SELECT doc_id, unnest(list_transform(range(1, len(w) - 18), lambda i: {{'p': i, 'h': array_to_string(w[i:i + 19], ' ')}})) AS x FROM d),
late AS (SELECT doc_id, p FROM (SELECT doc_id, x.p AS p, row_number() OVER (PARTITION BY x.h ORDER BY doc_id, x.p) AS n FROM s) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(p, p + 20)) AS p FROM late),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS p FROM d),
kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS text FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(text, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (doc_id)""",
    "op5_exact_topk": """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id AS vec_id, list_dot_product(q.e, c.e)::BIGINT AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.vec_id != q.vec_id)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 5""",
    "op6_suffix_array_dedup": """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, p, hash(substr(h, 2 * p + 1, 100)) AS s FROM (SELECT doc_id, h, unnest(range(len(h) // 2 - 49)) AS p FROM d)),
f AS (SELECT s, min(doc_id) AS owner FROM w GROUP BY s HAVING min(doc_id) <> max(doc_id)),
g AS (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS b FROM w JOIN f USING (s) WHERE owner < doc_id),
i AS (SELECT doc_id, p, sum(CASE WHEN b IS NULL OR p > b + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY p) AS n FROM g),
r AS (SELECT doc_id, n, min(p) AS a, max(p) + 50 AS z FROM i GROUP BY doc_id, n),
k AS (SELECT doc_id, a, z, lag(z, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) AS e FROM r),
t AS (SELECT doc_id, count(*) AS n_spans, sum(z - a)::BIGINT AS n_removed, max(z) AS last, string_agg(substr(h, 2 * e + 1, 2 * (a - e)), '' ORDER BY a) AS head FROM k JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head || substr(h, 2 * last + 1), h))) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)""",
    "op9_line_dedup": """WITH l AS (SELECT doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS n FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents)),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key, count(DISTINCT doc_id) AS docs, min(doc_id) AS owner FROM k WHERE length(key) >= 10 GROUP BY key),
j AS (SELECT k.doc_id, line, n, coalesce(docs >= 2 AND owner != k.doc_id, false) AS gone FROM k LEFT JOIN c USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (NOT gone), '')) AS kept_sha256 FROM j GROUP BY doc_id""",
}


def oracle_sql() -> dict[str, str]:
    return ORACLES

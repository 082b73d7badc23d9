"""The retrieval pipeline over a table of questions: processing, hybrid search, widening, reranking.

Models are seams: an ``Embedder`` and a scorer of (question, text).  The defaults need no
model and are stand-ins under their own names.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.functions.expansion import academic_expansion
from corpusloom.functions.text import academic_filters, basic_expansion, section_intent, tokens
from corpusloom.operators import retrieval as R
from corpusloom.operators.filters import apply_filters

#: Candidates that a reranker gets, unless more results are asked for.
RERANK_CANDIDATES = 40
#: The filters that a question's words may state, in their columns.
INFERRED = ("year", "authors", "venue", "paper_type", "section_type")


@dataclass(frozen=True)
class Embedder:
    """Texts to unit vectors.  ``encode`` takes a list of texts and gives one row a text."""

    name: str
    encode: Callable[[list[str]], np.ndarray]
    length: int
    query_prefix: str = ""
    passage_prefix: str = ""

    def _column(self, prefix: str, blank: list[float] | None):
        encode = self.encode

        def run(texts: pd.Series) -> pd.Series:
            real = [prefix + t for t in texts.fillna("") if t.strip()]
            rows = np.asarray(encode(real), np.float64) if real else np.zeros((0, 1))
            norms = np.linalg.norm(rows, axis=1, keepdims=True)
            units = iter((rows / np.where(norms > 0, norms, 1)).astype(np.float32).tolist())
            return pd.Series([next(units) if t.strip() else blank for t in texts.fillna("")], dtype=object)

        return F.pandas_udf(run, "array<float>")

    def queries(self, c: Column) -> Column:
        """A blank question is the zero vector."""
        return self._column(self.query_prefix, [0.0] * self.length)(c)

    def passages(self, c: Column) -> Column:
        """A blank passage has none, so that rows keep their place."""
        return self._column(self.passage_prefix, None)(c)


def hashed_words(length: int = 64) -> Embedder:
    """A stand-in for an embedding model: words are hashed to signed places."""

    def encode(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), length))
        for k, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[k, h % length] += 1 if h >> 63 else -1
        return out

    return Embedder("hashed-words", encode, length)


def word_overlap(query: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the question's terms that the text holds."""
    asked = F.array_distinct(tokens(query))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, tokens(text))) / F.size(asked)).otherwise(F.lit(0.0))


def pair_scorer(predict: Callable[[list[tuple[str, str]]], list[float]], batch: int = 8) -> Callable[[Column, Column], Column]:
    """A model of pairs as a scorer; shortest pairs first, in small batches, scores in the rows' order."""

    def run(queries: pd.Series, texts: pd.Series) -> pd.Series:
        pairs = list(zip(queries.fillna(""), texts.fillna(""), strict=True))
        order, out = sorted(range(len(pairs)), key=lambda k: (pairs[k][0], len(pairs[k][1]))), [0.0] * len(pairs)
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            for k, score in zip(part, predict([pairs[k] for k in part]), strict=True):
                out[k] = float(score)
        return pd.Series(out, dtype="float64")

    return F.pandas_udf(run, "double")


@dataclass(frozen=True)
class Settings:
    """Which steps run.  Z4: ``snapshot`` tells them."""

    processing: bool = True
    hybrid: bool = True
    scorer: Callable[[Column, Column], Column] | None = word_overlap
    routing: bool = False
    candidates: int | None = RERANK_CANDIDATES
    year_now: int = 2026
    embedder: Embedder | None = field(default_factory=hashed_words)

    @classmethod
    def of_mode(cls, mode: str, **options) -> Settings:
        """fast: vectors alone; balanced: no reranking; accurate: everything."""
        plain = cls(**options)
        if mode == "fast":
            return replace(plain, processing=False, hybrid=False, scorer=None)
        if mode == "balanced":
            return replace(plain, processing=True, hybrid=True, scorer=None)
        if mode == "accurate":
            return plain
        raise ValueError(f"unknown mode {mode!r}")

    def depth(self, top_k: int) -> int:
        """T5: candidates for the reranker, never fewer than the results."""
        return max(top_k, self.candidates) if self.candidates else 4 * top_k

    def snapshot(self) -> dict:
        return {"processing": self.processing, "hybrid": self.hybrid, "reranking": self.scorer is not None, "routing": self.routing, "embedder": self.embedder.name if self.embedder else None}


def process(queries: DataFrame, settings: Settings, caller: dict | None = None) -> DataFrame:
    """Questions (query_id, text) with their wordings, section intent and inferred filters.

    A key that the caller filters by is not inferred (R16: the caller's value stays).
    """
    c = F.col("text")
    f = academic_filters(c, settings.year_now)
    section = section_intent(c)
    told = {
        "year_min": ("year", f["year_min"]), "year_max": ("year", f["year_max"]), "year_eq": ("year", f["year_eq"]), "author": ("authors", f["author"]),
        "venue": ("venue", f["venue"]), "paper_type": ("paper_type", f["paper_type"]), "section_type": ("section_type", section if settings.routing else F.lit(None).cast("string")),
    }
    inferred = F.struct(*[(F.lit(None).cast("int" if key == "year" else "string") if key in (caller or {}) else value).alias(name) for name, (key, value) in told.items()])
    wordings = F.array_distinct(F.concat(basic_expansion(c), academic_expansion(c)))
    return queries.withColumn("section_intent", section).withColumn("wordings", wordings).withColumn("inferred", inferred)


def has_inferred(f: Column) -> Column:
    return F.coalesce(*[f[n].cast("string") for n in ("year_min", "year_max", "year_eq", "author", "venue", "paper_type", "section_type")]).isNotNull()


def matches(f: Column, columns: list[str]) -> Column:
    """Whether a chunk with these columns passes inferred filters; a missing column or value never does."""
    own = lambda name, test: F.coalesce(test(F.col(name)), F.lit(False)) if name in columns else F.lit(False)
    parts = [
        (f["year_min"], own("year", lambda c: c >= f["year_min"])), (f["year_max"], own("year", lambda c: c <= f["year_max"])), (f["year_eq"], own("year", lambda c: c == f["year_eq"])),
        (f["author"], own("authors", lambda c: F.array_contains(c, f["author"]))), *[(f[n], own(n, lambda c, n=n: c == f[n])) for n in ("venue", "paper_type", "section_type")],
    ]
    out = F.lit(True)
    for asked, passed in parts:
        out = out & (asked.isNull() | passed)
    return out


def _vectors_where(queries: DataFrame, chunks: DataFrame, k: int) -> DataFrame:
    """Vector search of questions that have filters of their own: only pairs that pass are scored."""
    q = queries.select("query_id", "query", "inferred")
    kept = chunks.join(q, matches(F.col("inferred"), chunks.columns))
    unit = lambda c: F.sqrt(R.dot(F.col(c), F.col(c)))
    score = R.dot(F.col("embedding"), F.col("query")) / F.nullif(unit("embedding") * unit("query"), F.lit(0.0))
    return R.cut(kept.select("query_id", "chunk_id", score.alias("score")).filter("score is not null"), k)


def hybrid_search(queries: DataFrame, chunks: DataFrame, k: int, index: R.Bm25Index | None = None, hybrid: bool = True) -> DataFrame:
    """Questions (query_id, text, query, and inferred where they filter) over chunks (chunk_id, text, embedding).

    Either side brings twice as many hits as are fused.  Without the lexical side a vector
    hit's own score is its fusion score.
    """
    with_filters = "inferred" in queries.columns
    placed = chunks.filter(F.col("embedding").isNotNull())
    if with_filters:
        # One pass for the questions without filters, pairs that pass for the others.
        plain = queries.filter(~has_inferred(F.col("inferred")))
        vector = R.vector_search(plain, placed, 2 * k if hybrid else k).unionByName(_vectors_where(queries.filter(has_inferred(F.col("inferred"))), placed, 2 * k if hybrid else k))
    else:
        vector = R.vector_search(queries, placed, 2 * k if hybrid else k)
    if not hybrid:
        score = F.col("score")
        return vector.select("query_id", "chunk_id", score, "rank", score.alias("vector_score"), F.lit(0.0).alias("bm25_score"))
    keep = tuple(c for c in INFERRED if c in chunks.columns) if with_filters else ()
    scored = R.bm25_scores(queries, chunks, index or R.bm25_index(chunks), keep)
    if with_filters:
        scored = scored.join(queries.select("query_id", "inferred"), "query_id").filter(matches(F.col("inferred"), list(keep)))
    fused = R.fuse(vector, R.cut(scored, 2 * k), k)
    zero = lambda c: F.coalesce(c, F.lit(0.0)).alias(c)
    return fused.select("query_id", "chunk_id", "score", "rank", zero("vector_score"), zero("bm25_score"))


def retrieve(queries: DataFrame, chunks: DataFrame, top_k: int = 10, settings: Settings | None = None, filters: dict | None = None, index: R.Bm25Index | None = None) -> DataFrame:
    """The results of every question.

    queries: query_id, text, and query where its vector is known.  chunks: chunk_id, text,
    embedding where it is known, and what filters name.  Returns query_id, chunk_id,
    score, rank, vector_score, bm25_score, fusion_score, rerank_score and stages.

    A question whose inferred filters leave fewer candidates than are wanted gets those of
    a search without them behind (R15); the caller's filters always hold, and BM25's
    statistics come from all chunks (``index``, where it is at hand).
    """
    settings = settings or Settings()
    depth = settings.depth(top_k)
    if "query" not in queries.columns:
        queries = queries.withColumn("query", settings.embedder.queries(F.col("text")))
    if "embedding" not in chunks.columns:
        chunks = chunks.withColumn("embedding", settings.embedder.passages(F.col("text")))
    index = (index or R.bm25_index(chunks)) if settings.hybrid else None
    kept = apply_filters(chunks, filters)
    asked = process(queries, settings, filters) if settings.processing else queries
    hits = hybrid_search(asked, kept, depth, index, settings.hybrid).withColumn("block", F.lit(0))
    if settings.processing:
        filtered = asked.filter(has_inferred(F.col("inferred"))).drop("inferred", "wordings", "section_intent")
        wide = hybrid_search(filtered, kept, depth, index, settings.hybrid)
        counts = hits.groupBy("query_id").agg(F.count("*").alias("n"))
        thin = filtered.select("query_id").join(counts, "query_id", "left").filter(F.coalesce("n", F.lit(0)) < depth).select("query_id")
        extra = wide.join(thin, "query_id", "left_semi").join(hits.select("query_id", "chunk_id"), ["query_id", "chunk_id"], "left_anti")
        hits = hits.unionByName(extra.withColumn("block", F.lit(1)))
    hits = R.top_k(hits.withColumnRenamed("rank", "own_rank"), 2 * depth, F.asc("block"), F.asc("own_rank")).withColumnRenamed("score", "fusion_score")
    stages = [*(["query_processing"] if settings.processing else []), "hybrid_search" if settings.hybrid else "vector_search"]
    if settings.scorer is not None:
        texts = hits.join(kept.select("chunk_id", "text"), "chunk_id").join(queries.select("query_id", F.col("text").alias("asked")), "query_id")
        scored = R.rerank(texts, settings.scorer(F.col("asked"), F.col("text")), top_k)
        # A single hit is not reranked.
        several = F.count("*").over(Window.partitionBy("query_id")) > 1
        ranked, score = scored.withColumn("score", F.when(several, F.col("rerank_score")).otherwise(F.col("fusion_score"))), F.when(several, F.col("rerank_score")).otherwise(F.lit(0.0))
        stages.append("reranking")
    else:
        ranked, score = hits.filter(F.col("rank") <= top_k).withColumn("score", F.col("fusion_score")), F.lit(0.0)
    return ranked.select("query_id", "chunk_id", "score", "rank", "vector_score", "bm25_score", "fusion_score", score.alias("rerank_score"), (F.col("block") == 1).alias("widened"), F.array(*map(F.lit, stages)).alias("stages"))


class Breaker:
    """Keeps from calling a model again after an error that won't pass, and counts attempts and successes."""

    def __init__(self, permanent: tuple[type[BaseException], ...] = (PermissionError, LookupError)):
        self.permanent, self.open = permanent, True
        self.attempted = self.succeeded = 0

    def call(self, model: Callable[..., str], *args, default=None):
        if not self.open:
            return default
        self.attempted += 1
        try:
            out = model(*args)
        except self.permanent:
            self.open = False
            return default
        except Exception:  # noqa: BLE001  a passing error costs this answer alone
            return default
        self.succeeded += 1
        return out

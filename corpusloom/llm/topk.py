"""Exact top-k inner products by pivot-table elimination.

Vectors become integers.  Pivots are chosen once, far from each other, among a bounded
sample of the vectors; each candidate's distances to all of them are computed once and
stored with it, sorted by the nearest pivot.  By the triangle inequality the greatest
difference of two such rows is a lower bound of a pair's distance, so an upper bound of its
inner product.  A query evaluates candidates in the order of their bounds and stops when
its k-th best score passes every bound that is left, so the result is exact.

Queries are handled in blocks of bounded size that are broadcast one after the other; each
block meets the whole stored table, batch by batch.  A query starts from its k-th best
score among the sample and carries the k-th best on through a task's batches, so that a
batch whose bounds are all below costs the bounds alone.  Only each task's k best travel.

Cases: vectors that are null, or hold null or non-finite components, take no part;
only vectors of one length are compared; vectors of zeros score zero with all; ties go to
the smaller id; a query never meets its own row's id; rows with the same id are candidates
each; a null id takes no part; an empty table gives an empty result; other columns are
ignored.  Where sums could pass 2**53 scores are added up as whole numbers of any size, and
a score beyond a long is an error.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from corpusloom.llm import kernels as K
from corpusloom.runtime import materialise, ship_package

PIVOTS = 32
#: Vectors of which pivots are chosen and from which queries start, at most.
SAMPLE = 4096
#: Queries in a block, at most about so many.
BLOCK_QUERIES = 16_384
#: Candidates of one part of the stored table, about.
PART_ROWS = 200_000
EXACT = 2.0**52
TABLE = "vec_id long, length int, cell int, vector binary, distances binary"
_TABLE = pa.schema([("vec_id", pa.int64()), ("length", pa.int32()), ("cell", pa.int32()), ("vector", pa.binary()), ("distances", pa.binary())])
_FOUND = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    square = np.einsum("ij,ij->i", a, a)[:, None] + np.einsum("ij,ij->i", b, b) - 2 * (a @ b.T)
    return np.sqrt(np.maximum(square, 0))


def far_apart(vectors: np.ndarray, n: int) -> np.ndarray:
    """Pivots: each next one is the vector farthest from those chosen."""
    chosen, nearest = [0], _distance(vectors, vectors[:1])[:, 0]
    while len(chosen) < min(n, len(vectors)):
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, _distance(vectors, vectors[chosen[-1:]])[:, 0])
    return vectors[chosen]


def scores(vectors: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Inner products of whole numbers, exact whatever their size."""
    if not len(vectors) or np.linalg.norm(query) * np.sqrt(np.einsum("ij,ij->i", vectors, vectors).max()) < EXACT:
        return (vectors @ query).astype(np.int64)
    whole = [int(x) for x in query.tolist()]
    sums = [sum(int(x) * y for x, y in zip(row, whole, strict=True)) for row in vectors.tolist()]
    if any(abs(s) >> 63 for s in sums):
        raise OverflowError("an inner product passes 64 bits")
    return np.array(sums, np.int64)


class Best:
    """The k best candidates of each query so far."""

    def __init__(self, n: int, k: int):
        self.k = k
        self.ids: list[np.ndarray] = [np.zeros(0, np.int64)] * n
        self.scores: list[np.ndarray] = [np.zeros(0, np.int64)] * n

    def add(self, q: int, ids: np.ndarray, values: np.ndarray) -> None:
        ids, values = np.concatenate([self.ids[q], ids]), np.concatenate([self.scores[q], values])
        keep = np.lexsort((ids, -values))[: self.k]
        self.ids[q], self.scores[q] = ids[keep], values[keep]


class Queries:
    """A block of queries of one length: vectors, distances to the pivots, scores to begin with."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, pivots: np.ndarray, seeds: tuple[np.ndarray, np.ndarray], k: int):
        self.ids, self.vectors = ids, vectors
        self.norms = np.einsum("ij,ij->i", vectors, vectors)
        self.table = _distance(vectors, pivots).astype(np.float32)
        # The k-th best score among the sample; no answer lies below it.
        self.least = np.full(len(ids), -np.inf)
        for q in range(len(ids)):
            own = scores(seeds[1][seeds[0] != ids[q]], vectors[q])
            if len(own) >= k:
                self.least[q] = np.partition(own, len(own) - k)[len(own) - k]

    def bounds(self, q: int, norms: np.ndarray, table: np.ndarray) -> np.ndarray:
        """Upper bounds of the scores of candidates, by their squared norms and distances to the pivots."""
        lower = np.abs(table - self.table[q]).max(axis=1).astype(np.float64)
        slack = 1e-5 * (lower + np.sqrt(self.norms[q]) + np.sqrt(norms)) + 1e-3  # for rounding
        total = self.norms[q] + norms
        return (total - np.maximum(lower - slack, 0) ** 2) / 2 + 1e-9 * total + 0.5

    def scan(self, best: Best, ids: np.ndarray, vectors: np.ndarray, table: np.ndarray) -> int:
        """Evaluate what a batch of candidates can add; how many pairs that took."""
        norms, evaluated = np.einsum("ij,ij->i", vectors, vectors), 0
        for q in range(len(self.ids)):
            bound = self.bounds(q, norms, table)
            open_ = np.flatnonzero((bound >= self.least[q]) & (ids != self.ids[q]))
            open_ = open_[np.argsort(-bound[open_], kind="stable")]
            at, step = 0, 64
            while at < len(open_) and bound[open_[at]] >= self.least[q]:
                part = open_[at : at + step]
                best.add(q, ids[part], scores(vectors[part], self.vectors[q]))
                if len(best.scores[q]) == best.k:
                    self.least[q] = max(self.least[q], float(best.scores[q][-1]))
                evaluated += len(part)
                at, step = at + step, min(4 * step, 4096)
        return evaluated


def _vectors(batch: pa.RecordBatch, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """Ids and scaled integer vectors (as whole doubles) of a batch, by length."""
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        if i is None or not v.is_valid or v.values.null_count:
            continue
        x = np.floor(scale * v.values.to_numpy(zero_copy_only=False).astype(np.float64))
        if len(x) and np.isfinite(x).all():
            ids, rows = groups.setdefault(len(x), ([], []))
            ids.append(i)
            rows.append(x)
    return {n: (np.array(ids, np.int64), np.stack(rows)) for n, (ids, rows) in groups.items()}


def _measure(pivots, scale: float):
    """Each candidate with its distances to the pivots, and the pivot that is nearest."""

    def run(batches):
        for batch in batches:
            for n, (ids, vectors) in _vectors(batch, scale).items():
                if n not in pivots.value:  # no vector of this length is a query
                    continue
                table = _distance(vectors, pivots.value[n]).astype(np.float32)
                columns = [pa.array(ids), pa.array(np.full(len(ids), n, np.int32)), pa.array(table.argmin(axis=1).astype(np.int32))]
                columns += [pa.array([row.tobytes() for row in x], pa.binary()) for x in (vectors, table)]
                yield pa.RecordBatch.from_arrays(columns, schema=_TABLE)

    return run


def _scan(broadcast, k: int):
    def run(batches):
        blocks: dict[int, tuple[Queries, Best]] = {n: (q, Best(len(q.ids), k)) for n, q in broadcast.value.items()}
        for batch in batches:
            lengths = batch.column(1).to_numpy()
            for n in np.unique(lengths).tolist():
                if n in blocks:
                    own = batch.filter(pa.array(lengths == n))
                    vectors, table = (np.frombuffer(b"".join(own.column(c).to_pylist()), t).reshape(own.num_rows, -1) for c, t in ((3, np.float64), (4, np.float32)))
                    blocks[n][0].scan(blocks[n][1], own.column(0).to_numpy(), vectors, table)
        for queries, best in blocks.values():
            rows = [np.concatenate(x) for x in zip(*((np.full(len(best.ids[q]), queries.ids[q]), best.ids[q], best.scores[q]) for q in range(len(queries.ids))), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in rows], schema=_FOUND)

    return run


def _collected(df: DataFrame, scale: float) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    parts: dict[int, list] = {}
    for batch in df.toArrow().to_batches():
        for n, x in _vectors(batch, scale).items():
            parts.setdefault(n, []).append(x)
    return {n: (np.concatenate([p[0] for p in x]), np.concatenate([p[1] for p in x])) for n, x in parts.items()}


def top_inner_products(table: DataFrame, query_filter, k: int = 5, scale: float = 256.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k highest inner products: query_id, rank, vec_id, score.

    query_filter: a condition on ``vec_id`` that says which rows are queries.
    """
    spark = table.sparkSession
    ship_package(spark)
    vectors = table.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("embedding")).filter("vec_id is not null")
    queries = vectors.filter(query_filter)
    n_rows, n_queries = vectors.agg(F.count("*"), F.count_if(query_filter)).first()
    # At most about SAMPLE rows, by hash; each length of the queries has one pivot at least.
    some = vectors.filter(F.pmod(F.xxhash64("vec_id"), F.lit(max(1, -(-n_rows // SAMPLE)))) == 0).limit(2 * SAMPLE)
    sample = _collected(some, scale)
    blocks = max(1, -(-n_queries // BLOCK_QUERIES))
    found, stored, chosen, held = None, None, {}, None
    for b in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)) == b) if blocks > 1 else queries
        block = _collected(own, scale)  # about BLOCK_QUERIES rows
        new = {n: far_apart(sample[n][1] if n in sample else x[1], PIVOTS) for n, x in block.items() if n not in chosen}
        if new or stored is None:
            chosen |= new
            pivots = spark.sparkContext.broadcast(chosen)
            measured = vectors.mapInArrow(_measure(pivots, scale), TABLE)
            parts = max(2, -(-n_rows // PART_ROWS), min(spark.sparkContext.defaultParallelism, n_rows // 4096))
            stored = materialise(measured.repartition(parts, "length", "cell", F.pmod(F.xxhash64("vec_id"), F.lit(64))).sortWithinPartitions("length", "cell"), "pivot-table")
            pivots.unpersist()
        empty = (np.zeros(0, np.int64), np.zeros((0, 0)))
        held = spark.sparkContext.broadcast({n: Queries(*x, chosen[n], sample.get(n, (empty[0], np.zeros((0, n)))), k) for n, x in block.items()})
        one = stored.mapInArrow(_scan(held, k), "query_id long, vec_id long, score long")
        if blocks > 1:
            one = materialise(one, "block")
            held.unpersist()
        found = one if found is None else found.unionByName(one)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")

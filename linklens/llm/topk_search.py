"""Exact top-k search by inner product with pivot-table elimination.

Vectors become integers (floor(1024 x)). With a last coordinate that brings every
candidate to the largest norm M, and 0 there for a query, the score falls as the
distance grows: distance^2 = |q|^2 + M^2 - 2 score. So a lower bound on the distance is
an upper bound on the score.

``pivot_table`` holds each vector's distances to ``pivots`` pivots, spread over a bounded
sample by farthest-first choice; all vectors are in the table. Its rows are range
partitioned and sorted by (nearest pivot, distance to it), which splits a crowd of equal
vectors like any other rows, and each run of ``block`` rows has the range of its distances
to every pivot.

A search starts from a threshold: the k-th best score of a query among its own block
(``seeds``). Queries come in groups of at most about ``group_bytes``, broadcast one after
the other; each scan of the table moves no vector. For a query, a block is left out if the
maximum over the pivots of its lower bounds is beyond the threshold, then a candidate by
its own maximum; what is left is evaluated in bound order, raising the threshold, until
the next bound is below it. A candidate with a bound equal to the threshold is evaluated,
as ties are decided by vec_id. Bounds are widened by more than the rounding of their
distances, scores are exact integers.

Per task and query at most k rows that reach the threshold are handed on.

Defined cases: vectors that are null or hold null, NaN or infinite components take no
part; shorter vectors are as if ended by zeros; rows are told apart even if they repeat an
id, and a query's candidates are all other rows; a null vec_id is never a query and loses
ties; with fewer than k candidates all are returned; an empty table has no rows. Scores and
squared norms have to fit in a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linklens.llm.steps import Steps

SCALE = 1024
SAMPLE = 2048               # rows that the pivots are chosen from
PART_ROWS = 1 << 15         # rows of a part of the table
EXACT = 1 << 52             # largest squared norm with exact products in doubles
SLACK = 1e-6                # of M + |q|, what bounds are widened by at up to 64 components
LOWEST = np.iinfo(np.int64).min
HITS = "query long, query_id long, vec_id long, score long"


def integers(vectors: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """(row, vec_id, v, norm2) of the vectors that take part."""
    x = F.col("x")

    def odd(c: Column) -> Column:
        return c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))

    whole = F.transform(x, lambda c: F.floor(F.lit(float(SCALE)) * c))
    return (vectors.select(vectors[id_col].cast("long").alias("vec_id"), vectors[vector_col].cast("array<double>").alias("x"))
            .filter(x.isNotNull() & ~F.exists(x, odd))
            .select(F.monotonically_increasing_id().alias("row"), "vec_id", whole.alias("v"))
            .withColumn("norm2", F.aggregate("v", F.lit(0).cast("long"), lambda a, c: a + c * c)))


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Rows of a list column as integers, ended by zeros."""
    off = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False)
    size = np.diff(off)
    if len(size) and (size == dim).all():
        return flat[off[0]:off[-1]].reshape(len(size), dim).astype(np.int64)
    out = np.zeros((len(size), dim), np.int64)
    for i, (s, e) in enumerate(zip(off[:-1], off[1:])):
        out[i, :e - s] = flat[s:e]
    return out


def _products(a: np.ndarray, b: np.ndarray, exact: bool) -> np.ndarray:
    """Integer products of rows of a with rows of b."""
    if exact:
        return (a.astype(np.float64) @ b.astype(np.float64).T).astype(np.int64)
    return a @ b.T


def farthest_first(sample: np.ndarray, last: np.ndarray, count: int) -> np.ndarray:
    """Places of at most ``count`` rows of the sample (with their last coordinate), each
    farthest from those before it."""
    points = np.hstack([sample.astype(np.float64), last[:, None]])
    chosen = [0]
    far = ((points - points[0]) ** 2).sum(axis=1)
    while len(chosen) < count and far.max(initial=0) > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((points - points[chosen[-1]]) ** 2).sum(axis=1))
    return np.array(chosen)


class Pivots:
    """Pivot vectors, their last coordinates and the largest norm."""

    def __init__(self, vectors: np.ndarray, norm2: np.ndarray, m2: int):
        self.vectors, self.m2, self.m = vectors, m2, float(np.sqrt(m2))
        self.last = np.sqrt(np.maximum(m2 - norm2.astype(np.float64), 0))
        # the rounding of a distance near 0 grows with the root of the number of products
        self.slack = SLACK * max(1.0, np.sqrt(vectors.shape[1] / 64))

    def candidates(self, v: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        last = np.sqrt(np.maximum(self.m2 - norm2.astype(np.float64), 0))
        same = v.astype(np.float64) @ self.vectors.T.astype(np.float64) + last[:, None] * self.last
        return np.sqrt(np.maximum(2.0 * self.m2 - 2 * same, 0)).astype(np.float32)

    def queries(self, v: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        same = v.astype(np.float64) @ self.vectors.T.astype(np.float64)
        return np.sqrt(np.maximum(norm2.astype(np.float64)[:, None] + self.m2 - 2 * same, 0)).astype(np.float32)

    def score_bound(self, lower: np.ndarray, norm2: np.ndarray) -> np.ndarray:
        """Largest scores possible for lower bounds (one row per query) on the distance."""
        n2 = norm2.astype(np.float64)[:, None]
        safe = np.maximum(lower - self.slack * (self.m + np.sqrt(n2)), 0)
        return (n2 + self.m2 - safe * safe) / 2 + self.slack * (n2 + self.m2)


def pivot_table(rows: DataFrame, pivots: Pivots, dim: int, count: int, steps: Steps) -> DataFrame:
    """(row, vec_id, v, norm2, dist) sorted by nearest pivot and the distance to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not len(b):
                continue
            dist = pivots.candidates(_matrix(b.column(2), dim), b.column(3).to_numpy())
            near = dist.argmin(axis=1)
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array([d.tobytes() for d in dist], pa.binary()), pa.array(near.astype(np.int32)),
                 pa.array(dist[np.arange(len(near)), near])],
                names=["row", "vec_id", "v", "norm2", "dist", "cell", "d"])

    schema = "row long, vec_id long, v array<long>, norm2 long, dist binary, cell int, d float"
    table = steps.table(rows.select("row", "vec_id", "v", "norm2").mapInArrow(run, schema), "distances")
    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-count // PART_ROWS))
    out = steps.table(table.repartitionByRange(parts, "cell", "d", "row").sortWithinPartitions("cell", "d", "row")
                      .drop("cell", "d"), "table")
    steps.drop(table)
    return out


def _blocks(batches: Iterator[pa.RecordBatch], dim: int, size: int) -> Iterator[tuple]:
    """(rows, ids, null ids, vectors, norms, distances, whole block) of runs of the table."""
    for whole in batches:
        for lo in range(0, len(whole), size):
            b = whole.slice(lo, size)
            ids = b.column(1)
            none = ids.is_null().to_numpy(zero_copy_only=False)
            dist = np.frombuffer(b"".join(b.column(4).to_pylist()), np.float32).reshape(len(b), -1)
            yield (b.column(0).to_numpy(), ids.fill_null(0).to_numpy(), none,
                   _matrix(b.column(2), dim), b.column(3).to_numpy(), dist, b)


def seeds(table: DataFrame, k: int, every: int, block: int, dim: int, exact: bool) -> DataFrame:
    """The queries (row, vec_id, v, norm2) with the k-th best score of their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, ids, none, v, _, _, b in _blocks(batches, dim, block):
            at = np.flatnonzero(~none & (ids % every == 0))
            if not len(at):
                continue
            score = _products(v[at], v, exact)
            score[np.arange(len(at)), at] = LOWEST
            low = (np.partition(score, len(rows) - k, axis=1)[:, len(rows) - k] if len(rows) > k
                   else np.full(len(at), LOWEST))
            yield pa.RecordBatch.from_arrays(
                [*(c.take(pa.array(at)) for c in b.columns[:4]), pa.array(low)],
                names=["row", "vec_id", "v", "norm2", "least"])

    return table.mapInArrow(run, "row long, vec_id long, v array<long>, norm2 long, least long")


class Best:
    """The k best (score, id) of each query that has any, and what they must reach."""

    def __init__(self, least: np.ndarray, k: int):
        self.least, self.k = least.copy(), k
        self.found: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}

    def add(self, query: int, score: np.ndarray, ids: np.ndarray, none: np.ndarray) -> None:
        good = score >= self.least[query]
        now = score[good], ids[good], none[good]
        if not len(now[0]):
            return
        if query in self.found:
            now = tuple(np.concatenate(x) for x in zip(self.found[query], now))
        order = np.lexsort((now[1], now[2], -now[0]))[:self.k]
        self.found[query] = now = tuple(x[order] for x in now)
        if len(order) == self.k:
            self.least[query] = now[0][-1]


def search(table: DataFrame, group: dict[str, np.ndarray], pivots: Pivots, k: int, block: int, dim: int,
           exact: bool) -> DataFrame:
    """(query, query_id, vec_id, score): per task and query of the group its k best
    candidates that reach the threshold."""
    known = table.sparkSession.sparkContext.broadcast(group)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = known.value
        q, norm2 = g["v"], g["norm2"]
        to_pivots = pivots.queries(q, norm2)
        best = Best(g["least"], k)
        for rows, ids, none, v, _, dist, _ in _blocks(batches, dim, block):
            low, high = dist.min(axis=0), dist.max(axis=0)
            for lo in range(0, len(q), 256):
                part = slice(lo, min(lo + 256, len(q)))
                d = to_pivots[part]
                gap = np.maximum(d - high, low - d).max(axis=1, initial=0)
                alive = lo + np.flatnonzero(pivots.score_bound(gap[:, None], norm2[part])[:, 0] >= best.least[part])
                if not len(alive):
                    continue
                lower = np.zeros((len(alive), len(rows)), np.float32)
                for p in range(dist.shape[1]):
                    np.maximum(lower, np.abs(to_pivots[alive, p][:, None] - dist[:, p]), out=lower)
                bound = pivots.score_bound(lower, norm2[alive])
                for i, query in enumerate(alive.tolist()):
                    own = bound[i]
                    left = np.flatnonzero((own >= best.least[query]) & (rows != g["row"][query]))
                    left = left[np.argsort(-own[left], kind="stable")]
                    at, step = 0, 2 * k
                    while at < len(left) and own[left[at]] >= best.least[query]:
                        now = left[at:at + step]
                        best.add(query, _products(v[now], q[query:query + 1], exact)[:, 0], ids[now], none[now])
                        at, step = at + step, 2 * step
        for query, (score, ids, none) in best.found.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(score), g["row"][query])), pa.array(np.full(len(score), g["vec_id"][query])),
                 pa.array(ids, mask=none), pa.array(score)], names=["query", "query_id", "vec_id", "score"])

    return table.mapInArrow(run, HITS)


def top_k(vectors: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding",
          pivots: int = 32, block: int = 512, group_bytes: int = 32 << 20) -> DataFrame:
    """(query, query_id, rank, vec_id, score): for each row whose id ``every`` divides, the k
    rows with the largest integer inner product; ``query`` tells rows of one id apart."""
    spark = vectors.sparkSession
    steps = Steps(spark, "topk")
    rows = steps.table(integers(vectors, id_col, vector_col), "integers")
    count, dim, m2 = rows.agg(F.count(F.lit(1)), F.max(F.size("v")), F.max("norm2")).first()
    if not count:
        return spark.createDataFrame([], "query long, query_id long, rank int, vec_id long, score long")
    exact = m2 < EXACT
    picked = rows.orderBy(F.xxhash64("row"), "row").limit(SAMPLE).select("v", "norm2").toArrow().combine_chunks()
    column = picked.column("v").chunk(0)
    sample, norm2 = _matrix(column, dim), picked.column("norm2").to_numpy()
    at = farthest_first(sample, np.sqrt(np.maximum(m2 - norm2.astype(np.float64), 0)), pivots)
    chosen = Pivots(sample[at], norm2[at], m2)
    table = pivot_table(rows, chosen, dim, count, steps)
    steps.drop(rows)

    asked = steps.table(seeds(table, k, every, block, dim, exact), "queries")
    number = asked.count()
    groups = max(1, -(-number * 8 * (dim + pivots + 4) // group_bytes))
    hits = []
    for g in range(groups):
        got = asked.filter(F.pmod(F.xxhash64("row"), F.lit(groups)) == g).toArrow().combine_chunks()
        if not got.num_rows:
            continue
        group = {c: got.column(c).to_numpy() for c in ("row", "vec_id", "norm2", "least")}
        group["v"] = _matrix(got.column("v").chunk(0), dim)
        hits.append(steps.table(search(table, group, chosen, k, block, dim, exact), "hits"))
    if not hits:
        return spark.createDataFrame([], "query long, query_id long, rank int, vec_id long, score long")
    found = spark.read.schema(HITS).parquet(*[h._step_path for h in hits])
    order = Window.partitionBy("query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    return (found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
            .select("query", "query_id", "rank", "vec_id", "score"))


def op11_exact_topk(vectors: DataFrame) -> DataFrame:
    """The contract's digest: ten best of each row whose vec_id 100 divides."""
    return top_k(vectors).drop("query")


OP11_SQL = r"""
WITH v AS (
  SELECT row_number() OVER () AS r, vec_id,
         list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE embedding IS NOT NULL
    AND coalesce(list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x::DOUBLE))), true)),
scored AS (
  SELECT q.r, q.vec_id AS query_id, c.vec_id,
         CAST(list_sum(list_transform(list_zip(q.e, c.e), lambda p: coalesce(p[1] * p[2], 0))) AS BIGINT) AS score
  FROM v q JOIN v c ON q.r <> c.r WHERE q.vec_id % 100 = 0),
ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id NULLS LAST) AS INTEGER) AS rank,
         vec_id, score FROM scored)
SELECT * FROM ranked WHERE rank <= 10
"""

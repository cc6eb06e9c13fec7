import math
import random

import duckdb
import numpy as np
import pytest
from llmdata import SF01

from linklens.llm.topk_search import OP11_SQL, Pivots, farthest_first, op11_exact_topk, top_k

VEC = "vec_id long, embedding array<float>, label int"


def brute(vectors, k=10, every=100):
    use = [(i, [math.floor(1024 * float(np.float32(x))) for x in e]) for i, e, *_ in vectors
           if e is not None and all(x is not None and math.isfinite(x) for x in e)]
    out = []
    for at, (i, q) in enumerate(use):
        if i is None or i % every:
            continue
        scored = [(-sum(a * b for a, b in zip(q, e)), j is None, j or 0) for c, (j, e) in enumerate(use) if c != at]
        out += [(i, r + 1, None if none else j, -s) for r, (s, none, j) in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_given_vectors_and_sql(spark):
    df = spark.read.parquet(f"{SF01}/embeddings.parquet")
    got = rows(op11_exact_topk(df))
    assert got == brute([tuple(r) for r in df.select("vec_id", "embedding").collect()])
    con = duckdb.connect()
    con.sql(f"CREATE VIEW embeddings AS SELECT * FROM '{SF01}/embeddings.parquet'")
    assert sorted(con.sql(OP11_SQL).fetchall(), key=str) == got


def crowd(rng, n, dim):
    """Clusters of different norms, a third of all vectors equal, ties."""
    same = [rng.gauss(0, 1) for _ in range(dim)]
    centres = [[rng.gauss(0, 3) for _ in range(dim)] for _ in range(6)]
    out = []
    for i in range(n):
        if i % 3 == 0:
            e = same
        elif i % 7 == 0:
            e = [float(rng.randrange(-1, 2)) for _ in range(dim)]
        else:
            c = rng.choice(centres)
            e = [x * rng.choice([0.5, 1]) + rng.gauss(0, 0.2) for x in c]
        out.append((i, e, 0))
    return out


@pytest.mark.parametrize("block,group_bytes", [(512, 1 << 25), (16, 2000)])
def test_crowds_ties_and_query_groups(spark, block, group_bytes):
    vectors = crowd(random.Random(block), 1500, 6)
    df = spark.createDataFrame(vectors, VEC).repartition(7)
    got = rows(top_k(df, k=7, every=10, pivots=8, block=block, group_bytes=group_bytes).drop("query"))
    assert got == brute(vectors, k=7, every=10)


def test_defined_cases(spark):
    inf, nan = float("inf"), float("nan")
    vectors = [(0, [1.0, 2.0], 1), (100, None, 1), (200, [1.0, None], 1), (300, [nan, 1.0], 1), (400, [inf, 1.0], 1),
               (0, [1.0, 2.0], 1), (500, [3.0], 1), (600, [], 1), (None, [1.0, 2.0], 1), (-100, [-1.0, -0.0001], 1),
               (7, [1.0, 2.0], 1)]
    more = spark.createDataFrame([(*v, 1, 2, [1]) for v in vectors], VEC + ", row int, score long, v array<int>")
    assert rows(op11_exact_topk(more)) == brute(vectors)
    assert rows(op11_exact_topk(spark.createDataFrame([], VEC))) == []
    assert rows(op11_exact_topk(spark.createDataFrame([(100, [1.0], 1)], VEC))) == []
    assert rows(op11_exact_topk(spark.createDataFrame([(1, [1.0], 1), (2, [1.0], 1)], VEC))) == []


def test_long_and_large_vectors(spark):
    rng = random.Random(4)
    wide = [(i, [rng.gauss(0, 1) for _ in range(3000)], 0) for i in range(120)]
    assert rows(op11_exact_topk(spark.createDataFrame(wide, VEC))) == brute(wide)
    big = [(i, [rng.gauss(0, 1) * 1e5 for _ in range(8)], 0) for i in range(300)]
    assert rows(op11_exact_topk(spark.createDataFrame(big, VEC))) == brute(big)


def test_bounds_hold_and_eliminate():
    rng = np.random.default_rng(0)
    v = (rng.normal(size=(10, 1, 32)) * 800 + rng.normal(size=(10, 60, 32)) * 40).reshape(600, 32).astype(np.int64)
    norm2 = (v * v).sum(axis=1)
    m2 = int(norm2.max())
    at = farthest_first(v, np.sqrt((m2 - norm2).astype(float)), 16)
    pivots = Pivots(v[at], norm2[at], m2)
    lower = np.abs(pivots.queries(v, norm2)[:, None] - pivots.candidates(v, norm2)[None]).max(axis=2)
    bound, score = pivots.score_bound(lower, norm2), v @ v.T
    assert (bound >= score).all()
    tenth = np.sort(score, axis=1)[:, -11]
    assert (bound >= tenth[:, None]).mean() < 0.5        # most candidates need no evaluation

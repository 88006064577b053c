"""Top-k against all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vectrail.llm import exact_topk as e


def slow(rows, k, every):
    held = {}
    for i, v in rows:
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            held[i, tuple(math.floor(256 * x) for x in v)] = None
    out = set()
    for q, a in held:
        if q % every == 0:
            scores = sorted({(-max(-e.LONG, min(e.LONG, sum(x * y for x, y in zip(a, b)))), i) for i, b in held if i != q})
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])}
    return out


@pytest.mark.parametrize("block", [3, 4096])
def test_equals_all_pairs(spark, block):
    rng = random.Random(8)
    f = lambda x: math.ldexp(round(x * 4096), -12)
    rows = [(i, [f(rng.gauss(0, 0.3)) for _ in range(6)]) for i in range(120)]
    hot = [0.5, 0.25, 0.0, -0.5, 0.125, 0.0]
    rows += [(i, hot) for i in range(120, 180)]  # a common vector
    rows += [(200, None), (201, [1.0, None]), (202, [float("nan")] * 6), (203, [float("inf")] * 6), (204, [0.5, 0.5]), (205, []), (None, hot), rows[0], rows[0], (206, [0.0] * 6)]
    df = spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id bigint, embedding array<float>, rank int")
    got = {tuple(r) for r in e.top_k(df, F.col("vec_id") % 10 == 0, 5, query_block=block).collect()}
    assert got == slow(rows, 5, 10)


@pytest.mark.parametrize("size", [1e6, 1e8, 1e12, 1e15, 4e15])
def test_outliers(spark, size):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(300)]
    for i in (0, 17, 40, 123):
        rows[i] = (i, [x * rng.choice([1.0, size]) for x in rows[i][1]])
    rows[60] = (60, [size, *[0.0] * 7])
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").repartition(3)
    got = {tuple(r) for r in e.top_k(df, F.col("vec_id") % 20 == 0, 5).collect()}
    assert got == slow(rows, 5, 20)


def test_few_exact_vectors_are_read(spark):
    rng = random.Random(10)
    rows = [(i, [rng.gauss(0, 0.3) for _ in range(8)]) for i in range(2000)] + [(2000, [1e9] + [0.0] * 7)]
    reads = spark.sparkContext.accumulator(0)
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>")
    got = {tuple(r) for r in e.top_k(df, F.col("vec_id") % 100 == 0, 5, reads=reads).collect()}
    assert got == slow(rows, 5, 100) and 21 * 6 <= reads.value < 21 * 2001 // 10


def test_bounds_hold_every_product():
    rng = np.random.default_rng(1)
    for size in (2**8, 2**40, 2**61):
        rows, queries = rng.integers(-size, size, (500, 5)), rng.integers(-size, size, (20, 5))
        rows[:3], rows[3] = rows[0], size
        grid = e.Grid(rows[100:], rows.min(axis=0), rows.max(axis=0))
        low, high = (grid.bound(queries, grid.cells(rows), up) for up in (False, True))
        for i, q in enumerate(queries.tolist()):
            for j, v in enumerate(rows.tolist()):
                product = sum(x * y for x, y in zip(q, v))
                assert int(low[i, j]) <= product <= int(high[i, j]) + 1


def test_few_rows(spark):
    df = spark.createDataFrame([(0, [1.0]), (1, [2.0]), (50, [-1.0])], "vec_id bigint, embedding array<float>")
    got = sorted(tuple(r) for r in e.top_k(df, F.col("vec_id") % 50 == 0, 5).collect())
    assert got == [(0, 1, 1, 131072), (0, 2, 50, -65536), (50, 1, 0, -65536), (50, 2, 1, -131072)]
    assert e.top_k(df.limit(0), F.col("vec_id") % 50 == 0, 5).collect() == []
    assert e.top_k(df, F.col("vec_id") > 99, 5).collect() == []


def test_large_components(spark):
    df = spark.createDataFrame([(0, [1e12, -3.0]), (1, [2e12, 5.0]), (2, [1e30, 0.0])], "vec_id bigint, embedding array<double>")
    got = {(r.query_id, r.vec_id): r.score for r in e.top_k(df, F.col("vec_id") == 0, 5).collect()}
    assert got[0, 1] == min(2**63 - 1, math.floor(256e12) * math.floor(512e12) + (-768) * 1280) and got[0, 2] == 2**63 - 1

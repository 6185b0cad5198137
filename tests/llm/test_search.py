"""Exact search against all products."""

import math
import random

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from stratograph.llm import exact_search, vectors

SCHEMA = "vec_id long, embedding array<double>, row int, `a.b` int"


def all_products(rows, s, every):
    kept = []
    for n, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) for x in v):
            x = [math.floor(c * s.scale) for c in v]
            if max(map(abs, x), default=0) <= vectors.limit(len(x)):
                kept.append((n, i, x))
    out = []
    for n, i, x in kept:
        if i is not None and i % every == 0:
            scores = [(-sum(a * b for a, b in zip(x, y)), j is None, j or 0, j) for m, j, y in kept if m != n and len(y) == len(x)]
            out += [(i, rank, t[3], -t[0]) for rank, t in enumerate(sorted(scores)[: s.k], 1)]
    return sorted(out, key=str)


def got(spark, rows, s, every):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v in rows], SCHEMA)
    found = exact_search.top_k(df.repartition(3), F.col("vec_id") % every == 0, s)
    assert found.columns == ["query_id", "rank", "vec_id", "score"]
    return sorted((tuple(r) for r in found.collect()), key=str)


@pytest.mark.parametrize(("seed", "dim", "settings"), [(0, 5, {"queries": 7, "run": 8, "step": 2, "sample": 20}), (1, 16, {"pivots": 1, "k": 3}), (2, 3, {"pivots": 8, "k": 40, "sample": 10, "queries": 1000})])
def test_equals_all_products(spark, seed, dim, settings):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(dim)] for _ in range(5)]
    rows = [(i, [x + r.gauss(0, 0.1) for x in r.choice(middle)]) for i in range(400)]
    rows += [(500 + i, [float(round(x)) for x in middle[0]]) for i in range(60)]  # repeated vectors: ties
    s = exact_search.Settings(**settings)
    assert got(spark, rows, s, 20) == all_products(rows, s, 20)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(0, [1.0, 2.0]), (0, [1.0, 2.0]), (10, [0.0, 0.0]), (20, None), (30, [nan, 1.0]), (40, [inf, 1.0]), (50, [None, 1.0]), (60, [1.0]), (70, [3.0, 1.0, 1.0]), (71, [-3.0, 1.0, 1.0])]
    rows += [(None, [1.0, 2.0]), (None, [-1.0, 2.0]), (3, [1.0, 2.0]), (4, [1e300, 0.0]), (80, []), (81, []), (90, [float(1 << 19), -float(1 << 19)]), (5, [-float(1 << 19), 3.0])]
    s = exact_search.Settings(k=4)
    assert got(spark, rows, s, 10) == all_products(rows, s, 10)
    assert got(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])], s, 10) == []  # no queries
    assert got(spark, [(10, [1.0, 2.0])], s, 10) == [] == got(spark, [], s, 10)  # no candidates


def test_bounds_leave_most_candidates_out(monkeypatch):
    """In clustered data most products are never taken, and the result stays exact."""
    r = np.random.default_rng(1)
    dim, s = 16, exact_search.Settings(k=10, pivots=16)
    x = (r.normal(size=(40, dim))[r.integers(0, 40, 4000)] * 1000 + r.normal(size=(4000, dim)) * 30).astype(np.int64)
    pivots = exact_search._pivots(x[:500], s.pivots)
    far = np.sqrt(vectors.distances(x, pivots)).astype(np.float32)
    order = np.lexsort((far.min(axis=1), far[:, 1:].argmin(axis=1)))
    x, far = x[order], far[order]
    batch = pa.RecordBatch.from_arrays([pa.array(np.arange(4000)), pa.array(np.arange(4000)), exact_search._lists(x.astype(np.int32), pa.int32()), exact_search._lists(far, pa.float32())], names=["row", "vec_id", "x", "far"])
    taken = []
    monkeypatch.setattr(exact_search, "products", lambda a, b: taken.append(len(a)) or vectors.products(a, b))
    asked = np.arange(0, 4000, 100)
    best = [exact_search._Best(i, x[i], far[i], -(1 << 63), s) for i in asked]
    exact_search._look(batch, best, far[asked], dim, len(pivots), s)
    scores = x[asked] @ x.T
    for i, b, row in zip(asked, best, scores):
        row[i] = -(1 << 62)
        assert b.scores == sorted(row.tolist(), reverse=True)[:10]
    assert sum(taken) < 0.25 * 4000 * len(asked)

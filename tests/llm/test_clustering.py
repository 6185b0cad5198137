"""Delta Lloyd against Lloyd in Python integers, and exact search against all products."""

import hashlib
import math
import random

import pytest

from stratograph.llm import centroid_clustering, vectors

SCHEMA = "vec_id long, embedding array<double>, cluster int, `a.b` int"


def lloyd(rows, s):
    kept = [(i, [math.floor(x * s.scale) for x in v]) for i, v, *_ in rows if v is not None and len(v) == s.dim and all(x is not None and math.isfinite(x) for x in v)]
    kept = [(i, x) for i, x in kept if max(map(abs, x), default=0) <= vectors.limit(s.dim)]
    order = sorted((hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest() if i is not None else "null", x) for i, x in kept)
    centroids = [x for _, x in order[: s.k]]

    def near(x):
        return min((sum((a - b) ** 2 for a, b in zip(x, c)), k) for k, c in enumerate(centroids))

    for _ in range(s.rounds):
        owners = [near(x)[1] for _, x in kept]
        for k in range(len(centroids)):
            mine = [x for (_, x), o in zip(kept, owners) if o == k]
            if mine:
                centroids[k] = [sum(c) // len(mine) for c in zip(*mine)]
    found = [(i, *near(x)[::-1]) for i, x in kept]
    total = sum(f[2] for f in found)
    sums = [sum(f[2] for f in found if f[1] == k) for k in range(len(centroids))]
    return sorted((((i is None, i or 0), k, d, sums[k], total, hashlib.sha256(",".join(map(str, centroids[k])).encode()).hexdigest()) for i, k, d in found))


def got(spark, rows, s):
    df = spark.createDataFrame([(i, v, 1, 2) for i, v, *_ in rows], SCHEMA)
    return sorted(((r[0] is None, r[0] or 0), *r[1:]) for r in centroid_clustering.cluster(df, s).collect())


@pytest.mark.parametrize(("seed", "k", "rounds"), [(0, 5, 3), (1, 12, 6), (2, 3, 0), (3, 40, 2)])
def test_delta_lloyd_equals_lloyd(spark, seed, k, rounds):
    r = random.Random(seed)
    middle = [[r.uniform(-1, 1) for _ in range(4)] for _ in range(6)]
    rows = [(i, [x + r.gauss(0, 0.2) for x in r.choice(middle)]) for i in range(300)] + [(900 + i, [0.5, 0.5, 0.5, 0.5]) for i in range(60)]
    s = centroid_clustering.Settings(k=k, rounds=rounds, dim=4, scale=16, block=50)
    assert got(spark, rows, s) == lloyd(rows, s)


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (1, [1.0, 0.0]), (2, None), (3, []), (4, [None, 1.0]), (5, [nan, 1.0]), (6, [inf, 1.0]), (7, [1.0]), (8, [1.0, 2.0, 3.0])]
    rows += [(None, [-0.01, 0.0]), (None, [5.0, 5.0]), (9, [1e300, 0.0]), (10, [float(1 << 29), 0.0]), (11, [-float(1 << 29), 1.0]), (12, [0.0, 0.0])]
    s = centroid_clustering.Settings(k=3, rounds=2, dim=2, scale=1)
    assert got(spark, rows, s) == lloyd(rows, s)
    assert got(spark, rows[3:10], s) == [] == got(spark, [], s)


def test_rounds_move_no_vectors(spark):
    """Blocks and owners lie in the same buckets: what is shuffled after the packing are sums alone."""
    rows = spark.createDataFrame([(i, [float(i % 7), 1.0]) for i in range(100)], "block long, x array<double>")
    from stratograph.llm.common import bucketed

    a = bucketed(rows, "block", "a")
    b = bucketed(a.rows.select("block"), "block", "b", dealt=True)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = a.rows.join(b.rows, "block")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "Exchange" not in plan
    a.drop()
    b.drop()

"""Neighbours of many queries against all cosines."""

import numpy as np
import pytest

from stratograph.operators import neighbours


@pytest.mark.parametrize(("n", "cells", "spread"), [(600, None, 0.1), (300, 40, 1.0), (5, 3, 0.5)])
def test_equals_all_cosines(spark, n, cells, spread):
    r = np.random.default_rng(n)
    middle = r.normal(size=(12, 8))
    x = middle[r.integers(0, 12, n)] + spread * r.normal(size=(n, 8))
    x[1::17] = x[0]  # ties
    rows = [(i, [float(v) for v in v]) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 8), (902, [1.0]), (903, [float("nan")] * 8), (None, [1.0] * 8)]
    index = neighbours.build(spark.createDataFrame(rows, "doc_id long, embedding array<double>"), 8, cells)
    asked = [(i, [float(v) for v in x[i]]) for i in range(0, n, max(1, n // 40))] + [(5000, [-1.0] * 8), (5001, None), (5002, [0.0] * 8)]
    found = neighbours.nearest(index, spark.createDataFrame(asked, "query_id long, embedding array<double>"), 7, probes=2).collect()
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    want = set()
    for q, v in asked:
        if v is not None and any(v):
            cosine = np.round(unit @ (np.array(v) / np.linalg.norm(v)), 10)
            want |= {(q, rank, int(i)) for rank, i in enumerate(np.lexsort((np.arange(n), -cosine))[:7], 1)}
    assert {(f["query_id"], f["rank"], f["doc_id"]) for f in found} == want and len(found) == len(want)
    if spread == 0.1:  # most cells are never read
        assert np.mean([f["cells"] for f in found if f["query_id"] < n]) < 0.6 * len(index.centroids)


def test_empty_index_and_no_queries(spark):
    schema = "embedding array<double>"
    empty = neighbours.build(spark.createDataFrame([], f"doc_id long, {schema}"), 3)
    assert neighbours.nearest(empty, spark.createDataFrame([(1, [1.0, 0.0, 0.0])], f"query_id long, {schema}"), 3).count() == 0
    index = neighbours.build(spark.createDataFrame([(1, [1.0, 0.0, 0.0])], f"doc_id long, {schema}"), 3)
    assert neighbours.nearest(index, spark.createDataFrame([], f"query_id long, {schema}"), 3).count() == 0


def test_vectors_are_never_broadcast(spark, monkeypatch):
    plans, keep = [], neighbours.cut

    def noted(df, what="round"):
        plans.append((what, df._jdf.queryExecution().executedPlan().toString()))
        return keep(df, what)

    monkeypatch.setattr(neighbours, "cut", noted)
    rows = spark.range(400).selectExpr("id doc_id", "array(cast(id % 7 as double), 1d, cast(id % 3 as double)) embedding")  # repeats make small files
    asked = rows.filter("doc_id % 40 = 0").withColumnRenamed("doc_id", "query_id")
    found = neighbours.nearest(neighbours.build(rows, 3), asked, 5)
    plans.append(("found", found._jdf.queryExecution().executedPlan().toString()))
    assert found.count() == 50 and [what for what, _ in plans].count("scores") == 2
    assert not [what for what, plan in plans if "Broadcast" in plan]


def test_contexts_broadcast_no_vectors(spark, monkeypatch):
    read, keep = [], neighbours.cut

    def noted(df, what="round"):
        read.append(df._jdf.queryExecution().executedPlan().toString())
        return keep(df, what)

    monkeypatch.setattr(neighbours, "cut", noted)
    rows = spark.range(300).selectExpr("id doc_id", "array(1d, cast(id % 5 as double)) embedding")
    documents = spark.range(150).selectExpr("id doc_id", "concat('text ', id) text", "map('pageTitle', concat('Page ', id)) payload")
    asked = rows.filter("doc_id % 100 = 0").withColumnRenamed("doc_id", "query_id")
    got = neighbours.contexts(neighbours.nearest(neighbours.build(rows, 2), asked, 3), documents).collect()
    assert {r["query_id"]: r["context"] for r in got} == dict.fromkeys((0, 100, 200), "".join(f"Source [{k + 1}]: Page {i}\ntext {i}\n---\n" for k, i in enumerate((0, 5, 10))))
    assert not [plan for plan in read if "Broadcast" in plan]

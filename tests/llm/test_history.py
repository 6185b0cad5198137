"""Versions of dimension rows against a walk over all days."""

import hashlib
import random

import pytest
from pyspark.sql import functions as F

from stratograph.llm import dimension_history

SCHEMA = "key long, kind string, start long, stop long, value string, at long, last int, `a.b` int"


def walk(changes, days):
    """Versions of (key, kind, start, stop, value, at), one day at a time."""
    out = set()
    for key in {c[0] for c in changes if c[0] is not None}:
        mine = sorted((c for c in changes if c[0] == key and c[2] is not None and c[1] in ("update", "delete", "correction")), key=lambda c: (c[5], c[4] is not None, c[4] or "", c[1] == "delete"))
        day_of = {}
        for d in days:
            late = [c for c in mine if c[1] == "correction" and c[3] is not None and c[2] <= d < c[3]]
            base = [c for c in mine if c[1] != "correction" and c[2] <= d]
            if late:
                day_of[d] = late[-1][4]
            elif base:
                top = max(c[2] for c in base)
                now = [c for c in base if c[2] == top][-1]
                if now[1] == "update":
                    day_of[d] = now[4]
        version, prior = 0, None
        for d in [*days, days[-1] + 1]:
            same = d in day_of and prior is not None and prior[2] == day_of[d]
            if prior is not None and not same:
                version += 1
                out.add((key, version, prior[1], None if d > days[-1] and d - 1 in day_of else d, prior[2]))
                prior = None
            if d in day_of and not same:
                prior = (key, d, day_of[d])
    return out


def got(spark, rows, order=("at",)):
    df = spark.createDataFrame([(*r, 0, 0) for r in rows], SCHEMA)
    found = dimension_history.versions(df, list(order)).collect()
    assert len(found) == len(set(found))
    return {tuple(r) for r in found}


def test_runs():
    for bits in [0, 1, 2, 5, 0b1110110, (1 << 200) - 1, 0b101 << 150]:
        text = bin(bits)[2:][::-1]
        want, i = [], 0
        while i < len(text):
            if text[i] == "1":
                j = i
                while j < len(text) and text[j] == "1":
                    j += 1
                want.append((i, j))
                i = j
            else:
                i += 1
        assert list(dimension_history.runs(bits)) == (want if bits else [])


@pytest.mark.parametrize("seed", range(4))
def test_versions_equal_a_walk_over_days(spark, seed):
    r = random.Random(seed)
    rows = []
    for at in range(600):
        start = r.randrange(-5, 40)
        kind = r.choice(["update", "update", "delete", "correction", "correction"])
        rows.append((r.randrange(60), kind, start, start + r.randrange(1, 12), r.choice(["a", "b", "c", None]), at))
    r.shuffle(rows)
    assert got(spark, rows) == walk(rows, range(-8, 80))


def test_odd_changes(spark):
    rows = [
        (1, "update", 5, None, None, 0), (1, "update", 9, None, None, 1), (1, "delete", 12, None, "x", 2),  # null is a value; equal neighbours are one
        (2, "correction", 3, 3, "x", 0), (2, "correction", 3, None, "x", 0),  # cover nothing
        (3, "update", 1, None, "a", 7), (3, "update", 1, None, "b", 7), (3, "update", 1, None, None, 7),  # ties: the largest value
        (4, "delete", 0, None, None, 0),  # never present
        (5, "correction", 10, 20, "c", 0),  # a correction alone
        (6, "update", 0, None, "u", 0), (6, "correction", 10, 20, "u", 1),  # of the same value
        (7, "update", 0, None, "u", 0), (7, "correction", 10, 20, "w", 1), (7, "update", 30, None, "u", 2),
        (None, "update", 0, None, "n", 0), (8, "update", None, None, "n", 0), (9, "other", 0, None, "n", 0), (9, None, 0, None, "n", 0),
        (10, "update", 1 << 40, None, "far", 0), (10, "correction", -(1 << 40), 1 << 41, "wide", 1),
    ]
    assert got(spark, rows) == {
        (1, 1, 5, 12, None), (3, 1, 1, None, "b"), (5, 1, 10, 20, "c"), (6, 1, 0, None, "u"),
        (7, 1, 0, 10, "u"), (7, 2, 10, 20, "w"), (7, 3, 20, None, "u"), (10, 1, -(1 << 40), 1 << 41, "wide"), (10, 2, 1 << 41, None, "far"),
    }


def test_nothing(spark):
    assert dimension_history.versions(spark.createDataFrame([], SCHEMA), ["at"]).count() == 0
    assert dimension_history.document_history(spark.createDataFrame([], "doc_id long, source string")).count() == 0


def test_a_hot_key_leaves_a_row_for_each_interval(spark):
    """However many changes one key has, a task gets those that can matter."""
    rows = spark.range(200_000).select(F.lit(1).cast("long").alias("key"), F.when(F.col("id") % 3 == 0, "correction").otherwise("update").alias("kind"), (F.col("id") % 50).alias("start"), (F.col("id") % 50 + 10).alias("stop"), F.col("id").cast("string").alias("value"), F.col("id").alias("at"))
    found = dimension_history.versions(rows, ["at"])
    last = {}
    for i in range(199_000, 200_000):
        last["correction" if i % 3 == 0 else "update", i % 50] = i
    changes = [(1, k, s, s + 10, str(i), i) for (k, s), i in last.items()]
    assert {tuple(r) for r in found.collect()} == walk(changes, range(0, 70))


def test_documents_equal_a_walk_over_days(spark):
    r = random.Random(5)
    docs = [(i if i % 7 else i - 3, r.choice(["s0", "s1", None]), "x", 1) for i in range(300)] + [(None, "s0", "x", 1), (12, "s9", "x", 1), (12, "s9", "x", 1), (10**15 + 3, "far", "x", 1)]
    changes = []
    for doc, source, *_ in docs:
        for j in (0, 1):
            if doc is not None:
                h = int(hashlib.sha256(f"{doc}:{j}".encode()).hexdigest()[:12], 16)
                kind = "delete" if h // 1000 % 10 < 2 else "correction" if h // 1000 % 10 < 5 else "update"
                changes.append((doc - (doc % 10 if doc >= 0 else -(-doc % 10)), kind, h % 60, h % 60 + 10, source, (h, doc, j)))
    found = dimension_history.document_history(spark.createDataFrame(docs, "doc_id long, source string, key string, `a.b` int"))
    assert found.columns == ["doc_id", "version", "valid_from", "valid_to", "value"]
    assert {tuple(x) for x in found.collect()} == walk(changes, range(0, 75))

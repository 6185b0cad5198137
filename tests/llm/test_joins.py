"""Near-duplicate documents and vectors against all pairs."""

import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from stratograph.llm import common, embedding_dedup, ngram_join


def closure(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


def shingles(text, n):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0d]+", low)
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_copies(seed, n):
    r = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    base = [[r.choice(vocabulary) for _ in range(r.randint(3, 120))] for _ in range(8)]
    out = []
    for i in range(n):
        words = list(r.choice(base))
        for _ in range(r.randint(0, 4)):
            words[r.randrange(len(words))] = r.choice(vocabulary).lower()
        out.append((i, r.choice([" ", "\n", "  "]).join(words)))
    return out


@pytest.mark.parametrize(("n", "num"), [(3, 90), (5, 80), (1, 50)])
def test_documents_match_all_pairs(spark, n, num):
    rows = near_copies(n, 120) + [(900, None), (901, ""), (902, " \t"), (903, "one"), (904, "ONE"), (905, "one two")]
    docs = spark.createDataFrame([(i, t, 1, 2) for i, t in rows], "doc_id long, text string, node int, n int")
    sets = {i: shingles(t, n) for i, t in rows}
    ids = list(sets)
    edges = [(a, b) for a in ids for b in ids if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= num * len(sets[a] | sets[b]) and sets[b]]
    want = closure(ids, edges)
    got = ngram_join.link_documents(docs, n, num, 100).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == {i: (len(sets[i]), want[i]) for i in ids}


def test_members_of_a_group_meet_other_groups(spark):
    r = random.Random(3)
    body = [f"b{i}" for i in range(37)]
    first = {day: ["published", "on", day, "by", "staff"] for day in ("monday", "tuesday")}
    rows = [(0, first["tuesday"] + body), (1, first["monday"] + body), (2, first["monday"] + body[:-1] + ["other"])]
    rows += [(10 + i, first["monday" if i % 2 else "tuesday"] + [f"c{r.randrange(10**9)}" for _ in range(30)]) for i in range(100)]
    rows = [(i, " ".join(words)) for i, words in rows]
    sets = {i: shingles(t, 3) for i, t in rows}
    ids = list(sets)
    want = closure(ids, [(a, b) for a in ids for b in ids if a < b and 100 * len(sets[a] & sets[b]) >= 90 * len(sets[a] | sets[b])])
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert want[2] == 1 and want[1] == 1
    assert {r["doc_id"]: r["component_id"] for r in got} == want


def test_crowd_of_near_copies_is_one_component(spark):
    base = [f"w{i}" for i in range(200)]
    rows = []
    for i in range(150):
        words = list(base)
        words[i] = f"edit{i}"
        rows.append((i, " ".join(words)))
    got = ngram_join.link_documents(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r["component_id"] for r in got} == {0}


def test_one_of_each_group_stays_with_all_columns(spark):
    rows = [(1, "a b c d e f g", "x"), (2, "a b c d e f g", "y"), (3, "quite other words are in here", "z"), (3, "quite other words are in here", "z"), (None, "n", "q"), (4, None, "e")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    kept = ngram_join.keep_one(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or -1) for r in kept.collect()) == [-1, 1, 3, 4]


def test_empty_documents(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert ngram_join.link_documents(empty).count() == 0 and ngram_join.keep_one(empty).count() == 0


def clustered(seed, n):
    r = np.random.default_rng(seed)
    centres = r.normal(size=(12, 16))
    x = np.concatenate([r.normal(size=(n // 2, 16)), centres[r.integers(0, 12, n // 2)] + 0.2 * r.normal(size=(n // 2, 16))])
    x[5] = x[4]
    x[6] = x[4] * 3
    return x.astype(np.float32)


def test_vectors_match_all_pairs(spark, monkeypatch):
    for name, value in (("CELL", 40), ("NATIVES", 30), ("VISITORS", 100)):
        monkeypatch.setattr(embedding_dedup, name, value)
    x = clustered(1, 300)
    u = x.astype(np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    near = u @ u.T >= 0.95
    np.fill_diagonal(near, False)
    want = closure(range(300), zip(*map(list, map(lambda a: a.tolist(), np.nonzero(near)))))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    rows += [(900, None), (901, [0.0] * 16), (902, [float("nan")] * 16), (903, [float("inf")] + [1.0] * 15), (904, [1.0]), (905, [None] * 16), (None, x[4].tolist())]
    got = embedding_dedup.links(spark.createDataFrame([(*r, 1) for r in rows], "vec_id long, embedding array<float>, rep int")).collect()
    by = {r["vec_id"]: r for r in got}
    assert len(got) == len(rows) and near.sum() > 100
    assert all(by[i]["n_links"] == near[i].sum() and by[i]["component_id"] == want[i] for i in range(300))
    assert all((by[i]["n_links"], by[i]["component_id"], by[i]["kept"]) == (0, i, True) for i in range(900, 906))
    assert by[None]["n_links"] == 0 and by[None]["component_id"] is None


def test_vectors_of_each_length_link(spark):
    r = np.random.default_rng(2)
    rows, want = [], {}
    for dim, first in ((16, 0), (8, 100), (3, 200)):
        base = r.normal(size=(10, dim))
        x = np.concatenate([base, base + 0.05 * r.normal(size=base.shape), base[:3]])[: 23 if dim < 16 else 20]
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        near = u @ u.T >= 0.95
        np.fill_diagonal(near, False)
        reached = closure(range(len(x)), zip(*(a.tolist() for a in np.nonzero(near))))
        rows += [(first + i, v.tolist()) for i, v in enumerate(x)]
        want |= {first + i: (int(near[i].sum()), first + reached[i], reached[i] == i) for i in range(len(x))}
    rows += [(300, [1.0]), (301, [1.0, 2.0]), (302, [1.0, 2.0])]
    want |= {300: (0, 300, True), 301: (1, 301, True), 302: (1, 301, False)}
    got = embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x["vec_id"]: tuple(x)[1:] for x in got} == want


@pytest.mark.parametrize(("cell", "natives"), [(100_000, 100_000), (300, 200)])
def test_chains_of_vectors_stay_whole(spark, monkeypatch, cell, natives):
    monkeypatch.setattr(embedding_dedup, "CELL", cell)
    monkeypatch.setattr(embedding_dedup, "NATIVES", natives)
    r = np.random.default_rng(5)
    ids = r.permutation(2500).tolist()
    turn = 0.3 * np.arange(5)  # chains of five: neighbours link (cosine 0.955), others do not
    rows, want = [], {}
    for c in range(500):
        u, v = np.linalg.qr(r.normal(size=(64, 2)))[0].T
        chain = ids[5 * c : 5 * c + 5]
        rows += [(i, (np.cos(t) * u + np.sin(t) * v).tolist()) for i, t in zip(chain, turn)]
        want |= {i: (1 if k in (0, 4) else 2, min(chain), i == min(chain)) for k, i in enumerate(chain)}
    rows = [rows[i] for i in r.permutation(len(rows))]
    got = embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {x["vec_id"]: tuple(x)[1:] for x in got} == want


def test_crowd_of_equal_vectors(spark):
    rows = [(i, [1.0, 2.0]) for i in range(50)] + [(99, [-1.0, 0.0])]
    got = {r["vec_id"]: tuple(r)[1:] for r in embedding_dedup.links(spark.createDataFrame(rows, "vec_id long, embedding array<float>")).collect()}
    assert got[0] == (49, 0, True) and got[49] == (49, 0, False) and got[99] == (0, 99, True)


def test_no_vectors(spark):
    assert embedding_dedup.links(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0


def test_components_of_a_long_chain(spark):
    chain = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = common.components(chain).collect()
    assert len(got) == 201 and {r["component"] for r in got} == {0}

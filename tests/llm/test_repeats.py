"""Byte and word repeats against a dictionary of windows."""

import random

import pytest
from pyspark.sql import functions as F

from stratograph.llm import exchange, substring_dedup, suffix_dedup

SCHEMA = "doc_id long, text string, spans string, block int"  # the last two clash with inner names


def corpus(seed, n, alphabet):
    r = random.Random(seed)
    base = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 300))) for _ in range(4)]
    out = []
    for i in range(n):
        t = r.choice(base)
        a = r.randint(0, len(t))
        t = t[a : r.randint(a, len(t))] + "".join(r.choice(alphabet) for _ in range(r.randint(0, 30))) + r.choice(base)[: r.randint(0, 200)]
        out.append((i, "a" * r.randint(0, 200) + t if r.random() < 0.2 else t))
    return out


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(exchange, "BLOCK", 2000)


@pytest.mark.parametrize(("length", "alphabet"), [(20, "ab"), (40, "abc \n"), (100, "abé ")])
def test_bytes_match_brute_force(spark, length, alphabet):
    rows = corpus(length, 60, alphabet) + [(1000, None), (1001, ""), (1002, "short"), (1003, "xy" * 3000)]
    got = suffix_dedup.digest(suffix_dedup.repeated_spans(frame(spark, rows), length)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == suffix_dedup.brute_force([(i, (t or "").encode()) for i, t in rows], length)


@pytest.mark.parametrize(("window", "alphabet"), [(5, "ab "), (20, "abc \n\t")])
def test_words_match_brute_force(spark, window, alphabet):
    rows = corpus(window, 60, alphabet) + [(1000, None), (1001, " \n "), (1002, "a b"), (1003, "the " * 500), (1004, "p q " * 300)]
    got = substring_dedup.digest(substring_dedup.repeated_words(frame(spark, rows), window)).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == substring_dedup.brute_force([(i, (t or "").encode()) for i, t in rows], window)


def test_passage_shared_by_many_stays_once(spark):
    passage = " ".join(f"word{i}" for i in range(60))
    rows = [(i, f"own{i} text{i} {passage} end{i}") for i in range(30)]
    got = {r["doc_id"]: r["n_removed"] for r in substring_dedup.repeated_words(frame(spark, rows)).collect()}
    assert got.pop(0) == 0 and set(got.values()) == {60}


def test_spans_are_the_removed_bytes(spark):
    text = "".join(random.Random(5).choices("abcdefgh", k=400))
    rows = [(0, text), (1, "1" * 50 + text[100:300] + "2" * 50), (2, "3")]
    got = {r["doc_id"]: r for r in suffix_dedup.repeated_spans(frame(spark, rows)).collect()}
    assert [(s["first"], s["stop"]) for s in got[1]["spans"]] == [(50, 250)]
    assert bytes(got[1]["kept"]) == b"1" * 50 + b"2" * 50 and not got[0]["spans"]


def test_repeated_rows_and_null_ids(spark):
    text = "".join(random.Random(6).choices("abcdefgh", k=150))
    got = suffix_dedup.digest(suffix_dedup.repeated_spans(frame(spark, [(7, text), (7, text), (None, text)]))).collect()
    assert sorted((r["doc_id"] is None, r["n_removed"]) for r in got) == [(False, 150), (False, 150), (True, 0)]


def test_empty_table(spark):
    empty = frame(spark, [(1, "x")]).filter(F.lit(False))
    assert suffix_dedup.repeated_spans(empty).count() == 0 and substring_dedup.repeated_words(empty).count() == 0

"""Names of any shape found in texts, against one regular expression a name."""

import random

import pytest
import regex
from pyspark.sql import functions as F

from stratograph.operators import references

W = r"[\p{L}\p{Mn}\p{Nd}\p{Pc}]"
EDGE = rf"(?:(?<={W})(?!{W})|(?<!{W})(?={W}))"


def by_patterns(rows, names):
    out = set()
    for i, t in rows:
        for name in {n for n in names if n}:
            for m in regex.finditer(EDGE + regex.escape(name, special_only=True, literal_spaces=True) + EDGE, t or ""):
                out.add((i, name, m.start(), len(name), t[max(0, m.start() - 20) : m.start() + 50].replace("\n", " ").strip()))
    return out


def got(spark, rows, names, settings=references.Settings()):
    texts = spark.createDataFrame(rows, "id long, t string").withColumn("name", F.lit("clash"))
    found = references.places(texts.repartition(3), spark.createDataFrame([(n,) for n in names], "name string"), settings=settings)
    return [tuple(r) for r in found.collect()]


def test_names_of_several_words(spark):
    rows = [(1, "The User Service calls my-lib and Redis"), (2, "UserService, my-library; Redis-like f(x)g [User Service]")]
    names = ["User Service", "my-lib", "Redis", "(x)", "f(x)", "C++", None, ""]
    found = got(spark, rows, names)
    assert sorted(f[:3] for f in found) == [(1, "Redis", 34), (1, "User Service", 4), (1, "my-lib", 23), (2, "(x)", 37), (2, "Redis", 25), (2, "User Service", 43), (2, "f(x)", 36)]
    assert set(found) == by_patterns(rows, names)


@pytest.mark.parametrize("seed", range(3))
def test_places_equal_patterns(spark, seed):
    s = references.Settings(characters=200, least=7, most=7) if seed else references.Settings()  # a crowded table lets much through that is no name
    r = random.Random(seed)
    pieces = ["a", "b", "ab", "é", "ñ_1", " ", ".", "-", "((", "\n", "ü", "x9", "\U0001d54f", "́", "漢", "  ", "ªº", "²"]
    rows = [(i, "".join(r.choice(pieces) for _ in range(r.randint(0, 60)))) for i in range(150)] + [(900, None), (901, "")]
    names = ["".join(r.choice(pieces) for _ in range(r.randint(1, 6))) for _ in range(120)] + ["a a", "a.a", "b", " ", "."]
    found = got(spark, rows, names, s)
    assert len(found) == len(set(found)) and set(found) == by_patterns(rows, names)
    texts = spark.createDataFrame(rows, "id long, t string")
    counts = {(x["id"], x["name"]): x["n"] for x in references.counted(texts, spark.createDataFrame([(n,) for n in names], "name string"), s).collect()}
    want = {}
    for f in found:
        want[f[:2]] = want.get(f[:2], 0) + 1
    assert counts == want


def test_names_longer_than_the_table_knows(spark):
    rows = [(1, "one two three four five six"), (2, "one two three four six")]
    names = ["one two three four", "one two three four five", "two three", "three four five six", "one two three four five six seven"]
    assert set(got(spark, rows, names, references.Settings(longest=5))) == by_patterns(rows, names)


def test_one_name_does_not_overlap_itself(spark):
    found = got(spark, [(1, "a b a b a b a")], ["a b a", "b a"])
    assert sorted((f[1], f[2]) for f in found) == [("a b a", 0), ("a b a", 8), ("b a", 2), ("b a", 6), ("b a", 10)]


def test_no_names_and_no_texts(spark):
    assert got(spark, [(1, "a")], []) == [] == got(spark, [], ["a"]) == got(spark, [(1, "")], ["a"])


def test_strengths_between_components(spark):
    texts = spark.createDataFrame([("a", "Pay Gate " * 15 + "Order.Book x"), ("b", "Order.Book app.json")], "id string, t string")
    names = spark.createDataFrame([("p", "Pay Gate", "Service"), ("b", "Order.Book", "Class"), ("q", "Order.Book", "Class"), ("c", "app.json", "Configuration")], "id string, name string, type string")
    assert {tuple(r) for r in references.strengths(texts, names).collect()} == {("a", "p", 10.0), ("a", "b", 1.0), ("a", "q", 1.0), ("b", "q", 1.0)}


def test_links_from_a_table(spark):
    rows = [(1, "The User Service calls User, [User] and my-lib; User Services"), (2, None), (3, "none"), (4, "a [big User Service]"), (5, "User Service Bus")]
    links = [("User", "u.md"), ("User Service", "us.md"), ("my-lib", "lib.md"), ("my-lib", "zz.md"), ("Service Bus", "bus.md"), ("none", None)]
    found = references.enriched(spark.createDataFrame(rows, "id long, t string"), spark.createDataFrame(links, "name string, target string"))
    assert {r["id"]: r["t"] for r in found.collect()} == {
        1: "The [User Service](us.md) calls [User](u.md), [User] and [my-lib](lib.md); [User](u.md) Services",
        2: None,
        3: "none",
        4: "a [big [User](u.md) Service]",
        5: "[User Service](us.md) Bus",
    }


def test_texts_of_a_batch_are_held_in_slices(spark):
    """All texts of one batch are linked, more than a task holds at a time."""
    n = 2 * references.TEXTS + 3
    texts = spark.createDataFrame([(i, None if i == 7 else f"see Redis {i}" if i % 2 else "nothing") for i in range(n)], "id long, t string").coalesce(1)
    got = references.enriched(texts, spark.createDataFrame([("Redis", "r.md")], "name string, target string"))
    want = {i: None if i == 7 else f"see [Redis](r.md) {i}" if i % 2 else "nothing" for i in range(n)}
    assert {r["id"]: r["t"] for r in got.collect()} == want

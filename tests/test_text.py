"""Goldens of the text, quality and budget functions."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from stratograph.functions import code, prose
from stratograph.operators import architecture, quality, references


def one(spark, column, **row):
    return spark.createDataFrame([tuple(row.values())], list(row)).select(column.alias("x")).first()["x"]


def test_fixed_chunks(spark):
    t = F.col("t")
    assert one(spark, prose.fixed_chunks(t, 5, 2), t="0123456789") == ["01234", "34567", "6789"]
    assert one(spark, prose.fixed_chunks(t, 5, 0), t="0123456789") == ["01234", "56789"]
    assert one(spark, prose.fixed_chunks(t, 5, 2), t="") == []
    for size, overlap in ((0, 0), (5, 5), (5, -1)):
        with pytest.raises(ValueError):
            prose.fixed_chunks(t, size, overlap)


def test_semantic_split_keeps_what_precedes_headers():
    assert prose.semantic_split("intro\n# A\nx\n## B\ny", 100, 0) == ["intro\n# A\nx\n## B\ny"]
    assert prose.semantic_split("intro\n# A\nxxxxxxxx", 10, 2) == ["intro\n", "# A\nxxxxxx", "xxxx"]
    assert prose.semantic_split("0123456789", 5, 2) == ["01234", "34567", "6789"]


def test_line_chunks_number_lines():
    chunks = prose.line_chunks("\n".join(["x" * 39] * 30), 100)
    assert chunks[0][1:] == (1, 10) and chunks[1][1:] == (11, 20) and chunks[-1][2] == 30


def test_complexity_and_nesting(spark):
    text = "if (a) {\n for (;;) { x && y; }\n} else if (b) { }\nswitch (c) { case 1: break; }"
    assert one(spark, code.cyclomatic(F.col("t")), t=text) == 1 + 2 + 1 + 1 + 1 + 1 + 1
    assert one(spark, code.nesting_depth(F.col("t")), t=text) >= 4


@pytest.mark.parametrize(
    ("answer", "expected"),
    [("75%", 0.75), ("90 percent", 0.9), ("score: 0.85", 0.85), ("rating is 0.72", 0.72), ("give it a score of 1.2", 1.0), ("0.4 or so", 0.4), ("Yes, it does", 1.0), ("No.", 0.0), ("hard to say", 0.5), ("scores -0.2", 0.0)],
)
def test_score_parser(spark, answer, expected):
    assert one(spark, prose.score(F.col("t")), t=answer) == pytest.approx(expected)


@pytest.mark.parametrize(("name", "layer"), [("UserDTO", "Presentation"), ("UserQuery", "Application"), ("OrderEntity", "Domain"), ("SqlStore", "Data"), ("PayGateway", "Infrastructure"), ("StringHelper", "CrossCutting"), ("Foo", "Unknown")])
def test_layer_keywords(spark, name, layer):
    assert one(spark, architecture.layer(), node_id=name, type="Class") == layer


@pytest.mark.parametrize(("value", "status"), [(95.0, "Excellent"), (85.0, "Good"), (70.0, "Average"), (45.0, "Poor")])
def test_benchmark_status(spark, value, status):
    assert one(spark, quality.compared(F.col("v"), F.lit(85.0))[1], v=value) == status


def test_coverage_of_one_in_three(spark):
    pages = spark.createDataFrame([("a",)], "page_id string")
    parts = spark.createDataFrame([("a", "Class"), ("b", "Class"), ("c", "Service")], "id string, type string")
    row = quality.coverage(pages, parts).first()
    assert row["component_coverage"] == pytest.approx(33.33, abs=0.01) and row["undocumented"] == 2 and row["api_coverage"] == 0


def test_consensus_of_too_few_judges(spark):
    rows = spark.createDataFrame([(1, 80.0, 0.9), (1, 85.0, 0.8), (2, 10.0, 1.0), (2, 90.0, 1.0), (2, 50.0, 1.0)], "p int, score double, reliability double")
    got = {r["p"]: r for r in quality.consensus(rows, "p").collect()}
    assert got[1]["status"].startswith("Insufficient") and got[2]["status"] == "Low Consensus" and got[2]["score"] == pytest.approx(50)


def test_links_longest_first(spark):
    out = one(spark, references.linked(F.col("t"), {"User": "u", "UserService": "us"}), t="UserService and User and [User]")
    assert out == "[UserService](us) and [User](u) and [User]"


def test_reference_places(spark):
    texts = spark.createDataFrame([(1, "see Foo, not Foobar; Foo"), (2, "nothing")], "id long, t string")
    names = spark.createDataFrame([("Foo",)], "name string")
    assert [(r["id"], r["offset"]) for r in references.places(texts, names).orderBy("offset").collect()] == [(1, 4), (1, 21)]


def test_entities_and_first_paragraph(spark):
    text = "# T\n\n`UserService` with Redis\nand redis\n\nmore"
    e = one(spark, prose.entities(F.col("t")), t=text)
    assert e["classes"] == ["UserService"] and e["dependencies"] == ["redis"]
    assert one(spark, prose.first_paragraph(F.col("t")), t=text) == "`UserService` with Redis and redis"


def test_chunks_are_handed_on_before_the_batch_ends():
    frames = []

    class Rows:
        columns, schema = ["doc_id", "t"], []

        def mapInPandas(self, run, schema):
            frames.extend(run(iter([pd.DataFrame({"doc_id": range(500), "t": ["line of words\n" * 60] * 500})])))

    prose.chunked(Rows(), "lines", "t", most=8)
    assert sum(map(len, frames)) == 500 * len(prose.line_chunks("line of words\n" * 60, 8)) and max(map(len, frames)) < prose.CHUNKS + 100
    assert [i for f in frames for i in f.doc_id.unique()] == list(range(500))

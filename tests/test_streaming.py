"""Streams give what the same operators give on tables."""

from datetime import datetime, timedelta

from stratograph.sources.tables import markdown_context, source_files
from stratograph.streaming import events


def rows(spark):
    t = datetime(2024, 1, 1)
    return spark.createDataFrame([("a", t + timedelta(milliseconds=m)) for m in (0, 300, 700, 2000)] + [("b", t)], "key string, ts timestamp")


def test_debounce_on_stream_and_table(spark, tmp_path):
    data = rows(spark)
    expected = {(r["key"], r["n"]) for r in events.debounced(data).collect()}
    assert expected == {("a", 3), ("a", 1), ("b", 1)}
    data.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    q = events.debounced(stream).writeStream.outputMode("complete").format("memory").queryName("bursts").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {(r["key"], r["n"]) for r in spark.table("bursts").collect()} == expected


def test_foreach_batch_hands_over_everything(spark, tmp_path):
    rows(spark).write.parquet(str(tmp_path / "in"))
    seen = []
    stream = spark.readStream.schema("key string, ts timestamp").parquet(str(tmp_path / "in"))
    events.run_once(stream, lambda df, _: seen.append(df.count()), str(tmp_path / "checkpoint"))
    assert sum(seen) == 5


def test_rename_is_removal_and_addition(spark):
    df = spark.createDataFrame([(1, "renamed", "old", "new"), (2, "changed", None, "x")], "ts int, kind string, old_path string, path string")
    assert {(r["path"], r["kind"]) for r in events.renames(df).collect()} == {("old", "deleted"), ("new", "created"), ("x", "changed")}


def test_index_states():
    s = events.IndexState()
    s.begin()
    s.ready()
    s.changed("a")
    assert s.state == "Stale"
    s.indexed("a")
    assert s.state == "Ready"


def test_source_trees(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src" / "A.cs").write_text("class A {}")
    (tmp_path / "src" / "notes.txt").write_text("no code")
    (tmp_path / "README.md").write_text("# hi")
    (tmp_path / "big.md").write_text("x" * 20001)
    assert [r["content"] for r in source_files(spark, str(tmp_path)).collect()] == ["class A {}"]
    assert [r["content"] for r in markdown_context(spark, str(tmp_path)).collect()] == ["# hi"]

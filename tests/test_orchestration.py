"""Dispatch, jobs, composition, stores, states, folds and the measures that have no SQL."""

import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from stratograph.operators import agents, analytics, folds, joins, lookup
from stratograph.sources import model, parse, stores
from stratograph.sources.tables import scratch
from stratograph.streaming import events


def random_graph(spark, seed, n, m):
    r = random.Random(seed)
    arcs = [(i, f"n{r.randrange(n)}", f"n{r.randrange(n)}", "Call", 1.0) for i in range(m)]
    nodes = spark.createDataFrame([(f"n{i}", "Class") for i in range(n)], "node_id string, type string")
    g = model.build(nodes, spark.createDataFrame(arcs, "seq long, src string, dst string, type string, strength double"))
    return g, {(a, b) for _, a, b, _, _ in arcs if a != b}


def brandes(n, edges):
    out = {f"n{i}": [] for i in range(n)}
    for a, b in edges:
        out[a].append(b)
    between, close = dict.fromkeys(out, 0.0), {}
    for s in out:
        seen, paths, order, before, todo = {s: 0}, dict.fromkeys(out, 0.0), [], {v: [] for v in out}, deque([s])
        paths[s] = 1.0
        while todo:
            v = todo.popleft()
            order.append(v)
            for w in out[v]:
                if w not in seen:
                    seen[w] = seen[v] + 1
                    todo.append(w)
                if seen[w] == seen[v] + 1:
                    paths[w] += paths[v]
                    before[w].append(v)
        dep = dict.fromkeys(out, 0.0)
        for w in reversed(order):
            for v in before[w]:
                dep[v] += paths[v] / paths[w] * (1 + dep[w])
            if w != s:
                between[w] += dep[w]
        close[s] = (n - 1) / sum(seen.values()) if len(seen) == n and n > 1 else 0.0
    return between, close


@pytest.mark.parametrize(("n", "m", "batch"), [(12, 40, 5), (25, 30, 100), (6, 30, 2)])
def test_centralities_equal_brute_force(spark, monkeypatch, n, m, batch):
    monkeypatch.setattr(analytics, "SOURCES", batch)
    g, edges = random_graph(spark, n, n, m)
    between, close = brandes(n, edges)
    got = {r["node_id"]: r["betweenness"] for r in analytics.betweenness(g).collect()}
    assert got == pytest.approx(between)
    assert {r["node_id"]: r["closeness"] for r in analytics.closeness(g).collect()} == pytest.approx(close)


@pytest.mark.parametrize("pairs", [30, 200_000_000])
def test_many_sources_are_one_search_unless_they_find_too_much(spark, monkeypatch, pairs):
    written = []
    keep = analytics.cut
    monkeypatch.setattr(analytics, "cut", lambda df, what="round": written.append(what) or keep(df, what))
    monkeypatch.setattr(analytics, "SOURCES", 4)
    monkeypatch.setattr(analytics, "PAIRS", pairs)
    edges = {(i, 20 + i % 3) for i in range(20)} | {(20, 23), (21, 23), (23, 24)}
    nodes = spark.createDataFrame([(f"n{i:02}", "Class") for i in range(25)], "node_id string, type string")
    g = model.build(nodes, spark.createDataFrame([(i, f"n{a:02}", f"n{b:02}", "Call", 1.0) for i, (a, b) in enumerate(sorted(edges))], "seq long, src string, dst string, type string, strength double"))
    got = {r["node_id"]: r["betweenness"] for r in analytics.betweenness(g).collect()}
    assert got == pytest.approx({f"n{i:02}": x for i, x in enumerate([0.0] * 20 + [14.0, 14.0, 0.0, 16.0, 0.0])})
    assert (len(written) < 12) == (pairs > 30)
    written.clear()
    assert {r["closeness"] for r in analytics.closeness(g).collect()} == {0.0} and len(written) < 4  # two nodes that nothing points to


def test_searches_broadcast_nothing_and_leave_what_is_found_in_place(spark, monkeypatch):
    plans, keep = [], analytics.bucketed
    monkeypatch.setattr(analytics, "bucketed", lambda df, key, what, **how: (plans.append((what, df._jdf.queryExecution().executedPlan().toString())), keep(df, key, what, **how))[1])
    monkeypatch.setattr(analytics, "FOUND", 3)
    g, edges = random_graph(spark, 5, 16, 22)
    between, close = brandes(16, edges)
    assert {r["node_id"]: r["betweenness"] for r in analytics.betweenness(g).collect()} == pytest.approx(between)
    assert {r["node_id"]: r["closeness"] for r in analytics.closeness(g).collect()} == pytest.approx(close)
    kinds = [k for k, _ in plans]
    assert "found" in kinds and "dependencies" in kinds and not any("Broadcast" in p and k != "arcs" for k, p in plans)
    levels = [p for k, p in plans if k == "paths" and "LeftAnti" in p]
    assert levels and all(p.count("Exchange hashpartitioning") == 2 for p in levels)  # of the frontier and of what it leads to


def test_strings_within_strings(spark):
    r = random.Random(3)
    short = ["".join(r.choice("ab:") for _ in range(r.randint(0, 5))) for _ in range(60)]
    long = ["".join(r.choice("ab:c") for _ in range(r.randint(0, 12))) for _ in range(60)]
    a = spark.createDataFrame([(s,) for s in short], "s string")
    b = spark.createDataFrame([(s,) for s in long], "l string")
    got = {tuple(x) for x in lookup.contained(a, b).collect()}
    assert got == {(s, t) for s in short for t in long if s and s in t}


def test_new_keys_are_numbered_in_order(spark):
    known = spark.createDataFrame([("m", 7), ("b", 3)], "key string, id long")
    keys = spark.createDataFrame([(k,) for k in "zbaymxa"], "key string")
    assert {tuple(r) for r in joins.numbered(keys, known, "key").collect()} == {("m", 7), ("b", 3), ("a", 8), ("x", 9), ("y", 10), ("z", 11)}


def test_folds_cross_batches(spark):
    rows = spark.range(5000).select((F.col("id") % 3).cast("string").alias("k"), F.col("id").alias("i"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "100")
    try:
        out = folds.folded(rows, "k", "i", lambda: 0, lambda s, r: (s + 1, s), "nth", "long")
        assert {(r["k"], r["i"], r["nth"]) for r in out.collect()} == {(str(i % 3), i, i // 3) for i in range(5000)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_reduce_message(spark):
    contexts = spark.createDataFrame([(1, "sys", "text", True, True), (2, " ", None, True, True), (3, "s", "t", False, True), (4, "s", "t", True, False)], "id int, system string, text string, use_map_reduce boolean, hierarchical boolean")
    history = spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", "a"), (2, 0, "user", "q"), (3, 0, "user", "q")], "id int, turn int, role string, content string")
    got = sorted(map(tuple, agents.reduce_messages(contexts, history).collect()))
    assert got == [(1, 0, "system", "sys"), (1, 1, "user", "q"), (1, 2, "assistant", "a"), (1, 3, "user", "text"), (2, 0, "user", "q")]


def test_jobs_are_cancelled_at_the_next_look(spark):
    t = datetime(2024, 1, 1)
    progress = [("a", t + timedelta(seconds=s), p, n) for s, p, n in ((0, "Decomposition", 10), (3, "Evaluation", 60), (9, "Complete", 100))]
    progress += [("b", at, p, n) for _, at, p, n in progress] + [("c", t, "Content Generation", 40)]
    rows = spark.createDataFrame(progress, "job_id string, at timestamp, phase string, percent int")
    cancels = spark.createDataFrame([("a", t + timedelta(seconds=3)), ("b", t + timedelta(seconds=9, milliseconds=1)), ("d", t)], "job_id string, at timestamp")
    assert {tuple(r) for r in agents.job_states(rows, cancels).collect()} == {("a", "Cancelled", 0), ("b", "Completed", 100), ("c", "Generating", 40)}


def test_judges_need_a_judge(spark):
    pages = spark.createDataFrame([(1, "x"), (2, None)], "page_id int, content string")
    with pytest.raises(ValueError):
        agents.judged(pages, [])
    got = agents.judged(pages, [F.length("content"), F.lit(1.0)]).collect()
    assert {tuple(r) for r in got} == {(1, "Judge_1", 1.0), (1, "Judge_2", 1.0), (2, "Judge_2", 1.0)}


def test_failed_step_leaves_a_snapshot(spark):
    path = scratch(spark, "failures")

    def fails():
        raise ValueError("no graph")

    with pytest.raises(ValueError):
        agents.snapshot(fails, spark, path, "decompose")
    assert [tuple(r) for r in spark.read.json(path).select("step", "kind", "message").collect()] == [("decompose", "ValueError", "no graph")]


def test_resumed_step_runs_once(spark):
    path, runs = scratch(spark, "step"), []

    def step():
        runs.append(1)
        return spark.range(3)

    assert [agents.resumable(step, spark, path).count() for _ in range(2)] == [3, 3] and len(runs) == 1


def test_refresh_scopes(spark):
    nodes = spark.createDataFrame([("a", "x/A.cs"), ("b", "x/y/B.cs"), ("c", "xy/C.cs")], "node_id string, file_path string")
    arcs = spark.createDataFrame([(0, "a", "b", "Call", 1.0), (1, "c", "a", "Call", 1.0)], "seq int, src string, dst string, type string, strength double")
    g = model.Graph(nodes, arcs.select("src", "dst", "type", "strength"), arcs.select("src", "dst"))
    none, no_arcs = nodes.limit(0), g.edges.limit(0)
    left = {s: {r[0] for r in events.refreshed(g, *s, none, no_arcs).nodes.select("node_id").collect()} for s in (("all", None), ("file", "X/a.cs"), ("directory", "x"))}
    assert left == {("all", None): set(), ("file", "X/a.cs"): {"b", "c"}, ("directory", "x"): {"c"}}
    for wrong in (("file", None), ("somewhere", "x")):
        with pytest.raises(ValueError):
            events.refreshed(g, *wrong, none, no_arcs)


def test_sqlite_round_trip(spark, tmp_path):
    stores.use_sqlite(spark)
    rows = [(1, "a'b", 0.5), (2, None, None), (3, "ü", -1.0)]
    df = spark.createDataFrame(rows, "id long, `na\"me` string, x double").coalesce(1)
    for mode, times in (("append", 1), ("append", 2), ("overwrite", 1)):
        df.write.format("sqlite").options(path=str(tmp_path / "db"), table="t").mode(mode).save()
        assert sorted(map(tuple, spark.read.format("sqlite").options(path=str(tmp_path / "db"), table="t").load().collect()), key=str) == sorted(rows * times, key=str)


def test_vector_store(spark):
    store = stores.VectorStore(spark, scratch(spark, "store"))
    store.create("c", 2)
    rows = spark.createDataFrame([(1, [1.0, 0.0], "a", {"k": "x"}), (2, [0.0, 1.0], "b", {"k": "y"}), (3, [1.0], "c", {"k": "x"})], "doc_id long, embedding array<float>, text string, payload map<string,string>")
    store.upsert("c", rows)
    store.upsert("c", rows.filter("doc_id = 2").withColumn("text", F.lit("new")))
    assert [(r["doc_id"], r["text"]) for r in store.search("c", [0.0, 1.0], 5).orderBy("rank").collect()] == [(2, "new"), (1, "a")]
    store.delete("c", {"k": "x"})
    assert [r["doc_id"] for r in store.rows("c").collect()] == [2]
    store.drop("c")
    store.create("c", 2)
    assert store.rows("c").count() == 0


def test_parser_that_fails_leaves_out_its_file(spark):
    calls = []

    def parser(path, lang, text):
        calls.append(path)
        if "bad" in path:
            raise ValueError("cannot parse")
        return [(path, "File", path, 1, 1)], []

    nodes, _ = parse.parsed(spark.createDataFrame([("bad.cs", "x"), ("good.cs", "y")], "path string, content string"), {"C#": parser})
    assert [r["node_id"] for r in nodes.collect()] == ["good.cs"]


def test_parser_is_linear_on_prose():
    nodes, _ = parse.parse_file("a.cs", "C#", "some words about a class and more (of it), " * 3_000)
    assert nodes[0][1] == "File"

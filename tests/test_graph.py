"""Goldens of the graph operators, worked out by hand."""

import pytest
from pyspark.sql import functions as F

from stratograph.operators import analytics, clustering, lookup, traverse
from stratograph.sources import index, model


def build(spark, arcs, nodes=None):
    ids = sorted(nodes or {x for a in arcs for x in a[:2]})
    n = spark.createDataFrame([(i, "Class", i, "C#", f"src/{i}.cs", 10, 5) for i in ids], "node_id string, type string, name string, language string, file_path string, line_count int, complexity int")
    rows = [(k, a[0], a[1], a[2] if len(a) > 2 else "Dependency", 1.0) for k, a in enumerate(arcs)]
    return model.build(n, spark.createDataFrame(rows, "seq int, src string, dst string, type string, strength double"))


def members(spark, **kinds):
    return spark.createDataFrame([(n, c) for c, ns in kinds.items() for n in ns], "node_id string, community string")


def values(df, *columns):
    return {tuple(r[c] for c in columns[:-1]) if len(columns) > 2 else r[columns[0]]: r[columns[-1]] for r in df.collect()}


def test_modularity_of_perfect_and_poor_splits(spark):
    g = build(spark, [("A", "B"), ("B", "A"), ("X", "Y"), ("Y", "X")])
    row = analytics.modularity(g, members(spark, a="AB", x="XY")).first()
    assert row["modularity"] == pytest.approx(0.0) and row["modularity_newman"] == pytest.approx(0.5)
    g = build(spark, [("A", "B"), ("B", "C"), ("C", "D")])
    assert analytics.modularity(g, members(spark, a="AC", x="BD")).first()["modularity"] == pytest.approx(-0.5)


def test_conductance_and_density(spark):
    arcs = [(a, b) for a in "ABC" for b in "ABC" if a != b] + [("X", "Y"), ("Y", "Z"), ("A", "X")]
    g = build(spark, arcs)
    m = members(spark, s="ABC", r="XYZ")
    assert values(analytics.conductance(g, m), "community", "conductance")["s"] == pytest.approx(0.2)
    assert values(analytics.internal_density(g, m), "community", "density")["s"] == 1.0
    loose = build(spark, [("A", "X"), ("A", "Y"), ("B", "X"), ("B", "Y")])
    assert values(analytics.conductance(loose, members(spark, s="AB", r="XY")), "community", "conductance")["s"] == 1.0


def test_clustering_evaluation(spark):
    g = build(spark, [("A", "B"), ("B", "A"), ("C", "D"), ("D", "C")])
    row = analytics.evaluate(g, members(spark, a="AB", c="CD")).first()
    assert [row[c] for c in ("modularity", "conductance", "density", "composite")] == pytest.approx([0.0, 0.0, 1.0, 0.5])


def test_page_rank_chain(spark):
    g = build(spark, [("M", "B"), ("B", "C")])
    ranks = values(analytics.page_rank(g), "node_id", "rank")
    assert ranks == pytest.approx({"M": 0.05, "B": 0.0925, "C": 0.128625})


def test_repeated_arc_counts_in_degrees_only(spark):
    g = build(spark, [("A", "B", "Call"), ("A", "B", "Contains"), ("A", "Q")], nodes={"A", "B"})
    assert [(r["type"],) for r in g.edges.collect()] == [("Call",)]
    assert values(analytics.degrees(g), "node_id", "fan_out")["A"] == 2


def test_strong_and_weak_components(spark):
    arcs = [("A", "B"), ("B", "C"), ("C", "A"), ("C", "D"), ("E", "F"), ("F", "E"), ("D", "E"), ("G", "G")]
    g = build(spark, arcs)
    assert values(analytics.strong_components(g.nodes, g.edges), "node_id", "component") == {"A": "A", "B": "A", "C": "A", "E": "E", "F": "E"}
    assert set(values(analytics.components(g.nodes, g.edges), "node_id", "component").values()) == {"A", "G"}


def test_long_chain_is_one_component(spark):
    arcs = [(f"n{i:03}", f"n{i + 1:03}") for i in range(60)]
    g = build(spark, arcs)
    assert set(values(analytics.components(g.nodes, g.edges), "node_id", "component").values()) == {"n000"}


def test_centralities(spark):
    g = build(spark, [("A", "B"), ("B", "C"), ("A", "D"), ("D", "C")])
    assert values(analytics.betweenness(g), "node_id", "betweenness") == {"A": 0.0, "B": 0.5, "C": 0.0, "D": 0.5}
    assert values(analytics.closeness(g), "node_id", "closeness") == pytest.approx({"A": 3 / 4, "B": 0.0, "C": 0.0, "D": 0.0})


def test_traversal_survives_cycles_and_aliases(spark):
    g = build(spark, [("A", "B", "Call"), ("B", "C", "MethodCall"), ("C", "A", "Call"), ("C", "X", "Contains")])
    rows = values(traverse.hierarchy(g, "A", ("Calls",), "out", 5), "node_id", "depth")
    assert rows == {"B": 1, "C": 2}


def test_communities_are_connected_and_cover_all_nodes(spark):
    arcs = [(a, b) for g in ("ABCD", "WXYZ") for a in g for b in g if a < b] + [("D", "W")]
    g = build(spark, arcs)
    found = values(clustering.communities(g), "node_id", "community")
    assert set(found) == set("ABCDWXYZ")
    assert len({found[x] for x in "ABCD"}) == 1 and found["A"] != found["Z"]


def test_files_removed_with_their_edges(spark):
    g = build(spark, [("A", "B"), ("B", "C")])
    out = model.without_files(g, spark.createDataFrame([("SRC/b.cs",)], "file_path string"))
    assert out.nodes.count() == 2 and out.edges.count() == 0 and out.adjacency.count() == 0


def test_json_index_round_trip(spark):
    g = build(spark, [("A", "B", "Call"), ("B", "C")])
    back = index.from_json(index.to_json(g))
    assert back.nodes.exceptAll(g.nodes.select(back.nodes.columns)).isEmpty() and back.edges.count() == 2


def test_names_and_gate(spark):
    n = spark.createDataFrame([("a::Foo",), ("b.foo",), ("xfoo",), ("FOO",)], "node_id string").withColumn("type", F.lit("Class"))
    assert {r[0] for r in lookup.by_name(n, "Foo").collect()} == {"a::Foo", "b.foo", "FOO"}
    assert lookup.query_gate("Ready", 3) == {"allowed": False, "reason": "3 files pending", "wait_seconds": pytest.approx(0.3)}
    assert lookup.query_gate("Ready", 0)["allowed"]


def test_grams_of_strings_are_never_broadcast(spark):
    ids = spark.range(300).selectExpr("concat('part::', id) as l")
    found = lookup.contained(ids.selectExpr("substr(l, 3, 5) as s"), ids)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastExchange" not in plan and "SortMergeJoin" in plan
    assert found.filter("s = 'rt::2'").count() == 111


def rows_of(monkeypatch, module, name):
    """Rows of the tables that a function of a module writes, by what they are."""
    found, keep = {}, getattr(module, name)

    def count(df, *what):
        table = keep(df, *what)
        found[what[-1]] = found.get(what[-1], 0) + table.count()
        return table

    monkeypatch.setattr(module, name, count)
    return found


def test_components_move_arcs_a_few_times(spark, monkeypatch):
    arcs = [(f"n{a:03}", f"n{(a * 7 + b) % 200:03}") for a in range(200) for b in range(6)] + [("x", "y"), ("z", "y"), ("z", "w")]
    g, found = build(spark, arcs), rows_of(monkeypatch, analytics, "cut")
    got = values(analytics.components(g.nodes, g.edges), "node_id", "component")
    assert set(got.values()) == {"n000", "w"} and len(got) == 204 and found["arcs"] < len(arcs) / 2


def test_rank_of_nodes_that_nothing_points_to_is_dealt_once(spark, monkeypatch):
    arcs = [(f"s{i:02}", f"p{i % 3}") for i in range(50)] + [("p0", "p1"), ("p1", "p2"), ("p2", "p1"), ("s00", "p0")]
    g, found = build(spark, arcs), rows_of(monkeypatch, analytics, "bucketed")
    got = values(analytics.page_rank(g, tolerance=1e-12), "node_id", "rank")
    ranks = dict.fromkeys(got, 1 / 53)
    out = {n: sum(a == n for a, _ in arcs) for n in got}
    for _ in range(200):
        ranks = {n: 0.15 / 53 + 0.85 * sum(ranks[a] / out[a] for a, b in arcs if b == n) for n in got}
    assert got == pytest.approx(ranks, rel=1e-6) and found == {"shares": 3}


def test_arcs_stay_in_place_while_communities_move(spark, monkeypatch):
    arcs = [(a, b) for g in ("ABCD", "WXYZ") for a in g for b in g if a < b] + [("D", "W")]
    found = rows_of(monkeypatch, clustering, "bucketed")
    assert len(values(clustering.communities(build(spark, arcs)), "node_id", "community")) == 8 and found == {"arcs": 26}


def test_evaluation_from_one_table_of_arcs_between_communities(spark):
    """The same figures as each measure alone, with repeated arcs, loops and nodes of no community; arcs are counted before they move on."""
    import random

    r = random.Random(4)
    ids = [f"n{i}" for i in range(30)]
    g = build(spark, [(r.choice(ids), r.choice(ids)) for _ in range(200)] * 2, ids)
    m = spark.createDataFrame([(x, f"c{i % 4}") for i, x in enumerate(ids[:26])] + [("outside", "c9")], "node_id string, community string")
    got = analytics.evaluate(g, m).first()
    assert got["modularity"] == pytest.approx(analytics.modularity(g, m).first()["modularity"])
    for name, rows in (("conductance", analytics.conductance(g, m)), ("density", analytics.internal_density(g, m))):
        assert got[name] == pytest.approx(rows.agg(F.avg(name)).first()[0])
    between = analytics._between(g, m).collect()
    assert sum(x["arcs"] for x in between) == g.adjacency.count() and sum(x["edges"] for x in between) == g.edges.count() and len(between) <= 25

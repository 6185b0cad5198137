"""Queries over traversals and graph analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, architecture, traverse, trees
from ..registry import Registry
from ..sources import model
from ..sources.tables import table
from .bindings import on_graph

R = Registry()


def _walk(root: str, types: str, way: str, depth: int) -> str:
    a, b = ("src", "dst") if way == "out" else ("dst", "src")
    return f"""w_{way} AS (SELECT '{root}' AS node_id, 0 AS depth UNION SELECT e.{b}, depth + 1 FROM w_{way} w JOIN edges e ON e.{a} = w.node_id
      WHERE depth < {depth} AND e.type IN ({types}))"""


def _tree(root: str, types: str, depth: int, *ways: str) -> str:
    each = [f"SELECT node_id, min(depth) AS depth, '{w}' AS direction FROM w_{w} WHERE node_id <> '{root}' GROUP BY node_id" for w in ways]
    return on_graph(" UNION ALL ".join(each), *[_walk(root, types, w, depth) for w in ways])


@R.query("g13_call_hierarchy", _tree("part::4", "'Call', 'MethodCall'", 5, "out", "in"))
def g13(spark, sf_dir):
    """Callers and callees of a node, five steps either way."""
    return traverse.hierarchy(model.graph(spark, sf_dir), "part::4", ("Calls",), "both", 5)


@R.query("g14_dependency_tree", _tree("part::1023", "'Dependency'", 3, "out"))
def g14(spark, sf_dir):
    """What a node depends on, three steps deep."""
    return traverse.hierarchy(model.graph(spark, sf_dir), "part::1023", ("DependsOn",), "out", 3)


@R.query("g15_type_hierarchy", _tree("part::2", "'Inheritance', 'Implementation'", 10, "out", "in"))
def g15(spark, sf_dir):
    """Ancestors and descendants of a type."""
    return traverse.hierarchy(model.graph(spark, sf_dir), "part::2", ("Inherits", "Implements"), "both", 10)


def _levels(name: str, types: str, depth: int, *ways: str) -> str:
    """The levels of a walk one after another, each without what those before it met."""
    out, parts = [f"root AS (SELECT min(node_id) AS node_id FROM nodes WHERE lower(node_id) = '{name}' OR lower(node_id) LIKE '%::{name}' OR lower(node_id) LIKE '%.{name}')"], []
    for w in ways:
        a, b = ("src", "dst") if w == "out" else ("dst", "src")
        out.append(f"{w}_arc AS MATERIALIZED (SELECT DISTINCT {a} AS src, {b} AS dst FROM edges WHERE type IN ({types}))")
        out.append(f"{w}_0 AS (SELECT node_id, NULL::VARCHAR AS parent_id, [node_id] AS path, false AS again FROM root)")
        for k in range(1, depth + 1):
            known = " UNION ALL ".join(f"SELECT node_id FROM {w}_{j} WHERE NOT again" for j in range(k))
            out.append(f"""{w}_{k} AS MATERIALIZED (SELECT dst AS node_id, src AS parent_id, list_append(path, dst) AS path, dst IN ({known}) OR src <> min(src) OVER (PARTITION BY dst) AS again FROM {w}_arc JOIN {w}_{k - 1} l ON l.node_id = src AND NOT l.again)""")
            parts.append(f"SELECT node_id, parent_id, {k} AS depth, array_to_string(path, '>') AS path, again, '{w}' AS direction FROM {w}_{k}")
    return on_graph(" UNION ALL ".join(parts), *out)


def _tree_rows(found):
    return found.select("node_id", "parent_id", "depth", F.array_join("path", ">").alias("path"), "again", "direction")


@R.query("g13_call_tree", _levels("part::4", "'Call', 'MethodCall'", 5, "out", "in"))
def g13_tree(spark, sf_dir):
    """Callers and callees of the first node of a name, with their paths."""
    return _tree_rows(trees.hierarchy_tree(model.graph(spark, sf_dir), "PART::4", ("Calls",), "both", 5))


@R.query("g14_dependency_paths", _levels("part::1023", "'Dependency'", 3, "out", "in"))
def g14_tree(spark, sf_dir):
    """What a node depends on and what depends on it, with paths."""
    return _tree_rows(trees.hierarchy_tree(model.graph(spark, sf_dir), "part::1023", ("DependsOn",), "both", 3))


@R.query("g15_type_tree", _levels("part::2", "'Inheritance', 'Implementation'", 10, "out", "in"))
def g15_tree(spark, sf_dir):
    """Ancestors and descendants of a type, with their paths."""
    return _tree_rows(trees.hierarchy_tree(model.graph(spark, sf_dir), "part::2", ("Inherits", "Implements"), "both", 10))


@R.query("a01_fan_in_fan_out", on_graph("""SELECT n.node_id, coalesce(i, 0) AS fan_in, coalesce(o, 0) AS fan_out FROM nodes n
  LEFT JOIN (SELECT dst, count(*) AS i FROM adjacency GROUP BY dst) a ON a.dst = n.node_id
  LEFT JOIN (SELECT src, count(*) AS o FROM adjacency GROUP BY src) b ON b.src = n.node_id"""))
def a01(spark, sf_dir):
    """Arcs in and out of each node, repeated ones counted."""
    return analytics.degrees(model.graph(spark, sf_dir))


@R.query("a02_node_degrees", on_graph("SELECT n.node_id, count(a.dst) AS degree FROM nodes n LEFT JOIN adjacency a ON a.dst = n.node_id GROUP BY n.node_id"))
def a02(spark, sf_dir):
    """The degree map, which holds arcs in only."""
    return analytics.degrees(model.graph(spark, sf_dir)).select("node_id", F.col("fan_in").alias("degree"))


@R.query("a03_graph_statistics", on_graph("""SELECT n AS nodes, e AS edges, e * 2.0::DOUBLE / greatest(1, n) AS average_degree,
  (SELECT max(c) FROM (SELECT count(*) AS c FROM adjacency GROUP BY dst)) AS max_in, (SELECT max(c) FROM (SELECT count(*) AS c FROM adjacency GROUP BY src)) AS max_out,
  e / (n * (n - 1))::DOUBLE AS density, CASE WHEN (SELECT count(*) FROM near) = n THEN 1 END AS components FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e)""",
  "either AS (SELECT src, dst FROM edges UNION SELECT dst, src FROM edges)", "near AS (SELECT min(node_id) AS node_id FROM nodes UNION SELECT dst FROM near JOIN either ON src = node_id)"))
def a03(spark, sf_dir):
    """Counts, degrees, density and weakly connected components of the graph."""
    return analytics.statistics(model.graph(spark, sf_dir))


@R.query("a04_language_graph_metrics", on_graph("SELECT 2.0::DOUBLE * e / (n * (n - 1)) AS density, 2.0::DOUBLE * e / n AS average_degree, n AS nodes FROM (SELECT (SELECT count(*) FROM nodes) AS n, (SELECT count(*) FROM edges) AS e)"))
def a04(spark, sf_dir):
    """The other density, which counts each edge twice."""
    g = model.graph(spark, sf_dir)
    one = g.nodes.agg(F.count("*").alias("nodes")).crossJoin(F.broadcast(g.edges.agg(F.count("*").alias("e"))))
    n, e = F.col("nodes"), F.col("e")
    return one.select((e * 2.0 / (n * (n - 1))).alias("density"), (e * 2.0 / n).alias("average_degree"), "nodes")


@R.query("a04_language_histogram", on_graph("SELECT language, count(*) AS n FROM nodes GROUP BY language"))
def a04_languages(spark, sf_dir):
    """Nodes of each language."""
    return model.nodes(spark, sf_dir).groupBy("language").agg(F.count("*").alias("n"))


_MEMBERS = "m AS (SELECT node_id, split_part(node_id, '::', 1) AS community FROM nodes)"


def _members(g):
    return g.nodes.select("node_id", F.split_part(F.col("node_id"), F.lit("::"), F.lit(1)).alias("community"))


_RANKS = """o AS (SELECT src, count(*) AS o FROM adjacency GROUP BY src),
s AS (SELECT a.src, a.dst, count(*) / any_value(o.o)::DOUBLE AS share FROM adjacency a JOIN o USING (src) GROUP BY a.src, a.dst),
c AS (SELECT count(*)::DOUBLE AS n FROM nodes),
pr AS (SELECT 0 AS it, node_id, 1 / n AS rank FROM nodes, c UNION ALL
  SELECT it + 1, node_id, 0.15 / n + 0.85 * coalesce(sum, 0) FROM (SELECT x.node_id, any_value(p.it) AS it, sum(y.rank * y.share) AS sum
    FROM nodes x CROSS JOIN (SELECT max(it) AS it FROM pr) p LEFT JOIN (SELECT s.dst, s.share, pr.rank FROM s JOIN pr ON pr.node_id = s.src) y ON y.dst = x.node_id GROUP BY x.node_id), c WHERE it < 30),
ranks AS (SELECT node_id, rank FROM pr WHERE it = 30)"""


@R.query("g07_page_rank", on_graph("SELECT node_id, round(rank, 7) AS rank FROM ranks", _RANKS))
def g07(spark, sf_dir):
    """PageRank with repeated arcs, without dealing out the rank of sinks."""
    return analytics.page_rank(model.graph(spark, sf_dir), tolerance=1e-9).select("node_id", F.round("rank", 7).alias("rank"))


@R.query("g08_importance", on_graph("""SELECT n.node_id, round(0.5 * rank + 0.3 * (coalesce(i, 0) + coalesce(o, 0)) / (2.0 * (SELECT n FROM c)) + 0.2 * complexity / 100.0, 6) AS importance
  FROM nodes n JOIN ranks USING (node_id) LEFT JOIN (SELECT dst, count(*) AS i FROM adjacency GROUP BY dst) a ON a.dst = n.node_id
  LEFT JOIN (SELECT src, count(*) AS o FROM adjacency GROUP BY src) b ON b.src = n.node_id""", _RANKS))
def g08(spark, sf_dir):
    """Rank, degree and complexity in one score."""
    g = model.graph(spark, sf_dir)
    return analytics.importance(g, analytics.page_rank(g, tolerance=1e-9)).select("node_id", F.round("importance", 6).alias("importance"))


@R.query("g09_betweenness")
def g09(spark, sf_dir):
    """Betweenness over all ordered pairs of nodes."""
    return analytics.betweenness(model.graph(spark, sf_dir))


@R.query("g10_closeness")
def g10(spark, sf_dir):
    """Closeness of every node; 0 where some node is out of reach."""
    return analytics.closeness(model.graph(spark, sf_dir))


_CYCLES = """ce AS (SELECT DISTINCT 'n' || c_nationkey AS src, 'n' || ((c_nationkey * 7 + 3) % 25) AS dst FROM customer UNION SELECT 'x1', 'n0'),
cr AS (SELECT src, dst FROM ce UNION SELECT cr.src, ce.dst FROM cr JOIN ce ON ce.src = cr.dst)"""


@R.query("g11_strong_components", on_graph("""SELECT a.src AS node_id, min(a.dst) AS component FROM cr a JOIN cr b ON a.src = b.dst AND a.dst = b.src GROUP BY a.src
  HAVING count(DISTINCT a.dst) > 1""", _CYCLES))
def g11(spark, sf_dir):
    """Strongly connected components of more than one node."""
    k = table(spark, sf_dir, "customer").select("c_nationkey").distinct()
    edges = k.select(F.concat(F.lit("n"), "c_nationkey").alias("src"), F.concat(F.lit("n"), (F.col("c_nationkey") * 7 + 3) % 25).alias("dst"))
    edges = edges.unionByName(spark.sql("select 'x1' src, 'n0' dst"))
    nodes = edges.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return analytics.strong_components(nodes, edges)


@R.query("g11_strong_components_all")
def g11_all(spark, sf_dir):
    """Cycles of the whole graph where parts point back at the suppliers of their first lines."""
    g = model.graph(spark, sf_dir)
    back = table(spark, sf_dir, "lineitem").filter("l_linenumber = 1").select(F.concat(F.lit("part::"), "l_partkey").alias("src"), F.concat(F.lit("supplier::"), "l_suppkey").alias("dst"))
    return analytics.strong_components(g.nodes, g.adjacency.unionByName(back))


@R.query("g12_weak_components", on_graph("""SELECT node_id, min(node_id) OVER (PARTITION BY r) AS component FROM (SELECT 'region::' || r_regionkey AS node_id, r_regionkey AS r FROM region
  UNION ALL SELECT 'nation::' || n_nationkey, n_regionkey FROM nation UNION ALL SELECT 'customer::' || c_custkey, n_regionkey FROM customer JOIN nation ON n_nationkey = c_nationkey
  UNION ALL SELECT 'supplier::' || s_suppkey, n_regionkey FROM supplier JOIN nation ON n_nationkey = s_nationkey)"""))
def g12(spark, sf_dir):
    """Weakly connected components of all regions, nations, customers and suppliers: each node's smallest reachable id."""
    g = model.graph(spark, sf_dir)
    nodes = g.nodes.filter("type in ('Domain', 'Entity', 'Client', 'Service')").select("node_id")
    return analytics.components(nodes, g.edges.filter("type in ('ChildOf', 'Contains')").select("src", "dst"))


_DEG = """deg AS (SELECT node_id, coalesce(i, 0) + coalesce(o, 0) AS k, coalesce(i, 0) AS i, coalesce(o, 0) AS o FROM nodes
  LEFT JOIN (SELECT dst, count(*) AS i FROM adjacency GROUP BY dst) a ON a.dst = node_id LEFT JOIN (SELECT src, count(*) AS o FROM adjacency GROUP BY src) b ON b.src = node_id)"""
_Q = """q AS (SELECT ((SELECT count(*) FROM edges e JOIN m a ON a.node_id = e.src JOIN m b ON b.node_id = e.dst WHERE a.community = b.community)
  - (SELECT sum(k::DOUBLE * k) FROM (SELECT community, sum(k) AS k FROM deg JOIN m USING (node_id) GROUP BY community)) / (2.0 * w)) / (2.0 * w) AS q FROM (SELECT count(*) AS w FROM adjacency))"""
_COND = """cond AS (SELECT community, CASE WHEN least(v, t - v) <= 0 THEN 1.0::DOUBLE ELSE least(1.0, cut / least(v, t - v)::DOUBLE) END AS conductance FROM
  (SELECT m.community, sum(k) AS v FROM deg JOIN m USING (node_id) GROUP BY m.community) LEFT JOIN
  (SELECT community, sum(c) AS cut FROM (SELECT a.community, count(*) AS c FROM adjacency e JOIN m a ON a.node_id = e.src JOIN m b ON b.node_id = e.dst WHERE a.community <> b.community GROUP BY 1
    UNION ALL SELECT b.community, count(*) FROM adjacency e JOIN m a ON a.node_id = e.src JOIN m b ON b.node_id = e.dst WHERE a.community <> b.community GROUP BY 1) GROUP BY community) USING (community),
  (SELECT 2 * count(*) AS t FROM adjacency))"""
_DENS = """dens AS (SELECT community, CASE WHEN n <= 1 THEN 1.0::DOUBLE ELSE coalesce(c, 0) / (n * (n - 1))::DOUBLE END AS density FROM (SELECT community, count(*) AS n FROM m GROUP BY community)
  LEFT JOIN (SELECT a.community, count(*) AS c FROM adjacency e JOIN m a ON a.node_id = e.src JOIN m b ON b.node_id = e.dst WHERE a.community = b.community GROUP BY 1) USING (community))"""


@R.query("g16_modularity", on_graph("SELECT round(q, 9) AS modularity FROM q", _MEMBERS, _DEG, _Q))
def g16(spark, sf_dir):
    """Modularity in closed form, without pairs of nodes."""
    g = model.graph(spark, sf_dir)
    return analytics.modularity(g, _members(g)).select(F.round("modularity", 9).alias("modularity"))


@R.query("g17_conductance", on_graph("SELECT community, round(coalesce(conductance, 0), 9) AS conductance FROM cond", _MEMBERS, _DEG, _COND))
def g17(spark, sf_dir):
    """Conductance of each community."""
    g = model.graph(spark, sf_dir)
    return analytics.conductance(g, _members(g)).select("community", F.round("conductance", 9).alias("conductance"))


@R.query("g18_internal_density", on_graph("SELECT community, round(density, 12) AS density FROM dens", _MEMBERS, _DENS))
def g18(spark, sf_dir):
    """Internal density of each community."""
    g = model.graph(spark, sf_dir)
    return analytics.internal_density(g, _members(g)).select("community", F.round("density", 12).alias("density"))


@R.query("g19_coupling_strength", on_graph("""SELECT a, b, round(k / (2.0 * x.n * y.n), 12) AS strength FROM (SELECT least(p.community, q.community) AS a, greatest(p.community, q.community) AS b, count(*) AS k
  FROM adjacency e JOIN m p ON p.node_id = e.src JOIN m q ON q.node_id = e.dst WHERE p.community <> q.community GROUP BY 1, 2)
  JOIN (SELECT community, count(*) AS n FROM m GROUP BY 1) x ON x.community = a JOIN (SELECT community, count(*) AS n FROM m GROUP BY 1) y ON y.community = b""", _MEMBERS))
def g19(spark, sf_dir):
    """Coupling of each pair of communities."""
    g = model.graph(spark, sf_dir)
    return analytics.coupling(g, _members(g)).select("a", "b", F.round("strength", 12).alias("strength"))


@R.query("g20_clustering_evaluation", on_graph("""SELECT round(q, 9) AS modularity, round(c, 9) AS conductance, round(d, 9) AS density, round(0.5 * q + 0.3 * d + 0.2 * (1 - c), 9) AS composite
  FROM q, (SELECT avg(coalesce(conductance, 0)) AS c FROM cond), (SELECT avg(density) AS d FROM dens)""", _MEMBERS, _DEG, _Q, _COND, _DENS))
def g20(spark, sf_dir):
    """Modularity, conductance and density in one score."""
    g = model.graph(spark, sf_dir)
    rows = analytics.evaluate(g, _members(g))
    return rows.select(*[F.round(c, 9).alias(c) for c in ("modularity", "conductance", "density", "composite")])


@R.query("g24_induced_subgraph", on_graph("SELECT src, dst, 'Dependency' AS type FROM edges WHERE split_part(src, '::', 1) IN ('nation', 'region') AND split_part(dst, '::', 1) IN ('nation', 'region')"))
def g24(spark, sf_dir):
    """Edges within a set of nodes, as dependencies."""
    g = model.graph(spark, sf_dir)
    ids = g.nodes.filter("type in ('Domain', 'Entity')").select("node_id")
    return analytics.induced(g, ids).edges.select("src", "dst", "type")


@R.query("g35_component_diagram", on_graph("SELECT src, dst, type FROM edges WHERE src = 'nation::3' OR dst = 'nation::3'"))
def g35(spark, sf_dir):
    """The edges of a node's ego network."""
    return traverse.ego(model.graph(spark, sf_dir), "nation::3")[1].select("src", "dst", "type")


@R.query("g36_sequence_diagram", on_graph("""SELECT depth, src, dst, type FROM (SELECT node_id, min(depth) AS depth FROM w_out GROUP BY node_id ORDER BY 2, 1 LIMIT 20) f JOIN edges ON src = f.node_id""",
  "w_out AS (SELECT 'supplier::5' AS node_id, 0 AS depth UNION SELECT e.dst, depth + 1 FROM w_out w JOIN edges e ON e.src = w.node_id WHERE depth < 4)"))
def g36(spark, sf_dir):
    """Arcs from the first twenty nodes in breadth-first order."""
    return traverse.sequence(model.graph(spark, sf_dir), "supplier::5")


@R.query("g37_data_flow_diagram", on_graph("SELECT src AS node_id, 'in' AS flow FROM edges WHERE dst = 'part::6' UNION ALL SELECT dst, 'out' FROM edges WHERE src = 'part::6'"))
def g37(spark, sf_dir):
    """One step in and out of a node."""
    return traverse.data_flow(model.graph(spark, sf_dir), "part::6")


@R.query("a37_module_leaves", """SELECT 'part::' || p_partkey AS node_id FROM part WHERE p_partkey NOT IN (SELECT p_partkey // 2 FROM part WHERE p_partkey > 0)""")
def a37(spark, sf_dir):
    """Leaves of the module tree."""
    return traverse.leaves(_part_tree(spark, sf_dir)).select("node_id")


@R.query("a38_module_depth", """WITH RECURSIVE t AS (SELECT p_partkey AS k, CASE WHEN p_partkey > 0 THEN p_partkey // 2 END AS p FROM part),
  w AS (SELECT 1::BIGINT AS k, 0 AS depth UNION SELECT t.k, depth + 1 FROM w JOIN t ON t.p = w.k WHERE depth < 12 AND t.k <> w.k) SELECT count(DISTINCT k) AS modules, max(depth) AS depth FROM w""")
def a38(spark, sf_dir):
    """Modules below a root, and their greatest depth."""
    return traverse.tree_down(_part_tree(spark, sf_dir), "part::1", 12).agg(F.count("*").alias("modules"), F.max("depth").alias("depth"))


def _part_tree(spark, sf_dir):
    k = F.col("p_partkey")
    parent = F.when(k > 0, F.concat(F.lit("part::"), F.floor(k / 2).cast("string")))
    return table(spark, sf_dir, "part").select(F.concat(F.lit("part::"), k).alias("node_id"), parent.alias("parent_id"))


_LAYER = architecture.layer_sql("node_id", "type")


@R.query("x23_layer_classification", on_graph(f"SELECT node_id, {_LAYER} AS layer FROM nodes"))
def x23(spark, sf_dir):
    """The first layer with a keyword in id or type."""
    return model.nodes(spark, sf_dir).select("node_id", architecture.layer().alias("layer"))


@R.query("a10_module_quality", on_graph("""SELECT community, round(CASE WHEN n > 1 THEN inner_ / (n * (n - 1.0)) ELSE 1 END, 9) AS cohesion, round((e + a) / (inner_ + e + a), 9) AS coupling,
  round(e / (e + a)::DOUBLE, 9) AS instability, round(abstract_ / n::DOUBLE, 9) AS abstractness, round(abs(abstract_ / n::DOUBLE + e / (e + a)::DOUBLE - 1), 9) AS distance,
  round(greatest(0, 100 - 20 * (e + a) / (inner_ + e + a) - c / 10.0), 6) AS maintainability FROM
  (SELECT community, count(*) AS n, sum(complexity) AS c, count(*) FILTER (contains(lower(type), 'interface') OR contains(lower(type), 'abstract')) AS abstract_ FROM m JOIN nodes USING (node_id) GROUP BY 1)
  JOIN (SELECT community, sum(i)::DOUBLE AS inner_, sum(e)::DOUBLE AS e, sum(a)::DOUBLE AS a FROM (
    SELECT p.community, count(*) FILTER (p.community = q.community) AS i, count(*) FILTER (p.community <> q.community) AS e, 0 AS a FROM adjacency x JOIN m p ON p.node_id = x.src JOIN m q ON q.node_id = x.dst GROUP BY 1
    UNION ALL SELECT q.community, 0, 0, count(*) FILTER (p.community <> q.community) FROM adjacency x JOIN m p ON p.node_id = x.src JOIN m q ON q.node_id = x.dst GROUP BY 1) GROUP BY 1) USING (community)""", _MEMBERS))
def a10(spark, sf_dir):
    """Cohesion, coupling and their kin for each module."""
    g = model.graph(spark, sf_dir)
    rows = architecture.module_quality(g, _members(g))
    names = ("cohesion", "coupling", "instability", "abstractness", "distance")
    return rows.select("community", *[F.round(c, 9).alias(c) for c in names], F.round("maintainability", 6).alias("maintainability"))


@R.query("a11_semantic_diversity", on_graph("""SELECT community, round(0.4 * least(1, d / greatest(1, n // 2)::DOUBLE) + 0.3 * least(1, t / greatest(1, n // 3)::DOUBLE) + 0.3 * (1 - coalesce(i, 0) / (n * (n - 1))::DOUBLE), 9) AS diversity FROM
  (SELECT community, count(*) AS n, count(DISTINCT regexp_replace(file_path, '/[^/]*$', '')) AS d, count(DISTINCT type) AS t FROM m JOIN nodes USING (node_id) GROUP BY 1)
  LEFT JOIN (SELECT a.community, count(*) AS i FROM adjacency e JOIN m a ON a.node_id = e.src JOIN m b ON b.node_id = e.dst WHERE a.community = b.community GROUP BY 1) USING (community)""", _MEMBERS))
def a11(spark, sf_dir):
    """How mixed a module's directories, types and arcs are."""
    g = model.graph(spark, sf_dir)
    return architecture.semantic_diversity(g, _members(g)).select("community", F.round("diversity", 9).alias("diversity"))


@R.query("g34_pattern_recognition", on_graph(architecture.pattern_sql(), "m AS (SELECT node_id, CASE WHEN type = 'Service' THEN 'g1' WHEN type IN ('Client', 'Entity') THEN 'g2' WHEN type IN ('Domain') THEN 'g3' ELSE 'p' || (complexity % 3) END AS community FROM nodes)"))
def g34(spark, sf_dir):
    """The architectural pattern of each module, most specific first."""
    g = model.graph(spark, sf_dir)
    c = F.when(F.col("type") == "Service", "g1").when(F.col("type").isin("Client", "Entity"), "g2").when(F.col("type") == "Domain", "g3")
    c = c.otherwise(F.concat(F.lit("p"), F.col("complexity") % 3))
    rows = architecture.patterns(g, g.nodes.select("node_id", c.alias("community")))
    return rows.select("community", "pattern", F.round("confidence", 6).alias("confidence"))


@R.query("g40_top_components", on_graph("SELECT node_id, score FROM (SELECT node_id, round(rank, 7) AS score FROM ranks) ORDER BY score DESC, node_id LIMIT 5", _RANKS))
def g40(spark, sf_dir):
    """The five nodes of highest rank."""
    r = analytics.page_rank(model.graph(spark, sf_dir), tolerance=1e-9).select("node_id", F.round("rank", 7).alias("score"))
    return r.orderBy(F.desc("score"), "node_id").limit(5)


@R.query("g41_entry_points_to_draw", on_graph("SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM adjacency) OR contains(type, 'Controller') OR contains(type, 'API') ORDER BY node_id LIMIT 3"))
def g41(spark, sf_dir):
    """The first three nodes that nothing points to, or that are controllers or APIs."""
    g = model.graph(spark, sf_dir)
    lone = g.nodes.join(g.adjacency.select(F.col("dst").alias("node_id")), "node_id", "left_anti")
    kind = g.nodes.filter(F.col("type").contains("Controller") | F.col("type").contains("API"))
    return lone.select("node_id").unionByName(kind.select("node_id")).distinct().orderBy("node_id").limit(3)

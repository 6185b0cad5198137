"""Queries over communities and decomposition: no SQL says them, tests hold their invariants."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import analytics, clustering, splits, traverse
from ..registry import Registry
from ..sources import model
from .bindings import on_graph
from .quality import PACKED

R = Registry()


@R.query("g21_communities")
def g21(spark, sf_dir):
    """Communities by modularity moves, split into connected parts."""
    return clustering.communities(model.graph(spark, sf_dir))


@R.query("g23_components_in_module", on_graph("""SELECT node_id, min(node_id) OVER (PARTITION BY r) AS component FROM (SELECT 'region::' || r_regionkey AS node_id, r_regionkey AS r FROM region UNION ALL SELECT 'nation::' || n_nationkey, n_regionkey FROM nation)"""))
def g23(spark, sf_dir):
    """Connected components, larger than one, within the module of regions and nations."""
    g = model.graph(spark, sf_dir)
    part = analytics.induced(g, g.nodes.filter("type in ('Domain', 'Entity')").select("node_id"))
    rows = analytics.components(part.nodes, part.edges)
    size = rows.groupBy("component").agg(F.count("*").alias("n")).filter("n > 1")
    return rows.join(size.select("component"), "component", "left_semi").select("node_id", "component")


@R.query("g25_decomposition")
def g25(spark, sf_dir):
    """Configuration, cycles and communities, in that order."""
    return clustering.pipeline(model.graph(spark, sf_dir))


@R.query("g22_multilevel_communities")
def g22(spark, sf_dir):
    """Communities of communities, as long as they raise the modularity."""
    return clustering.multilevel(model.graph(spark, sf_dir))[0]


@R.query("g25_semantic_clusters")
def g25_named(spark, sf_dir):
    """Configuration, cycles and communities, named, those of one name merged."""
    return clustering.semantic_clusters(model.graph(spark, sf_dir))


def _split_rounds(rounds: int = 5) -> list[str]:
    tokens = "line_count * 1.3::DOUBLE + complexity * 10"
    out = [f"t0 AS (SELECT node_id, split_part(node_id, '::', 1) AS community, string_split(file_path, '/') AS p, {tokens} AS est_tokens FROM nodes)"]
    for k in range(1, rounds + 1):
        part = f"coalesce(p[{k + 1}], '')"
        out.append(f"t{k} AS (SELECT node_id, CASE WHEN sum(est_tokens) OVER (PARTITION BY community) > 32768 THEN community || '/' || {part} ELSE community END AS community, p, est_tokens FROM t{k - 1})")
    return [*out, f"t AS (SELECT community, node_id, est_tokens FROM t{rounds})"]


@R.query("g28_token_limit", on_graph("SELECT node_id, community || '#' || part AS community FROM f JOIN r USING (community, i)", *_split_rounds(), PACKED))
def g28(spark, sf_dir):
    """Modules split until each fits the token limit."""
    g = model.graph(spark, sf_dir)
    return clustering.split_large(g, g.nodes.select("node_id", F.split_part("node_id", F.lit("::"), F.lit(1)).alias("community")))


def _modules(g):
    """Modules by top directory, by directory of suppliers, and of nations with their customers."""
    top = g.nodes.select(F.concat(F.lit("top:"), F.split_part("file_path", F.lit("/"), F.lit(1))).alias("module"), "node_id")
    own = g.nodes.filter("type = 'Service'").select(F.concat(F.lit("dir:"), F.split_part("file_path", F.lit("/"), F.lit(2))).alias("module"), "node_id")
    star = g.edges.filter("src like 'customer::%' and dst like 'nation::%'")
    star = star.select(F.concat(F.lit("star:"), "dst").alias("module"), F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    return top.unionByName(own).unionByName(star)


def _same(a: str, b: str) -> str:
    """Segments at the start of both lists."""
    return f"coalesce(list_position(list_transform(range(1, greatest(len({a}), len({b})) + 1), lambda i: coalesce({a}[i] = {b}[i], false)), false) - 1, greatest(len({a}), len({b})))"


@R.query("g33_delegation_stages", on_graph("""SELECT module, node_id, 'directory' AS stage, part FROM p2 WHERE parts > 1
  UNION ALL SELECT module, node_id, 'dependencies', 'Cluster_' || part FROM c3 WHERE parts > 1
  UNION ALL SELECT module, node_id, 'size', 'Part_' || ((row_number() OVER (PARTITION BY module ORDER BY node_id) - 1) // greatest(2, count(*) OVER (PARTITION BY module) // 3)) FROM c3 WHERE parts = 1""",
  "mm AS (SELECT 'top:' || split_part(file_path, '/', 1) AS module, node_id FROM nodes UNION ALL SELECT 'dir:' || split_part(file_path, '/', 2), node_id FROM nodes WHERE type = 'Service' UNION SELECT 'star:' || dst, unnest([src, dst]) FROM edges WHERE src LIKE 'customer::%' AND dst LIKE 'nation::%')",
  "p0 AS (SELECT module, node_id, list_filter(string_split(file_path, '/'), lambda x: x <> '') AS s FROM mm JOIN nodes USING (node_id))",
  "p1 AS (SELECT *, s[1:len(s) - 1] AS d, min(s[1:len(s) - 2]) OVER (PARTITION BY module) AS lo, max(s[1:len(s) - 2]) OVER (PARTITION BY module) AS hi FROM p0)",
  f"p2 AS (SELECT *, (SELECT count(DISTINCT part) FROM (SELECT module AS m, CASE WHEN {_same('lo', 'hi')} = 0 THEN 'Root' ELSE coalesce(d[{_same('lo', 'hi')} + 1], 'Root') END AS part FROM p1 x) y WHERE y.m = z.module) AS parts FROM (SELECT module, node_id, CASE WHEN {_same('lo', 'hi')} = 0 THEN 'Root' ELSE coalesce(d[{_same('lo', 'hi')} + 1], 'Root') END AS part FROM p1) z)",
  "c0 AS (SELECT module, node_id FROM p2 WHERE parts = 1)",
  "c1 AS (SELECT DISTINCT a.module, a.node_id AS a, b.node_id AS b FROM c0 a JOIN edges e ON e.src = a.node_id JOIN c0 b ON b.module = a.module AND b.node_id = e.dst)",
  "c2 AS (SELECT module, node_id, node_id AS r FROM c0 UNION SELECT c2.module, c2.node_id, CASE WHEN c1.a = c2.r THEN c1.b ELSE c1.a END FROM c2 JOIN c1 ON c1.module = c2.module AND (c1.a = c2.r OR c1.b = c2.r))",
  "c3 AS (SELECT module, node_id, dense_rank() OVER (PARTITION BY module ORDER BY low) - 1 AS part, (SELECT count(DISTINCT low) FROM (SELECT module AS m, node_id, min(r) AS low FROM c2 GROUP BY ALL) y WHERE y.m = z.module) AS parts FROM (SELECT module, node_id, min(r) AS low FROM c2 GROUP BY ALL) z)"))
def g33_stages(spark, sf_dir):
    """How modules are subdivided: by directory, else by dependencies, else in thirds."""
    g = model.graph(spark, sf_dir)
    return splits.delegated(g, _modules(g))


@R.query("g28_token_limit_queue")
def g28_queue(spark, sf_dir):
    """Modules split by directory or by community until each fits or is indivisible."""
    g = model.graph(spark, sf_dir)
    return splits.within_limit(g, g.nodes.select(F.split_part("file_path", F.lit("/"), F.lit(1)).alias("module"), "node_id"), 3000.0)


@R.query("g38_architecture_diagram", on_graph("SELECT node_id, depth FROM (SELECT node_id, min(depth) AS depth FROM w GROUP BY node_id)", "w AS (SELECT 'region::1' AS node_id, 0 AS depth UNION SELECT e.src, depth + 1 FROM w JOIN edges e ON e.dst = w.node_id WHERE depth < 2 AND e.type IN ('ChildOf', 'Contains'))"))
def g38(spark, sf_dir):
    """Nested modules below a region."""
    g = model.graph(spark, sf_dir)
    tree = g.edges.filter("type in ('ChildOf', 'Contains')").select(F.col("src").alias("node_id"), F.col("dst").alias("parent_id"))
    tree = tree.unionByName(g.nodes.filter("type = 'Domain'").select("node_id", F.lit(None).cast("string").alias("parent_id")))
    return traverse.tree_down(tree, "region::1", 2)

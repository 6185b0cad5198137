"""Bounded traversals: a join for each level, up to the depth asked for."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.model import Graph
from ..sources.tables import cut
from .lookup import of_types


def reach(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node_id, depth): nodes within ``depth`` steps along edges (src, dst), at their least depth.

    Each level joins the newly found nodes alone, so hubs are expanded once.  Levels are
    written tables: a later level reads them instead of planning all earlier ones again, and
    the walk ends with the first empty level.  Roots have depth 0."""
    edges = edges.select("src", "dst")
    edge = cut(roots.select("node_id").distinct(), "level")
    found = edge.withColumn("depth", F.lit(0))
    for k in range(1, depth + 1):
        step = edges.join(edge, F.col("src") == F.col("node_id"), "left_semi").select(F.col("dst").alias("node_id")).distinct()
        edge = cut(step.join(found.select("node_id"), "node_id", "left_anti"), "level")
        if edge.isEmpty():
            break
        found = found.unionByName(edge.withColumn("depth", F.lit(k)))
    return found


def hierarchy(graph: Graph, root: str, types: tuple[str, ...], direction: str, depth: int) -> DataFrame:
    """(node_id, depth, direction) around a root along edges of the given types.

    direction: out (callees, dependencies, ancestors), in (callers, dependents, descendants)
    or both, which walks each way on its own."""
    edges = cut(graph.edges.filter(of_types(F.col("type"), *types)).select("src", "dst"), "arcs")  # levels read it, not the arcs behind it
    start = graph.nodes.filter(F.col("node_id") == root).select("node_id")
    parts = []
    for way in ("out", "in") if direction == "both" else (direction,):
        walked = edges if way == "out" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        parts.append(reach(walked, start, depth).filter("depth > 0").withColumn("direction", F.lit(way)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def ego(graph: Graph, node_id: str) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of a component diagram: the node and its neighbours."""
    ids = graph.edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id))
    ids = ids.select(F.explode(F.array("src", "dst")).alias("node_id")).distinct()
    nodes = graph.nodes.join(ids, "node_id", "left_semi")
    edges = graph.edges.filter((F.col("src") == node_id) | (F.col("dst") == node_id))
    return nodes, edges


def data_flow(graph: Graph, node_id: str) -> DataFrame:
    """(node_id, flow): one step in and out of a node."""
    into = graph.edges.filter(F.col("dst") == node_id).select(F.col("src").alias("node_id"), F.lit("in").alias("flow"))
    out = graph.edges.filter(F.col("src") == node_id).select(F.col("dst").alias("node_id"), F.lit("out").alias("flow"))
    return into.unionByName(out)


def sequence(graph: Graph, root: str, expanded: int = 20, depth: int = 4) -> DataFrame:
    """Arcs of a sequence diagram: breadth first, ties by id, ``expanded`` nodes at most."""
    edges = cut(graph.edges, "arcs")
    found = reach(edges, graph.nodes.filter(F.col("node_id") == root), depth)
    first = found.orderBy("depth", "node_id").limit(expanded)
    rows = edges.join(first.select(F.col("node_id").alias("src"), "depth"), "src")
    return rows.select("depth", "src", "dst", "type")


def tree_down(tree: DataFrame, root: str, depth: int) -> DataFrame:
    """(node_id, depth) below a root of rows (node_id, parent_id)."""
    edges = tree.filter("parent_id is not null").select(F.col("parent_id").alias("src"), F.col("node_id").alias("dst"))
    return reach(edges, tree.filter(F.col("node_id") == root).select("node_id"), depth)


def leaves(tree: DataFrame) -> DataFrame:
    return tree.join(tree.select(F.col("parent_id").alias("node_id")).filter("node_id is not null"), "node_id", "left_anti")

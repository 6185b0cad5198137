"""Trees: scores climbed from the leaves of any depth, and traversals with their paths."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.model import Graph
from ..sources.tables import cut
from .lookup import by_name, of_types


def rolled_up(tree: DataFrame, scores: DataFrame, one_judge: bool = False) -> DataFrame:
    """(node_id, parent_id, weight, score, uncertainty, height) of every node of a rubric.

    tree (node_id, parent_id, weight), scores (node_id, score, uncertainty, failed) of leaves.  A
    parent has sum(w s) / sum(w) and sqrt(sum(w^2 u^2)) / sum(w) of its children; without weight
    or children 0.  A failed leaf is left out of its parent's sums, or counts as 0 with one judge;
    it has no score itself then.  A round takes the nodes whose children all have a score, joins
    them with their parents alone, and ends when there are none; rounds are the height of the
    tree, and each is a written table.  Nodes on or above a cycle get no row.  node_ids are
    unique; a missing parent makes a root."""
    kids = tree.filter("parent_id is not null").groupBy(F.col("parent_id").alias("node_id")).agg(F.count("*").alias("need"))
    nodes = cut(tree.select("node_id", "parent_id", F.col("weight").cast("double").alias("weight")).join(kids, "node_id", "left"), "tree")
    failed = F.coalesce("failed", F.lit(False))
    leaves = nodes.filter("need is null").drop("need").join(scores.select("node_id", "score", "uncertainty", "failed"), "node_id", "left")
    score = F.when(failed, F.lit(0.0 if one_judge else None)).otherwise(F.coalesce(F.col("score").cast("double"), F.lit(0.0)))
    frontier = cut(leaves.select("node_id", "parent_id", "weight", score.alias("score"), F.coalesce(F.col("uncertainty").cast("double"), F.lit(0.0)).alias("uncertainty"), F.lit(0).alias("height")), "scored")
    done, partial, waiting = [frontier], None, nodes.filter("need is not null")
    w, u = F.col("weight"), F.col("uncertainty")
    while not frontier.isEmpty():
        counts = F.col("score").isNotNull()
        part = frontier.filter("parent_id is not null").select(
            F.col("parent_id").alias("node_id"), F.lit(1).alias("n"), F.when(counts, w).otherwise(0.0).alias("w"), F.when(counts, w * F.col("score")).otherwise(0.0).alias("ws"), F.when(counts, w * w * u * u).otherwise(0.0).alias("wu"), (F.col("height") + 1).alias("height")
        )
        part = part if partial is None else part.unionByName(partial)
        sums = part.groupBy("node_id").agg(*[F.sum(c).alias(c) for c in ("n", "w", "ws", "wu")], F.max("height").alias("height"))
        met = cut(sums.join(waiting, "node_id"), "met")  # parents that have met a child, no others
        ready, weighted = met.filter("n = need"), F.col("w") > 0
        partial = met.filter("n < need").select("node_id", "n", "w", "ws", "wu", "height")
        frontier = cut(ready.select("node_id", "parent_id", "weight", F.when(weighted, F.col("ws") / F.col("w")).otherwise(0.0).alias("score"), F.when(weighted, F.sqrt("wu") / F.col("w")).otherwise(0.0).alias("uncertainty"), "height"), "scored")
        done.append(frontier)
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def walk(edges: DataFrame, roots: DataFrame, depth: int) -> DataFrame:
    """(node_id, parent_id, depth, path, again): arcs (src, dst) out of what roots reach, in levels.

    A node is expanded once, where it is first met: at its least depth, from the least parent
    there; path leads to it from the root, itself included.  Arcs to a node met elsewhere have
    again = true and are not followed, so cycles end; an arc twice counts once."""
    edges = cut(edges.select("src", "dst").distinct(), "arcs")
    start = roots.select("node_id").distinct()
    level = cut(start.select("node_id", F.lit(None).cast("string").alias("parent_id"), F.lit(0).alias("depth"), F.array("node_id").alias("path"), F.lit(False).alias("again")), "level")
    out, seen = level, level.select("node_id")
    for k in range(1, depth + 1):
        last = level.filter("not again").select(F.col("node_id").alias("src"), "path")
        met = edges.join(last, "src").join(seen.select(F.col("node_id").alias("dst"), F.lit(True).alias("known")), "dst", "left")
        first = met.filter("known is null").groupBy("dst").agg(F.min("src").alias("first"))
        rows = met.join(first, "dst", "left")
        again = F.coalesce(F.col("src") != F.col("first"), F.lit(True))
        level = cut(rows.select(F.col("dst").alias("node_id"), F.col("src").alias("parent_id"), F.lit(k).alias("depth"), F.concat("path", F.array("dst")).alias("path"), again.alias("again")), "level")
        if level.isEmpty():
            break
        out, seen = out.unionByName(level), seen.unionByName(level.filter("not again").select("node_id"))
    return out


def hierarchy_tree(graph: Graph, name: str, types: tuple[str, ...], direction: str, depth: int) -> DataFrame:
    """``walk`` from the first node, by id, of that name, along edges of the types, with ``direction``.

    direction: out, in, or both, which walks each way on its own.  An unknown name gives no rows."""
    edges = graph.edges.filter(of_types(F.col("type"), *types)).select("src", "dst")
    root = cut(by_name(graph.nodes, name).agg(F.min("node_id").alias("node_id")).filter("node_id is not null"), "root")
    parts = []
    for way in ("out", "in") if direction == "both" else (direction,):
        arcs = edges if way == "out" else edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
        parts.append(walk(arcs, root, depth).filter("depth > 0").withColumn("direction", F.lit(way)))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])

"""Modules split into parts: by directory, by what depends on each other, by community, by count.

Each stage takes all modules that the one before it left whole, in one pass: nodes go by
(module, node), so a node may lie in several modules, and modules do not see each other."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.code import segments
from ..sources.model import Graph
from ..sources.tables import cut
from .analytics import components
from .clustering import communities
from .folds import ranked

#: Tokens of a module at most, and tokens of a line and of a point of complexity.
MOST, LINE, POINT = 32768, 1.3, 10
_BETWEEN = "\x1f"


def _directory(path: Column, up: int = 1) -> Column:
    """The segments of a path without the last ``up``."""
    parts = F.filter(segments(path), lambda s: s != "")
    return F.slice(parts, F.lit(1), F.greatest(F.size(parts) - up, F.lit(0)))


def _shared(low: Column, high: Column) -> Column:
    """Segments at the start of both of two lists."""
    same = F.transform(F.arrays_zip(low.alias("a"), high.alias("b")), lambda z: F.coalesce(z["a"] == z["b"], F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")


def _below(rows: DataFrame, directory: Column, common: Column, otherwise: str, whole: bool) -> DataFrame:
    """rows with ``part``: the segment of ``directory`` below what ``common`` of all of a module's
    nodes share, and ``parts``, how many a module has.  whole: a module that shares nothing is one part."""
    rows = rows.withColumn("_dir", directory).withColumn("_common", common)
    top = rows.groupBy("module").agg(F.min("_common").alias("lo"), F.max("_common").alias("hi"))
    rows = rows.join(top.select("module", _shared(F.col("lo"), F.col("hi")).alias("_n")), "module")
    part = F.coalesce(F.get("_dir", F.col("_n")), F.lit(otherwise))
    rows = rows.withColumn("part", F.when(F.col("_n") == 0, otherwise).otherwise(part) if whole else part)
    return _counted(rows.drop("_dir", "_common", "_n"))


def _counted(rows: DataFrame) -> DataFrame:
    return rows.join(rows.groupBy("module").agg(F.count_distinct("part").alias("parts")), "module")


def _key(module: Column, node: Column) -> Column:
    return F.concat(module, F.lit(_BETWEEN), node)


def _inner(arcs: DataFrame, rows: DataFrame) -> DataFrame:
    """(src, dst) between the (module, node) keys of rows, of arcs within a module."""
    a = rows.select(F.col("module"), F.col("node_id").alias("src"))
    b = rows.select(F.col("module"), F.col("node_id").alias("dst"))
    both = arcs.join(a, "src").join(b, ["module", "dst"])
    return both.select(_key(F.col("module"), F.col("src")).alias("src"), _key(F.col("module"), F.col("dst")).alias("dst"))


def _labelled(rows: DataFrame, labels: DataFrame, label: str) -> DataFrame:
    """rows with ``part``: the place of their label among those of their module, by the least key that has it."""
    own = labels.select(F.split_part("node_id", F.lit(_BETWEEN), F.lit(1)).alias("module"), F.split_part("node_id", F.lit(_BETWEEN), F.lit(2)).alias("node_id"), F.col(label).alias("_label"))
    first = own.groupBy("module", "_label").agg(F.min("node_id").alias("_first"))
    place = ranked(first, "module", "_first", "part")
    return _counted(rows.drop("part", "parts").join(own, ["module", "node_id"]).join(place.select("module", "_label", "part"), ["module", "_label"]).drop("_label"))


def delegated(graph: Graph, members: DataFrame) -> DataFrame:
    """(module, node_id, stage, part) of members (module, node_id): how each module is subdivided.

    By the first directory below the one that the parents of all its directories share; where
    that is one part, by connected components (Cluster_0 ...); where there is one, in runs of
    max(2, n / 3) nodes by id (Part_0 ...).  Files in no directory are Root.  Members that are no
    nodes are left out; repeated ones count once."""
    rows = cut(members.select("module", "node_id").distinct().join(graph.nodes.select("node_id", "file_path"), "node_id"), "members")
    rows = cut(_below(rows, _directory(F.col("file_path")), _directory(F.col("file_path"), 2), "Root", True), "directories")
    found = [rows.filter("parts > 1").select("module", "node_id", F.lit("directory").alias("stage"), "part")]
    rest = rows.filter("parts = 1").select("module", "node_id")
    arcs = _inner(graph.edges.select("src", "dst"), rest)
    labels = components(rest.select(_key(F.col("module"), F.col("node_id")).alias("node_id")), arcs)
    clustered = cut(_labelled(rest, labels, "component"), "clusters")
    found.append(clustered.filter("parts > 1").select("module", "node_id", F.lit("dependencies").alias("stage"), F.concat(F.lit("Cluster_"), "part").alias("part")))
    rest = ranked(clustered.filter("parts = 1").select("module", "node_id"), "module", "node_id")
    size = rest.groupBy("module").agg(F.greatest(F.lit(2), F.floor(F.count("*") / 3)).alias("size"))
    part = F.floor(F.col("nth") / F.col("size"))
    found.append(rest.join(size, "module").select("module", "node_id", F.lit("size").alias("stage"), F.concat(F.lit("Part_"), part).alias("part")))
    return found[0].unionByName(found[1]).unionByName(found[2])


def within_limit(graph: Graph, members: DataFrame, most: float = MOST) -> DataFrame:
    """(module, node_id, tokens, indivisible): members (module, node_id) in modules of ``most`` tokens.

    A module above that is split by the first segment of its files' paths below what they share;
    where that is one part, by communities of its own graph; parts that are still too large are
    split again.  A module that neither splits is indivisible.  A round takes all modules that
    are too large, and rounds end because each of them splits in two at least or is done.
    tokens: of the module.  Parts are named module_part."""
    tokens = (F.col("line_count") * LINE + F.col("complexity") * POINT).cast("double")
    nodes = graph.nodes.select("node_id", "file_path", tokens.alias("own"))
    rows = cut(members.select("module", "node_id").distinct().join(nodes, "node_id"), "members")
    adjacency, found = cut(graph.adjacency.filter("src <> dst"), "arcs"), []
    while True:
        rows = cut(rows.join(rows.groupBy("module").agg(F.sum("own").alias("tokens")), "module"), "sized")
        found.append(rows.filter(F.col("tokens") <= most).select("module", "node_id", "tokens", F.lit(False).alias("indivisible")))
        large = rows.filter(F.col("tokens") > most)
        if large.isEmpty():
            break
        path = F.filter(segments(F.col("file_path")), lambda s: s != "")
        inside = F.when(F.size(path) > 0, F.slice(path, F.lit(1), F.size(path) - 1))  # a file in the shared directory itself is Root
        large = cut(_below(large, inside, _directory(F.col("file_path")), "Root", False), "directories")
        whole = large.filter("parts = 1").drop("part", "parts")
        ids = whole.select(_key(F.col("module"), F.col("node_id")).alias("node_id"))
        arcs = cut(_inner(adjacency, whole.select("module", "node_id")), "inner")
        labels = communities(Graph(ids, arcs.distinct(), arcs))
        split = cut(_labelled(whole, labels, "community"), "communities")
        found.append(split.filter("parts = 1").select("module", "node_id", "tokens", F.lit(True).alias("indivisible")))
        names = ["module", "node_id", "file_path", "own", "part"]
        rows = large.filter("parts > 1").select(names).unionByName(split.filter("parts > 1").select(*names[:-1], F.col("part").cast("string").alias("part")))
        rows = rows.select(F.concat_ws("_", "module", "part").alias("module"), "node_id", "file_path", "own")
    out = found[0]
    for f in found[1:]:
        out = out.unionByName(f)
    return out

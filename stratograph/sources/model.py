"""The graph, page, vector and score tables that the operators work on, bound to base tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import table

#: The edge types a graph may hold.
EDGE_TYPES = (
    "Dependency", "Inheritance", "Implementation", "Composition", "Aggregation", "MethodCall",
    "PropertyAccess", "TypeReference", "CrossBoundary", "Call", "Contains", "ChildOf",
)
#: What queries call some of them.
ALIASES = {"Calls": ("Call", "MethodCall"), "Inherits": ("Inheritance",), "Implements": ("Implementation",), "DependsOn": ("Dependency",)}


@dataclass
class Graph:
    """nodes: one row per node_id.  edges: one per (src, dst).  adjacency: one per arc added.

    Degrees count adjacency, so a repeated arc raises them; edges keep the first type."""

    nodes: DataFrame
    edges: DataFrame
    adjacency: DataFrame


def build(nodes: DataFrame, arcs: DataFrame) -> Graph:
    """The graph of node rows and arcs (seq, src, dst, type, strength).

    The first row of a node_id wins; arcs with a missing end are dropped; the first arc of a
    pair gives the edge's type and strength; unknown types become Dependency."""
    first = F.min_by(F.struct(*nodes.columns), F.struct(*[c for c in ("seq", "node_id") if c in nodes.columns]))
    nodes = nodes.groupBy(F.col("node_id").alias("_id")).agg(first.alias("n")).select("n.*")
    ids = nodes.select("node_id")
    arcs = arcs.join(ids.withColumnRenamed("node_id", "src"), "src", "left_semi").join(ids.withColumnRenamed("node_id", "dst"), "dst", "left_semi")
    kind = F.when(F.col("type").isin(*EDGE_TYPES), F.col("type")).otherwise("Dependency")
    arcs = arcs.select("seq", "src", "dst", kind.alias("type"), "strength")
    edges = arcs.groupBy("src", "dst").agg(F.min_by("type", "seq").alias("type"), F.min_by("strength", "seq").alias("strength"))
    return Graph(nodes, edges, arcs.select("src", "dst"))


def without_files(graph: Graph, paths: DataFrame) -> Graph:
    """The graph without the nodes of the given file paths (whatever their case) and their arcs."""
    gone = paths.select(F.lower("file_path").alias("p")).distinct()
    nodes = graph.nodes.join(gone, F.lower("file_path") == F.col("p"), "left_anti")
    ids = nodes.select("node_id")

    def both_ends(arcs: DataFrame) -> DataFrame:
        return arcs.join(ids, F.col("src") == F.col("node_id"), "left_semi").join(ids, F.col("dst") == F.col("node_id"), "left_semi")

    return Graph(nodes, both_ends(graph.edges), both_ends(graph.adjacency))


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(NODES.format(**_views(spark, sf_dir)))


def arcs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(ARCS.format(**_views(spark, sf_dir)))


def graph(spark: SparkSession, sf_dir: str) -> Graph:
    """The graph of the base tables.  Their keys are unique, and the arcs' ends exist."""
    a = arcs(spark, sf_dir)
    edges = a.groupBy("src", "dst").agg(F.min_by("type", "seq").alias("type"), F.min_by("strength", "seq").alias("strength"))
    return Graph(nodes(spark, sf_dir), edges, a.select("src", "dst"))


def _views(spark: SparkSession, sf_dir: str) -> dict[str, str]:
    return {t: f"parquet.`{sf_dir}/{t}.parquet`" for t in ("region", "nation", "customer", "supplier", "part", "lineitem")}


NODES = """
SELECT concat('region::', cast(r_regionkey as string)) node_id, 'Domain' type, r_name name, 'SQL' language,
  concat('regions/', lower(r_name), '.sql') file_path, 10 line_count, 1 complexity FROM {region}
UNION ALL SELECT concat('nation::', cast(n_nationkey as string)), 'Entity', n_name, 'SQL',
  concat('regions/', cast(n_regionkey as string), '/', n_name, '.sql'), 20, 2 FROM {nation}
UNION ALL SELECT concat('customer::', cast(c_custkey as string)), 'Client', c_name, c_mktsegment,
  concat('customers/', cast(c_nationkey as string), '/', c_name, '.java'), cast(1 + c_custkey % 300 as int), cast(1 + c_custkey % 23 as int) FROM {customer}
UNION ALL SELECT concat('supplier::', cast(s_suppkey as string)), 'Service', s_name, 'C#',
  concat('suppliers/', cast(s_nationkey as string), '/', s_name, '.cs'), cast(50 + s_suppkey % 450 as int), cast(1 + s_suppkey % 19 as int) FROM {supplier}
UNION ALL SELECT concat('part::', cast(p_partkey as string)), p_type, p_name, p_brand,
  concat('parts/', cast(p_size as string), '/', p_name, '.py'), p_size * 10, cast(1 + p_partkey % 7 as int) FROM {part}
"""

ARCS = """
SELECT cast(n_nationkey as bigint) seq, concat('nation::', cast(n_nationkey as string)) src,
  concat('region::', cast(n_regionkey as string)) dst, 'ChildOf' type, cast(1 as double) strength FROM {nation}
UNION ALL SELECT 100000 + c_custkey, concat('customer::', cast(c_custkey as string)),
  concat('nation::', cast(c_nationkey as string)), 'Contains', cast(1 as double) FROM {customer}
UNION ALL SELECT 100000 + s_suppkey, concat('supplier::', cast(s_suppkey as string)),
  concat('nation::', cast(s_nationkey as string)), 'Contains', cast(1 as double) FROM {supplier}
UNION ALL SELECT l_orderkey * 10 + l_linenumber, concat('supplier::', cast(l_suppkey as string)),
  concat('part::', cast(l_partkey as string)),
  CASE l_partkey % 5 WHEN 0 THEN 'Call' WHEN 2 THEN 'Inheritance' WHEN 3 THEN 'Implementation' ELSE 'Dependency' END,
  cast(1 as double) FROM {lineitem}
UNION ALL SELECT cast(p_partkey as bigint), concat('part::', cast(p_partkey as string)),
  concat('part::', cast(cast(floor(p_partkey / 2) as bigint) as string)),
  CASE p_partkey % 4 WHEN 0 THEN 'MethodCall' WHEN 1 THEN 'Inheritance' ELSE 'Dependency' END, cast(1 as double)
  FROM {part} WHERE p_partkey > 0
"""


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documentation pages: (page_id, title, content, directory, language)."""
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"),
        F.concat(F.lit("Page "), F.col("doc_id").cast("string")).alias("title"),
        F.col("text").alias("content"),
        F.col("source").alias("directory"),
        F.col("lang").alias("language"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("doc_id"), "embedding", F.col("label").cast("string").alias("label"))

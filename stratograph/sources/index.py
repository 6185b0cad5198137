"""The JSON form of a graph index: nodes, and edges by their two ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .model import Graph

NODE = "node_id string, type string, name string, language string, file_path string, line_count int, complexity int"
EDGE = "src string, dst string, type string, strength double"


def to_json(graph: Graph) -> DataFrame:
    """Rows (kind, body): one JSON document for each node and edge."""
    def rows(df: DataFrame, kind: str, schema: str) -> DataFrame:
        names = [c.split()[0] for c in schema.split(", ")]
        return df.select(F.lit(kind).alias("kind"), F.to_json(F.struct(*names)).alias("body"))

    return rows(graph.nodes, "node", NODE).unionByName(rows(graph.edges, "edge", EDGE))


def from_json(rows: DataFrame) -> Graph:
    nodes = rows.filter("kind = 'node'").select(F.from_json("body", NODE).alias("r")).select("r.*")
    edges = rows.filter("kind = 'edge'").select(F.from_json("body", EDGE).alias("r")).select("r.*")
    return Graph(nodes, edges, edges.select("src", "dst"))


def import_document(document: DataFrame, column: str = "value") -> Graph:
    """A whole index document: nodes[] and outgoing edges by node id."""
    schema = f"nodes array<struct<{NODE.replace(' ', ':').replace(',:', ',')}>>, outgoing map<string,array<struct<{EDGE.replace(' ', ':').replace(',:', ',')}>>>"
    parsed = document.select(F.from_json(column, schema).alias("d"))
    nodes = parsed.select(F.inline("d.nodes"))
    edges = parsed.select(F.explode(F.flatten(F.map_values("d.outgoing"))).alias("e")).select("e.*")
    return Graph(nodes, edges, edges.select("src", "dst"))

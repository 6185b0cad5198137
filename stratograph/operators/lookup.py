"""Filters and lookups over the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.model import ALIASES, Graph


def is_named(node_id: Column, name: str) -> Column:
    """node_id is the name, or ends with ::name or .name, whatever the case."""
    low, n = F.lower(node_id), name.lower()
    return (low == n) | low.endswith("::" + n) | low.endswith("." + n)


def by_name(nodes: DataFrame, name: str) -> DataFrame:
    return nodes.filter(is_named(F.col("node_id"), name))


def by_type(nodes: DataFrame, kind: str) -> DataFrame:
    return nodes.filter(F.lower("type") == kind.lower())


def of_types(kind: Column, *names: str) -> Column:
    """The edge type is one of the names, aliases resolved."""
    return kind.isin(*[t for n in names for t in ALIASES.get(n, (n,))])


def edges_of(graph: Graph, node_id: str, direction: str) -> DataFrame:
    return graph.edges.filter(F.col("dst" if direction == "in" else "src") == node_id)


def references(graph: Graph, symbol: str, file_path: str | None = None) -> DataFrame:
    """Edges into every node of that name, with the file of the referring node."""
    targets = by_name(graph.nodes, symbol).select(F.col("node_id").alias("dst"))
    source = graph.nodes.select(F.col("node_id").alias("src"), "file_path")
    rows = graph.edges.join(targets, "dst", "left_semi").join(source, "src")  # goes below the edges' aggregate: it groups by dst
    if file_path is not None:
        rows = rows.filter(F.lower("file_path") == file_path.lower())
    return rows.select("src", "dst", "type", "file_path")


def implementations(graph: Graph, kind: str) -> DataFrame:
    """Distinct nodes with an Implements or Inherits edge to a node of that name."""
    targets = by_name(graph.nodes, kind).select(F.col("node_id").alias("dst"))
    rows = graph.edges.filter(of_types(F.col("type"), "Implements", "Inherits")).join(targets, "dst", "left_semi")
    return graph.nodes.join(rows.select(F.col("src").alias("node_id")).distinct(), "node_id", "left_semi")


def search(nodes: DataFrame, query: str, kind: str | None, limit: int) -> DataFrame:
    """By name; or by type and part of the id where a type is given.  In order of id."""
    hits = by_name(nodes, query) if kind is None else by_type(nodes, kind).filter(F.lower("node_id").contains(query.lower()))
    return hits.orderBy("node_id").limit(limit)


def likely_entry_point() -> Column:
    """A node that is public, a Controller, or has Main or Entry in its id."""
    return is_public() | (F.lower("type") == "controller") | F.col("node_id").contains("Main") | F.col("node_id").contains("Entry")


#: Types and ends of names that are public.
PUBLIC_TYPES, PUBLIC_NAMES = ("controller", "service"), "(service|controller|manager)$"


def is_public() -> Column:
    return F.lower("type").isin(*PUBLIC_TYPES) | F.lower("name").rlike(PUBLIC_NAMES)


#: Parts of names of entry points.
ENTRY_NAMES = ("main", "program", "startup", "entry", "init", "controller", "service", "api", "handler")


def likely_component_entry() -> Column:
    """Of a component (name, type, is_public, fan_in): never Configuration; by name, type or use."""
    named = F.lower("name").rlike("|".join(ENTRY_NAMES))
    typed = F.lower("type").isin("controller", "service", "api")
    return (F.col("type") != "Configuration") & (named | typed | (F.col("is_public") & (F.col("fan_in") == 0)))


def zero_in_degree(graph: Graph) -> DataFrame:
    return graph.nodes.join(graph.adjacency.select(F.col("dst").alias("node_id")), "node_id", "left_anti")


def high_out_degree(graph: Graph, threshold: int = 10) -> DataFrame:
    return graph.adjacency.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree")).filter(F.col("out_degree") > threshold)


def entry_points(graph: Graph) -> DataFrame:
    return zero_in_degree(graph).filter(likely_entry_point())


def visible(nodes: DataFrame, spec: dict) -> DataFrame:
    """Diagram filter: include lists take precedence over exclude lists, for ids and layers."""
    if spec.get("include"):
        nodes = nodes.filter(F.col("node_id").isin(*spec["include"]))
    elif spec.get("exclude"):
        nodes = nodes.filter(~F.col("node_id").isin(*spec["exclude"]))
    low, high = spec.get("complexity", (None, None))
    if low is not None:
        nodes = nodes.filter(F.col("complexity") >= low)
    if high is not None:
        nodes = nodes.filter(F.col("complexity") <= high)
    for flag in ("is_public", "has_doc"):
        if spec.get(flag):
            nodes = nodes.filter(F.col(flag))
    if spec.get("layers"):
        nodes = nodes.filter(F.col("layer").isin(*spec["layers"]))
    elif spec.get("not_layers"):
        nodes = nodes.filter(~F.col("layer").isin(*spec["not_layers"]))
    return nodes


def visible_edges(edges: DataFrame, nodes: DataFrame, types: tuple[str, ...] = (), not_types: tuple[str, ...] = ()) -> DataFrame:
    """Edges of the wanted types whose ends are both among the (already filtered) nodes."""
    if types:
        edges = edges.filter(F.col("type").isin(*types))
    elif not_types:
        edges = edges.filter(~F.col("type").isin(*not_types))
    ids = nodes.select("node_id")
    return edges.join(ids, F.col("src") == F.col("node_id"), "left_semi").join(ids, F.col("dst") == F.col("node_id"), "left_semi")


def contained(short: DataFrame, long: DataFrame) -> DataFrame:
    """Distinct (s, l): the strings s of ``short`` (s) that lie in strings l of ``long`` (l).

    A string lies in another only if all its three-character grams do, so each s waits under
    the gram that the fewest l hold, and meets those alone.  Strings of one or two characters
    wait under themselves.  Empty strings lie in nothing.  Grams are many times the strings that
    Spark estimates them by, so their joins are sorted, never broadcast."""
    short, long = short.filter("s <> ''").distinct(), long.filter("l <> ''").distinct()

    def grams(c: Column, n: int) -> Column:
        last = F.length(c) - (n - 1)
        return F.when(last >= 1, F.transform(F.sequence(F.lit(1), F.greatest(F.lit(1), last)), lambda i: F.substring(c, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))

    least = short.agg(F.coalesce(F.min(F.length("s")), F.lit(3))).first()[0]  # shorter grams only where something that short waits
    held = F.concat(*[grams(F.col("l"), n) for n in range(min(least, 3), 4)])
    held = long.select("l", F.explode(F.array_distinct(held)).alias("gram"))
    often = held.groupBy("gram").agg(F.count("*").alias("often"))
    own = F.when(F.length("s") < 3, F.array("s")).otherwise(F.array_distinct(grams(F.col("s"), 3)))
    wait = short.select("s", F.size(own).alias("n"), F.explode(own).alias("gram")).join(often.hint("merge"), "gram")
    wait = wait.groupBy("s").agg(F.min(F.struct("often", "gram")).alias("g"), F.count("*").alias("k"), F.first("n").alias("n")).filter("k = n")
    return wait.select("s", F.col("g.gram").alias("gram")).join(held.hint("merge"), "gram").filter(F.col("l").contains(F.col("s"))).select("s", "l")


def resolve_pages(pages: DataFrame, nodes: DataFrame) -> DataFrame:
    """(page_id, node_id): the node whose id equals the page's title, else one that contains
    it or lies in it, else the same by the stem of a file; smallest id first; else the node
    of largest out_degree.  Equal ids join first; only distinct strings are searched within
    each other.  Ids are longer than the keys that Spark estimates them by: no broadcast of them."""
    p = pages.select("page_id", F.lower("title").alias("title"), F.lower("stem").alias("stem"))
    ids = nodes.groupBy(F.lower("node_id").alias("low")).agg(F.min("node_id").alias("node_id"))
    values = p.select(F.explode(F.array("title", "stem")).alias("v")).filter("v is not null").distinct()
    a, b = values.withColumnRenamed("v", "s"), ids.select(F.col("low").alias("l"))
    inside = contained(a, b).select(F.col("s").alias("v"), F.col("l").alias("low"))
    around = contained(b.withColumnRenamed("l", "s"), a.withColumnRenamed("s", "l")).select(F.col("l").alias("v"), F.col("s").alias("low"))
    near = inside.unionByName(around).join(ids.hint("merge"), "low").groupBy("v").agg(F.min("node_id").alias("near"))
    same = ids.select(F.col("low").alias("v"), F.col("node_id").alias("same"))
    found = values.join(same, "v", "left").join(near, "v", "left").select("v", F.coalesce("same", "near").alias("found"))
    top = nodes.filter("out_degree > 0").orderBy(F.desc("out_degree"), "node_id").limit(1).select(F.col("node_id").alias("top"))
    out = p.join(found.select(F.col("v").alias("title"), F.col("found").alias("by_title")), "title", "left")
    out = out.join(found.select(F.col("v").alias("stem"), F.col("found").alias("by_stem")), "stem", "left")
    out = out.join(F.broadcast(top), F.lit(True), "left")  # one row
    return out.select("page_id", F.coalesce("by_title", "by_stem", "top").alias("node_id"))


def query_gate(state: str, pending: int, seconds_per_file: float = 0.1) -> dict:
    """Whether queries may run, why not, and how long they would wait."""
    if state == "Ready" and pending == 0:
        return {"allowed": True, "reason": None, "wait_seconds": 0.0}
    reason = f"{pending} files pending" if state == "Ready" else f"index is {state}"
    return {"allowed": False, "reason": reason, "wait_seconds": pending * seconds_per_file}


def matching_sections(sections: DataFrame, pages: DataFrame, text: str, depth: int = 16) -> DataFrame:
    """Ids of sections whose title, a page's title or any descendant matches: hits walk up."""
    from .traverse import reach

    low = text.lower()
    hits = sections.filter(F.lower("title").contains(low)).select("section_id")
    hits = hits.unionByName(pages.filter(F.lower("title").contains(low)).select("section_id"))
    up = sections.filter("parent_id is not null").select(F.col("section_id").alias("src"), F.col("parent_id").alias("dst"))
    found = reach(up, hits.select(F.col("section_id").alias("node_id")), depth).select(F.col("node_id").alias("section_id"))
    return sections.select("section_id").join(found, "section_id", "left_semi")


def first_match(candidates: DataFrame, key: str, *order: str) -> DataFrame:
    """The first row of each key in the given order."""
    return candidates.withColumn("_nth", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("_nth = 1").drop("_nth")

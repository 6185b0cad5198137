"""Queries over filters, lookups and joins of the graph."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import lookup as op
from ..registry import Registry
from ..sources import model
from ..sources.tables import table
from .bindings import on_graph

R = Registry()

_NAMED = "(lower({0}) = '{1}' OR ends_with(lower({0}), '::{1}') OR ends_with(lower({0}), '.{1}'))"


@R.query("f01_find_by_name", on_graph(f"SELECT node_id, type FROM nodes WHERE {_NAMED.format('node_id', '7')}"))
def f01(spark, sf_dir):
    """Nodes of a name: the id itself, or the part after :: or a dot."""
    return op.by_name(model.nodes(spark, sf_dir), "7").select("node_id", "type")


@R.query("f02_find_by_type", on_graph("SELECT node_id, name FROM nodes WHERE lower(type) = 'service'"))
def f02(spark, sf_dir):
    """Nodes of a type, whatever its case."""
    return op.by_type(model.nodes(spark, sf_dir), "SERVICE").select("node_id", "name")


@R.query("f03_in_edges", on_graph("SELECT src, dst, type FROM edges WHERE dst = 'part::10'"))
def f03(spark, sf_dir):
    """Edges into a node, with their true types."""
    return op.edges_of(model.graph(spark, sf_dir), "part::10", "in").select("src", "dst", "type")


@R.query("f03_out_edges", on_graph("SELECT src, dst, type FROM edges WHERE src = 'supplier::3'"))
def f03_out(spark, sf_dir):
    """Edges out of a node."""
    return op.edges_of(model.graph(spark, sf_dir), "supplier::3", "out").select("src", "dst", "type")


@R.query(
    "f04_find_references",
    on_graph(f"SELECT e.src, e.dst, e.type, n.file_path FROM edges e JOIN nodes n ON n.node_id = e.src WHERE {_NAMED.format('e.dst', '12')}"),
)
def f04(spark, sf_dir):
    """Edges into all nodes of a name, with the referring node's file."""
    return op.references(model.graph(spark, sf_dir), "12")


@R.query(
    "f04_find_references_in_file",
    on_graph("SELECT e.src, e.dst, e.type, n.file_path FROM edges e JOIN nodes n ON n.node_id = e.src WHERE e.dst = 'nation::15' AND lower(n.file_path) = 'suppliers/15/supplier#000000000.cs'"),
)
def f04_file(spark, sf_dir):
    """The same within one file."""
    return op.references(model.graph(spark, sf_dir), "nation::15", "suppliers/15/Supplier#000000000.cs")


@R.query(
    "f05_find_implementations",
    on_graph(f"SELECT DISTINCT n.node_id, n.type FROM edges e JOIN nodes n ON n.node_id = e.src WHERE e.type IN ('Implementation', 'Inheritance') AND {_NAMED.format('e.dst', '8')}"),
)
def f05(spark, sf_dir):
    """Distinct nodes that implement or inherit from nodes of a name."""
    return op.implementations(model.graph(spark, sf_dir), "8").select("node_id", "type")


@R.query("f06_semantic_search", on_graph("SELECT node_id FROM nodes WHERE lower(type) = 'client' AND contains(lower(node_id), '12') ORDER BY node_id LIMIT 25"))
def f06(spark, sf_dir):
    """By type and part of the id, the first 25 in order of id."""
    return op.search(model.nodes(spark, sf_dir), "12", "Client", 25).select("node_id")


@R.query("f07_zero_in_degree", on_graph("SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM adjacency)"))
def f07(spark, sf_dir):
    """Nodes that no arc enters."""
    return op.zero_in_degree(model.graph(spark, sf_dir)).select("node_id")


@R.query("f08_high_out_degree", on_graph("SELECT src AS node_id, count(*) AS out_degree FROM adjacency GROUP BY src HAVING count(*) > 10"))
def f08(spark, sf_dir):
    """Nodes with more than ten arcs out, repeated arcs counted."""
    return op.high_out_degree(model.graph(spark, sf_dir))


_ENTRY = "(lower(type) IN ('controller', 'service') OR regexp_matches(lower(name), '(service|controller|manager)$') OR contains(node_id, 'Main') OR contains(node_id, 'Entry'))"


@R.query("f09_entry_points", on_graph(f"SELECT node_id FROM nodes WHERE node_id NOT IN (SELECT dst FROM adjacency) AND {_ENTRY}"))
def f09(spark, sf_dir):
    """Nodes without arcs in that look like entry points."""
    return op.entry_points(model.graph(spark, sf_dir)).select("node_id")


@R.query("x11_is_public", on_graph("SELECT node_id, lower(type) IN ('controller', 'service') OR regexp_matches(lower(name), '(service|controller|manager)$') AS is_public FROM nodes"))
def x11(spark, sf_dir):
    """Public by type or by the end of the name."""
    return model.nodes(spark, sf_dir).select("node_id", op.is_public().alias("is_public"))


@R.query("x21_likely_entry_point", on_graph(f"SELECT node_id, {_ENTRY} AS entry FROM nodes"))
def x21(spark, sf_dir):
    """The test behind entry points of the graph."""
    return model.nodes(spark, sf_dir).select("node_id", op.likely_entry_point().alias("entry"))


@R.query(
    "f10_component_entry_points",
    on_graph(
        """SELECT n.node_id FROM nodes n LEFT JOIN (SELECT dst, count(*) AS fan_in FROM adjacency GROUP BY dst) d ON d.dst = n.node_id
        WHERE d.dst IS NULL AND type <> 'Configuration' AND (regexp_matches(lower(name), 'main|program|startup|entry|init|controller|service|api|handler')
          OR lower(type) IN ('controller', 'service', 'api') OR ((lower(type) IN ('controller', 'service') OR regexp_matches(lower(name), '(service|controller|manager)$')) AND coalesce(fan_in, 0) = 0))"""
    ),
)
def f10(spark, sf_dir):
    """Components that are no dependency's target and look like entry points."""
    g = model.graph(spark, sf_dir)
    rows = op.zero_in_degree(g).withColumn("fan_in", F.lit(0)).withColumn("is_public", op.is_public())
    return rows.filter(op.likely_component_entry()).select("node_id")


@R.query(
    "x22_likely_component_entry",
    on_graph(
        """SELECT n.node_id, type <> 'Configuration' AND (regexp_matches(lower(name), 'main|program|startup|entry|init|controller|service|api|handler')
          OR lower(type) IN ('controller', 'service', 'api') OR ((lower(type) IN ('controller', 'service') OR regexp_matches(lower(name), '(service|controller|manager)$')) AND coalesce(fan_in, 0) = 0)) AS entry
        FROM nodes n LEFT JOIN (SELECT dst, count(*) AS fan_in FROM adjacency GROUP BY dst) d ON d.dst = n.node_id"""
    ),
)
def x22(spark, sf_dir):
    """The test behind entry points of components."""
    g = model.graph(spark, sf_dir)
    degree = g.adjacency.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("fan_in"))
    rows = g.nodes.join(degree, "node_id", "left").fillna(0, ["fan_in"]).withColumn("is_public", op.is_public())
    return rows.select("node_id", op.likely_component_entry().alias("entry"))


@R.query("f11_visible_components", on_graph("SELECT node_id FROM nodes WHERE node_id NOT IN ('part::1', 'supplier::1') AND complexity BETWEEN 3 AND 12"))
def f11(spark, sf_dir):
    """Diagram filter on components."""
    return op.visible(model.nodes(spark, sf_dir), {"exclude": ["part::1", "supplier::1"], "complexity": (3, 12)}).select("node_id")


@R.query(
    "f12_visible_relationships",
    on_graph(
        "SELECT src, dst, type FROM edges WHERE type NOT IN ('Contains') AND src IN (SELECT node_id FROM v) AND dst IN (SELECT node_id FROM v)",
        "v AS (SELECT node_id FROM nodes WHERE complexity BETWEEN 3 AND 12)",
    ),
)
def f12(spark, sf_dir):
    """Diagram filter on relationships: both real ends must be visible."""
    g = model.graph(spark, sf_dir)
    return op.visible_edges(g.edges, op.visible(g.nodes, {"complexity": (3, 12)}), not_types=("Contains",)).select("src", "dst", "type")


@R.query(
    "f13_page_to_node",
    on_graph(
        """SELECT b.page_id, coalesce(min(struct_pack(r := r, n := node_id)).n, any_value(top)) AS node_id FROM p b
        LEFT JOIN (SELECT page_id, node_id, CASE WHEN lower(node_id) = title THEN 0 WHEN contains(lower(node_id), title) OR contains(title, lower(node_id)) THEN 1
          WHEN lower(node_id) = stem THEN 2 WHEN contains(lower(node_id), stem) OR contains(stem, lower(node_id)) THEN 3 END AS r FROM p, nodes) c
          ON c.page_id = b.page_id AND r IS NOT NULL CROSS JOIN t GROUP BY b.page_id""",
        "p AS (SELECT doc_id AS page_id, concat('nation::', doc_id) AS title, concat('part::', doc_id % 3) AS stem FROM documents)",
        "t AS (SELECT src AS top FROM (SELECT src, count(*) AS n FROM adjacency GROUP BY src) ORDER BY n DESC, src LIMIT 1)",
    ),
)
def f13(spark, sf_dir):
    """The node a page is about: by title, by file stem, else the best connected one."""
    g = model.graph(spark, sf_dir)
    out = g.adjacency.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("out_degree"))
    pages = table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("page_id"), F.concat(F.lit("nation::"), "doc_id").alias("title"), F.concat(F.lit("part::"), F.col("doc_id") % 3).alias("stem")
    )
    return op.resolve_pages(pages, g.nodes.join(out.hint("merge"), "node_id", "left").fillna(0, ["out_degree"]))


@R.query("f14_repository_search", "SELECT page_id, url FROM pages WHERE contains(lower(url), 'example.com/fr') OR contains(lower(html), 'nothing at all')")
def f14(spark, sf_dir):
    """Name or path contains the text, whatever the case."""
    rows = table(spark, sf_dir, "pages")
    return rows.filter(F.lower("url").contains("example.com/fr") | F.lower("html").contains("nothing at all")).select("page_id", "url")


@R.query(
    "f15_query_gate",
    """SELECT user_id, pending, pending = 0 AS allowed, pending * 0.1::DOUBLE AS wait_seconds
    FROM (SELECT user_id, count(*) FILTER (event_type = 'error') AS pending FROM events GROUP BY user_id)""",
)
def f15(spark, sf_dir):
    """The gate for each user, with errors as the pending files of a ready index."""
    rows = table(spark, sf_dir, "events").groupBy("user_id").agg(F.count_if(F.col("event_type") == "error").alias("pending"))
    return rows.select("user_id", "pending", (F.col("pending") == 0).alias("allowed"), (F.col("pending") * F.lit(0.1)).alias("wait_seconds"))


_SECTIONS = """s AS (SELECT 'r' || r_regionkey AS section_id, NULL::VARCHAR AS parent_id, r_name AS title FROM region
 UNION ALL SELECT 'n' || n_nationkey, 'r' || n_regionkey, n_name FROM nation)"""


@R.query(
    "f16_section_search",
    f"""WITH RECURSIVE {_SECTIONS}, up AS (SELECT section_id FROM s WHERE contains(lower(title), 'nation_1')
    UNION SELECT 'n' || c_nationkey FROM customer WHERE contains(lower(c_name), '00777')
    UNION SELECT s.parent_id FROM up JOIN s USING (section_id) WHERE s.parent_id IS NOT NULL) SELECT section_id FROM up""",
)
def f16(spark, sf_dir):
    """Sections that match themselves, in a page or in a descendant."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    s = region.select(F.concat(F.lit("r"), "r_regionkey").alias("section_id"), F.lit(None).cast("string").alias("parent_id"), F.col("r_name").alias("title"))
    s = s.unionByName(nation.select(F.concat(F.lit("n"), "n_nationkey").alias("section_id"), F.concat(F.lit("r"), "n_regionkey").alias("parent_id"), F.col("n_name").alias("title")))
    p = table(spark, sf_dir, "customer").filter(F.lower("c_name").contains("00777")).select(F.concat(F.lit("n"), "c_nationkey").alias("section_id"), F.lit("nation_1").alias("title"))
    return op.matching_sections(s, p, "nation_1", depth=2)


@R.query("f17_other_active_jobs", "SELECT event_id, event_type FROM events WHERE event_id <> 17 AND event_type NOT IN ('purchase', 'signup', 'error')")
def f17(spark, sf_dir):
    """Jobs but the current one that are neither completed, failed nor cancelled."""
    rows = table(spark, sf_dir, "events")
    return rows.filter((F.col("event_id") != 17) & ~F.col("event_type").isin("purchase", "signup", "error")).select("event_id", "event_type")

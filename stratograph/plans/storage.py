"""Queries over joins, set operations, storage, budgets, vectors and change detection."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.code import text_tokens
from ..operators import budget, joins, lookup, neighbours, references, retrieval, storage
from ..registry import Registry
from ..sources import model
from ..sources.tables import scratch, table
from ..streaming import events as streams
from .bindings import OCCURRENCES, names, on_graph

R = Registry()


def t(spark, sf_dir, name):
    return table(spark, sf_dir, name)


# joins


@R.query("j01_g04_dependency_names", on_graph("""SELECT c.node_id AS src, f.id AS dst, CASE WHEN lower(c.language) = lower(f.language) THEN 'Dependency' ELSE 'CrossBoundary' END AS type FROM
  (SELECT node_id, language, 'supplier#0000000' || lpad((complexity * 3)::VARCHAR, 2, '0') AS dep FROM nodes) c JOIN
  (SELECT lower(name) AS key, arg_min(node_id, node_id) AS id, arg_min(language, node_id) AS language FROM nodes GROUP BY 1) f ON f.key = c.dep"""))
def j01(spark, sf_dir):
    """Dependency names resolved to the first component of that name or file."""
    nodes = model.nodes(spark, sf_dir)
    wanted = nodes.select(F.col("node_id").alias("src"), "language", F.concat(F.lit("SUPPLIER#0000000"), F.lpad((F.col("complexity") * 3).cast("string"), 2, "0")).alias("dependency"))
    return joins.resolve_dependencies(wanted, nodes.select(F.col("node_id").alias("id"), F.col("node_id").alias("seq"), "name", "file_path", "language"))


@R.query("j02_g02_dangling_arcs_dropped", "SELECT l_suppkey, count(*) AS n FROM lineitem WHERE l_partkey IN (SELECT p_partkey FROM part WHERE p_size < 20) AND l_suppkey IN (SELECT s_suppkey FROM supplier WHERE s_suppkey < 50) GROUP BY 1")
def j02(spark, sf_dir):
    """Arcs with both ends present, after build."""
    n = t(spark, sf_dir, "part").filter("p_size < 20").select(F.concat(F.lit("p"), "p_partkey").alias("node_id"))
    n = n.unionByName(t(spark, sf_dir, "supplier").filter("s_suppkey < 50").select(F.concat(F.lit("s"), "s_suppkey").alias("node_id")))
    arcs = t(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), F.lit("strange").alias("type"), F.lit(1.0).alias("strength"))
    g = model.build(n, arcs)
    return g.adjacency.groupBy(F.substring("src", 2, 20).cast("long").alias("l_suppkey")).agg(F.count("*").alias("n"))


@R.query("g01_first_node_wins", "SELECT p_name AS node_id, arg_min(p_brand, p_partkey) AS type FROM part GROUP BY 1")
def g01(spark, sf_dir):
    """Of nodes with one id the first added stays."""
    nodes = t(spark, sf_dir, "part").select(F.col("p_name").alias("node_id"), F.col("p_partkey").alias("seq"), F.col("p_brand").alias("type"))
    arcs = spark.sql("select 1L seq, 'a' src, 'b' dst, 'Call' type, 1.0D strength")
    return model.build(nodes, arcs).nodes.select("node_id", "type")


@R.query("g02_first_edge_type_wins", "SELECT l_suppkey AS s, l_partkey AS p, CASE arg_min(l_returnflag, l_orderkey * 10 + l_linenumber) WHEN 'A' THEN 'Call' ELSE 'Dependency' END AS type FROM lineitem GROUP BY 1, 2")
def g02(spark, sf_dir):
    """A repeated pair keeps its first type; unknown types are dependencies."""
    li = t(spark, sf_dir, "lineitem")
    ids = li.select(F.explode(F.array(F.concat(F.lit("s"), "l_suppkey"), F.concat(F.lit("p"), "l_partkey"))).alias("node_id")).distinct()
    kind = F.when(F.col("l_returnflag") == "A", "Call").otherwise(F.col("l_returnflag"))
    arcs = li.select((F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("seq"), F.concat(F.lit("s"), "l_suppkey").alias("src"), F.concat(F.lit("p"), "l_partkey").alias("dst"), kind.alias("type"), F.lit(1.0).alias("strength"))
    e = model.build(ids, arcs).edges
    return e.select(F.substring("src", 2, 20).cast("long").alias("s"), F.substring("dst", 2, 20).cast("long").alias("p"), "type")


@R.query("g03_remove_files", on_graph("SELECT src, dst FROM edges WHERE src IN (SELECT node_id FROM nodes WHERE complexity <> 4) AND dst IN (SELECT node_id FROM nodes WHERE complexity <> 4)"))
def g03(spark, sf_dir):
    """Nodes of removed files go with their edges."""
    g = model.graph(spark, sf_dir)
    gone = g.nodes.filter("complexity = 4").select(F.upper("file_path").alias("file_path"))
    keep = g.nodes.filter("complexity <> 4").select(F.lower("file_path").alias("p")).distinct()
    gone = gone.join(keep, F.lower("file_path") == F.col("p"), "left_anti")
    shared = g.nodes.filter("complexity = 4").join(gone.select(F.lower("file_path").alias("q")).distinct(), F.lower("file_path") == F.col("q"), "left_anti").select("node_id")
    out = model.without_files(g, gone).edges
    return out.join(shared, F.col("src") == F.col("node_id"), "left_anti").join(shared, F.col("dst") == F.col("node_id"), "left_anti").select("src", "dst")


@R.query("g05_unknown_types", "SELECT o_orderstatus AS given, CASE o_orderstatus WHEN 'O' THEN 'Call' ELSE 'Dependency' END AS type, count(*) AS n FROM orders GROUP BY 1, 2")
def g05(spark, sf_dir):
    """Edge types of parse results; unknown ones become Dependency."""
    kind = F.when(F.col("o_orderstatus") == "O", "Call").otherwise(F.col("o_orderstatus"))
    known = F.when(kind.isin(*model.EDGE_TYPES), kind).otherwise("Dependency")
    return t(spark, sf_dir, "orders").groupBy(F.col("o_orderstatus").alias("given"), known.alias("type")).agg(F.count("*").alias("n"))


@R.query("g06_global_dependency_graph", "SELECT DISTINCT l_suppkey AS src, l_partkey AS dst, round(CASE WHEN l_suppkey % 2 = l_partkey % 2 THEN 1.5 ELSE 1.0 END * 1.3, 2)::DOUBLE AS weight FROM lineitem")
def g06(spark, sf_dir):
    """Weighted edges between files, each once."""
    from ..operators.quality import dependency_weight

    a, b = F.col("l_suppkey"), F.col("l_partkey")
    return t(spark, sf_dir, "lineitem").select(a.alias("src"), b.alias("dst"), dependency_weight(a % 2 == b % 2, F.lit(3)).cast("double").alias("weight")).distinct()


@R.query("j03_text_references", f"WITH {OCCURRENCES} SELECT doc_id AS src, 'b' || item_id AS dst, name, least(count(*), 10)::DOUBLE AS strength FROM occurrences JOIN names USING (name) GROUP BY ALL")
def j03(spark, sf_dir):
    """References of texts to names of any shape, ten at most."""
    found = names(spark, sf_dir).select(F.concat(F.lit("b"), "item_id", F.lit("/"), "name").alias("id"), "name", F.lit("Class").alias("type"))
    texts = t(spark, sf_dir, "documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), F.col("text").alias("t"))
    parts = F.split("dst", "/")
    return references.strengths(texts, found).select(F.substring("src", 2, 20).cast("long").alias("src"), parts[0].alias("dst"), parts[1].alias("name"), "strength")


@R.query("j04_import_to_file", """SELECT d AS dependency, min(f) AS target FROM (SELECT DISTINCT regexp_replace(lower(p_name), '[^a-z0-9]', '', 'g') AS d FROM part), (SELECT DISTINCT p_name || '/' || split_part(p_name, ' ', 1) || '.py' AS f, lower(split_part(p_name, ' ', 1)) AS s FROM part)
  WHERE d <> '' AND s <> '' AND (contains(d, s) OR contains(s, d)) GROUP BY d""")
def j04(spark, sf_dir):
    """The first file whose name contains an import's or lies in it."""
    part = t(spark, sf_dir, "part")
    files = part.select(F.concat("p_name", F.lit("/"), F.split_part("p_name", F.lit(" "), F.lit(1)), F.lit(".py")).alias("path")).distinct()
    rows = part.select(F.lit("x").alias("source"), F.regexp_replace(F.lower("p_name"), "[^a-z0-9]", "").alias("dependency")).distinct()
    return joins.import_to_file(rows, files).select("dependency", "target")


@R.query("j05_undocumented", "SELECT doc_id AS id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def j05(spark, sf_dir):
    """Components without a page."""
    pages = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return joins.documented(pages, t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))[0]


@R.query("j06_child_pages", "SELECT doc_id AS id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels)")
def j06(spark, sf_dir):
    """Pages found by id."""
    pages = t(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    return joins.documented(pages, t(spark, sf_dir, "documents").select(F.col("doc_id").alias("id")))[1]


@R.query("j07_repository_summaries", "SELECT d.doc_id AS repo_id, source AS url, coalesce(quality::VARCHAR, '(none)') AS title, quality IS NOT NULL AS has_structure FROM documents d LEFT JOIN labels l USING (doc_id)")
def j07(spark, sf_dir):
    """Repositories with their structures, where there are any."""
    repos = t(spark, sf_dir, "documents").select(F.col("doc_id").alias("repo_id"), F.col("source").alias("url"))
    return joins.summaries(repos, t(spark, sf_dir, "labels").select(F.col("doc_id").alias("repo_id"), F.col("quality").cast("string").alias("title")))


@R.query("j08_module_members", on_graph("SELECT split_part(node_id, '::', 1) AS module_id, node_id, line_count FROM nodes WHERE complexity > 10"))
def j08(spark, sf_dir):
    """Members of modules with their figures."""
    nodes = model.nodes(spark, sf_dir)
    members = nodes.select(F.split_part("node_id", F.lit("::"), F.lit(1)).alias("module_id"), "node_id")
    return members.join(nodes.filter("complexity > 10").select("node_id", "line_count"), "node_id").select("module_id", "node_id", "line_count")


@R.query("j10_service_connectivity", on_graph("SELECT (SELECT count(*) FROM s) AS services, count(*) AS links, count(*) / ((SELECT count(*) FROM s) * ((SELECT count(*) FROM s) - 1.0)) AS connectivity FROM (SELECT DISTINCT src, dst FROM adjacency WHERE src <> dst AND src IN (SELECT * FROM s) AND dst IN (SELECT * FROM s))", "s AS (SELECT node_id FROM nodes WHERE type IN ('Domain', 'Entity'))"))
def j10(spark, sf_dir):
    """How closely services are connected, by a join on arcs."""
    g = model.graph(spark, sf_dir)
    return joins.service_connectivity(g.nodes.filter("type in ('Domain', 'Entity')").select("node_id"), g.adjacency)


@R.query("j11_module_sections", "SELECT n_name AS module_id, min('s' || lpad(n_regionkey::VARCHAR, 2, '0')) AS section_id FROM nation WHERE n_nationkey > 2 GROUP BY 1")
def j11(spark, sf_dir):
    """The first section that lists a module."""
    rows = t(spark, sf_dir, "nation").withColumn("n", F.when(F.col("n_nationkey") > 2, F.col("n_name")).otherwise(" "))
    rows = rows.groupBy("n_regionkey").agg(F.collect_list("n").alias("module_ids"))
    return joins.module_sections(rows.select(F.concat(F.lit("s"), F.lpad(F.col("n_regionkey").cast("string"), 2, "0")).alias("section_id"), F.col("n_regionkey").alias("seq"), "module_ids"))


# set operations, sort and limit


@R.query("o01_except", "SELECT c_custkey FROM customer EXCEPT SELECT o_custkey FROM orders")
def o01(spark, sf_dir):
    """New or deleted keys."""
    return t(spark, sf_dir, "customer").select("c_custkey").subtract(t(spark, sf_dir, "orders").select("o_custkey"))


@R.query("o02_union_all", on_graph("SELECT src AS a, dst AS b FROM adjacency WHERE src = 'part::9' UNION ALL SELECT dst, src FROM adjacency WHERE dst = 'part::9'"))
def o02(spark, sf_dir):
    """Neighbours out and in, repeats kept."""
    a = model.graph(spark, sf_dir).adjacency
    out = a.filter("src = 'part::9'").select(F.col("src").alias("a"), F.col("dst").alias("b"))
    return out.unionByName(a.filter("dst = 'part::9'").select(F.col("dst").alias("a"), F.col("src").alias("b")))


@R.query("o03_intersect", "SELECT DISTINCT doc_id FROM documents WHERE doc_id IN (SELECT conv_id FROM conversations)")
def o03(spark, sf_dir):
    """Keys on both sides."""
    return t(spark, sf_dir, "documents").select("doc_id").intersect(t(spark, sf_dir, "conversations").select("conv_id"))


@R.query("o04_distinct", on_graph("SELECT DISTINCT type, language FROM nodes"))
def o04(spark, sf_dir):
    """Distinct pairs."""
    return model.nodes(spark, sf_dir).select("type", "language").distinct()


@R.query("o05_sort", on_graph("SELECT node_id, row_number() OVER (ORDER BY length(name) DESC, node_id) AS place FROM nodes WHERE type = 'Service'"))
def o05(spark, sf_dir):
    """Longest names first, ties by id."""
    rows = model.nodes(spark, sf_dir).filter("type = 'Service'")
    return rows.select("node_id", F.row_number().over(Window.orderBy(F.desc(F.length("name")), "node_id")).cast("long").alias("place"))


@R.query("o06_take_skip_last", "SELECT conv_id, turn FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations) WHERE n <= 5")
def o06(spark, sf_dir):
    """The last five messages of each conversation."""
    return budget.last_messages(t(spark, sf_dir, "conversations")).select("conv_id", "turn")


@R.query("o07_flatten", "SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents")
def o07(spark, sf_dir):
    """Lists of lists as one."""
    return t(spark, sf_dir, "documents").select("doc_id", F.explode(F.split("text", "\n")).alias("line"))


@R.query("o08_zip", "SELECT doc_id, round(quality * 0.9::DOUBLE + toxic * 0.8::DOUBLE, 6) AS s FROM labels")
def o08(spark, sf_dir):
    """Scores with their reliabilities, pairwise."""
    pairs = F.arrays_zip(F.array(F.col("quality"), F.col("toxic")).alias("a"), F.array(F.lit(0.9), F.lit(0.8)).alias("b"))
    return t(spark, sf_dir, "labels").select("doc_id", F.round(F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x["a"] * x["b"].cast("double")), 6).alias("s"))


# statements on keyed tables


@R.query("q01_upsert", "SELECT user_id, arg_max(event_type, event_id) AS event_type, max(event_id) AS event_id FROM events GROUP BY 1")
def q01(spark, sf_dir):
    """The last row of each key."""
    return storage.latest(t(spark, sf_dir, "events").select("user_id", "event_type", "event_id"), "event_id", "user_id")


@R.query("q02_upsert_composite", "SELECT user_id, event_type, arg_max(value, event_id) AS value FROM events GROUP BY 1, 2")
def q02(spark, sf_dir):
    """The same by two keys."""
    return storage.latest(t(spark, sf_dir, "events").select("user_id", "event_type", "event_id", "value"), "event_id", "user_id", "event_type").select("user_id", "event_type", "value")


@R.query("q03_point_select", "SELECT * FROM customer WHERE c_custkey = 77")
def q03(spark, sf_dir):
    """One row by key."""
    return t(spark, sf_dir, "customer").filter("c_custkey = 77")


@R.query("q04_title_lookup", "SELECT c_custkey AS page_id FROM customer WHERE lower(c_name) = 'customer#000000042' ORDER BY 1 LIMIT 1")
def q04(spark, sf_dir):
    """The first page of a title, ASCII case folded."""
    return storage.by_title(t(spark, sf_dir, "customer").select(F.col("c_custkey").alias("page_id"), F.col("c_name").alias("title")), "CUSTOMER#000000042").select("page_id")


@R.query("q05_delete_cascade", "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_nationkey = 3)")
def q05(spark, sf_dir):
    """Rows whose parents were deleted go too."""
    gone = t(spark, sf_dir, "customer").filter("c_nationkey = 3").select(F.col("c_custkey").alias("o_custkey"))
    return storage.delete(t(spark, sf_dir, "orders"), gone, "o_custkey").select("o_orderkey")


@R.query("q06_lists", "SELECT n_nationkey, row_number() OVER (ORDER BY n_nationkey DESC) AS place FROM nation")
def q06(spark, sf_dir):
    """Repositories by id, the last first."""
    return t(spark, sf_dir, "nation").select("n_nationkey", F.row_number().over(Window.orderBy(F.desc("n_nationkey"))).cast("long").alias("place"))


@R.query("q07_summary", "SELECT c_custkey, CASE WHEN max(o_orderkey) IS NULL THEN 'empty' ELSE 'filled' END AS state, count(o_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY 1")
def q07(spark, sf_dir):
    """A left join with a case."""
    n = t(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("n"))
    rows = t(spark, sf_dir, "customer").select("c_custkey").join(n, "c_custkey", "left")
    return rows.select("c_custkey", F.when(F.col("n").isNull(), "empty").otherwise("filled").alias("state"), F.coalesce("n", F.lit(0)).alias("n"))


@R.query("q08_get_or_create_id", "SELECT p_brand AS key, CASE WHEN p_brand = 'Brand#7' THEN 100 ELSE 100 + row_number() OVER (PARTITION BY p_brand = 'Brand#7' ORDER BY p_brand) END AS id FROM (SELECT DISTINCT p_brand FROM part)")
def q08(spark, sf_dir):
    """New keys are numbered after known ones."""
    return joins.numbered(t(spark, sf_dir, "part").select(F.col("p_brand").alias("key")), spark.sql("select 'Brand#7' key, 100L id"), "key")


@R.query("q09_active_job", "SELECT event_id FROM events WHERE user_id = 5 AND event_type IN ('view', 'click')")
def q09(spark, sf_dir):
    """Active jobs of one source."""
    return t(spark, sf_dir, "events").filter((F.col("user_id") == 5) & F.col("event_type").isin("view", "click")).select("event_id")


@R.query("q10_active_or_recent", "SELECT event_id AS job_id FROM events WHERE event_type NOT IN ('Completed', 'Failed', 'Cancelled') AND event_type <> 'purchase' OR ts > TIMESTAMP '2024-01-20 00:00:00' - INTERVAL 24 HOUR")
def q10(spark, sf_dir):
    """Jobs that run, and those of the last day."""
    done = F.when(F.col("event_type") == "purchase", "Completed").otherwise(F.col("event_type"))
    jobs = t(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), done.alias("status"), F.col("ts").alias("created_at"))
    return storage.recent_or_active(jobs, datetime(2024, 1, 20)).select("job_id")


@R.query("q11_guarded_cancel", "SELECT event_id AS job_id, CASE WHEN event_id = 9 AND event_type <> 'error' THEN 'Cancelled' WHEN event_type = 'error' THEN 'Failed' ELSE event_type END AS status FROM events")
def q11(spark, sf_dir):
    """A cancel changes only a job that is not over."""
    failed = F.when(F.col("event_type") == "error", "Failed").otherwise(F.col("event_type"))
    return storage.cancel(t(spark, sf_dir, "events").select(F.col("event_id").alias("job_id"), failed.alias("status")), 9)


@R.query("q12_phase_status", "SELECT event_type, CASE event_type WHEN 'purchase' THEN 'Completed' ELSE 'Analyzing' END AS status, count(*) AS n FROM events GROUP BY 1, 2")
def q12(spark, sf_dir):
    """The state that a phase reports."""
    phase = F.when(F.col("event_type") == "purchase", "Complete").otherwise(F.col("event_type"))
    return t(spark, sf_dir, "events").groupBy("event_type", storage.phase_status(phase).alias("status")).agg(F.count("*").alias("n"))


@R.query("q13_added_column", "SELECT r_regionkey, NULL::VARCHAR AS status FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def q13(spark, sf_dir):
    """Old rows read under a schema with a new column."""
    new = t(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("r_regionkey"), F.col("n_name").alias("status"))
    return t(spark, sf_dir, "region").select("r_regionkey").unionByName(new, allowMissingColumns=True)


# context budgets


@R.query("c01_strategy", "SELECT conv_id, CASE WHEN n > 2000 THEN 'iterative' WHEN conv_id % 2 = 0 THEN 'rag' WHEN n < 900 THEN 'simple' ELSE 'error' END AS strategy FROM (SELECT conv_id, sum(length(text) // 4) AS n FROM conversations GROUP BY 1)")
def c01(spark, sf_dir):
    """The first strategy that applies."""
    rows = budget.valid(t(spark, sf_dir, "conversations"), 4096)
    n = F.col("tokens")
    return rows.select("conv_id", budget.strategy(n > 2000, F.col("conv_id") % 2 == 0, n < 900).alias("strategy"))


@R.query("c02_c03_fit", "SELECT doc_id, length(text) // 4 < 3000 - 2048 AS fits, length(text) // 4 + 50 > 3000 - 2048 AS chunks FROM documents")
def c02(spark, sf_dir):
    """Whether a text fits, and whether it needs chunks."""
    n = text_tokens(F.col("text"))
    return t(spark, sf_dir, "documents").select("doc_id", budget.fits(n, 3000).alias("fits"), budget.needs_chunks(n, F.lit(50), 3000).alias("chunks"))


@R.query("c04_chunk_sizes", "SELECT p_partkey, floor(f * 0.5)::BIGINT * 4 AS size, floor(f * 0.5)::BIGINT * 4 // 10 AS overlap FROM (SELECT p_partkey, CASE WHEN p_size * 200 - 2248 <= 0 THEN floor(p_size * 200 * 0.7::DOUBLE)::BIGINT ELSE p_size * 200 - 2248 END AS f FROM part)")
def c04(spark, sf_dir):
    """Characters of chunks and overlaps for a context size."""
    size, overlap = budget.chunk_sizes(F.col("p_size") * 200)
    return t(spark, sf_dir, "part").select("p_partkey", size.alias("size"), overlap.alias("overlap"))


@R.query("c05_compaction", "SELECT conv_id, turn, sum(length(text) // 4) OVER (PARTITION BY conv_id ORDER BY turn) > 300 AS compact FROM conversations")
def c05(spark, sf_dir):
    """Where rolling findings grow too long."""
    rows = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), text_tokens(F.col("text")).alias("tokens"))
    return budget.compacted(rows, 300).select(F.col("key").alias("conv_id"), F.col("seq").alias("turn"), "compact")


@R.query("c06_synthesis_batches", """WITH RECURSIVE r AS (SELECT conv_id AS key, turn AS seq, length(text) // 4 AS t, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS i FROM conversations),
  f AS (SELECT key, i, 0 AS batch, t AS used FROM r WHERE i = 1 UNION ALL SELECT r.key, r.i, batch + (used > 0 AND used + t > 316)::INT, CASE WHEN used > 0 AND used + t > 316 THEN t ELSE used + t END FROM f JOIN r ON r.key = f.key AND r.i = f.i + 1)
  SELECT key, seq, batch FROM f JOIN r USING (key, i)""")
def c06(spark, sf_dir):
    """Greedy batches of texts for synthesis."""
    rows = t(spark, sf_dir, "conversations").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), text_tokens(F.col("text")).alias("tokens"))
    return budget.synthesis_batches(rows, 2800)


@R.query("c07_history_batches", "SELECT conv_id, turn, ((row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // greatest(3, n // 3))::INT AS batch, (row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1) // greatest(3, n // 3) = (n - 1) // greatest(3, n // 3) AS verbatim FROM (SELECT *, count(*) OVER (PARTITION BY conv_id) AS n FROM conversations)")
def c07(spark, sf_dir):
    """Batches of a history; the last stays verbatim."""
    return budget.history_batches(t(spark, sf_dir, "conversations"))


def _synthesis(context: int) -> str:
    """Level after level, each batched by a recursion over its findings in order."""
    room = context - budget.RESPONSE - 300
    out = ["l0 AS (SELECT conv_id AS key, turn AS seq, length(text)::BIGINT AS length FROM conversations WHERE text IS NOT NULL)"]
    for i in range(budget.LEVELS + 2):
        out.append(f"s{i} AS MATERIALIZED (SELECT *, (sum(length) OVER w + 7 * (count(*) OVER w - 1)) // 4 <= {room * budget.FINAL}::DOUBLE AS fits, row_number() OVER (PARTITION BY key ORDER BY seq) AS i FROM l{i} WINDOW w AS (PARTITION BY key))")
        if i <= budget.LEVELS:
            over = f"used + length // 4 > {room * budget.BATCH}::DOUBLE"
            out.append(f"f{i} AS (SELECT key, i, 0 AS batch, length // 4 AS used FROM s{i} WHERE i = 1 AND NOT fits UNION ALL SELECT s{i}.key, s{i}.i, batch + ({over})::INT, CASE WHEN {over} THEN length // 4 ELSE used + length // 4 END FROM f{i} JOIN s{i} ON s{i}.key = f{i}.key AND s{i}.i = f{i}.i + 1)")
            out.append(f"l{i + 1} AS (SELECT key, batch::BIGINT AS seq, least(ceil((sum(length) + 2 * (count(*) - 1)) / 2)::BIGINT, {int(room * budget.COMPACT) * 4}) AS length FROM f{i} JOIN s{i} USING (key, i) GROUP BY key, batch)")
    parts = []
    for i in range(budget.LEVELS + 2):
        ends = "fits" if i <= budget.LEVELS else "true"
        parts.append(f"SELECT key, {i} AS level, seq, length, -1 AS batch, NOT fits AS forced FROM s{i} WHERE {ends}")
        if i <= budget.LEVELS:
            parts.append(f"SELECT key, {i} AS level, seq, length, batch, false AS forced FROM f{i} JOIN s{i} USING (key, i)")
    return f"WITH RECURSIVE {', '.join(out)} {' UNION ALL '.join(parts)}"


@R.query("c06_synthesis_levels", _synthesis(2500))
def c06_levels(spark, sf_dir):
    """Levels of synthesis until a conversation's findings fit one call."""
    rows = t(spark, sf_dir, "conversations").filter("text is not null").select(F.col("conv_id").alias("key"), F.col("turn").alias("seq"), F.length("text").alias("length"))
    return budget.synthesis_levels(rows, 2500)


def _history(context: int, other: int) -> str:
    room = context - budget.RESPONSE
    out = [
        "t AS (SELECT conv_id // 10 AS key, conv_id * 1000 + turn AS place, length(role) AS role, length(coalesce(text, ''))::BIGINT AS length FROM conversations)",
        f"h0 AS MATERIALIZED (SELECT key, row_number() OVER (PARTITION BY key ORDER BY place) AS pos, role, length, place AS first, place AS last, false AS summarised, count(*) OVER w > 10 AND sum(length // 4) OVER w > {room} AS long FROM t WINDOW w AS (PARTITION BY key))",
        "r0 AS (SELECT key, pos, role, length, first, last, summarised FROM h0 WHERE long)",
    ]
    for i in range(budget.PASSES + 1):
        out.append(f"z{i} AS MATERIALIZED (SELECT *, sum(length // 4) OVER w + {other} < {room} AS fits, (pos - 1) // greatest(3, count(*) OVER w // 3) AS batch, (count(*) OVER w - 1) // greatest(3, count(*) OVER w // 3) AS final FROM r{i} WINDOW w AS (PARTITION BY key))")
        out.append(f"""r{i + 1} AS MATERIALIZED (SELECT key, batch + row_number() OVER (PARTITION BY key ORDER BY pos) AS pos, role, length, first, last, summarised FROM z{i} WHERE NOT fits AND batch = final
          UNION ALL SELECT key, batch + 1, 9, length('[Summary of ' || count(*) || ' messages]: ') + least(200, sum(role + 2 + length) + 2 * (count(*) - 1))::BIGINT, min(first), max(last), true FROM z{i} WHERE NOT fits AND batch < final GROUP BY key, batch)""")
    parts = ["SELECT key, pos, first, last, length, summarised, 0 AS passes, false AS truncated FROM h0 WHERE NOT long"]
    parts += [f"SELECT key, pos, first, last, length, summarised, {i}, false FROM z{i} WHERE fits" for i in range(budget.PASSES + 1)]
    parts.append(f"SELECT key, row_number() OVER (PARTITION BY key ORDER BY pos), first, last, length, summarised, {budget.PASSES}, true FROM (SELECT * FROM z{budget.PASSES} WHERE NOT fits QUALIFY row_number() OVER (PARTITION BY key ORDER BY pos DESC) <= {budget.KEPT})")
    return f"WITH {', '.join(out)} SELECT key, pos::INT AS pos, first, last, length, summarised, passes, truncated FROM ({' UNION ALL '.join(parts)})"


def _histories(spark, sf_dir):
    """Ten conversations after each other as one history."""
    at = F.col("conv_id") * 1000 + F.col("turn")
    return t(spark, sf_dir, "conversations").select(F.expr("conv_id div 10").alias("key"), at.alias("pos"), "role", F.length(F.coalesce("text", F.lit(""))).alias("length"))


@R.query("c07_history_passes", _history(2600, 40))
def c07_passes(spark, sf_dir):
    """Passes over long histories until they fit, else their last messages."""
    return budget.reduced_history(_histories(spark, sf_dir), 2600, 40)


@R.query("c07_history_passes_tight", _history(2250, 0))
def c07_tight(spark, sf_dir):
    """The same where there is little room, so that passes run out."""
    return budget.reduced_history(_histories(spark, sf_dir), 2250)


@R.query("c09_message_validation", "SELECT conv_id, sum(length(text) // 4) AS tokens, sum(length(text) // 4) <= 2800 - 2048 AS valid FROM conversations GROUP BY 1")
def c09(spark, sf_dir):
    """Tokens of a conversation against its budget."""
    return budget.valid(t(spark, sf_dir, "conversations"), 2800)


@R.query("c10_model_routing", "SELECT event_id, CASE event_type WHEN 'view' THEN 'small' WHEN 'click' THEN 'large' END AS model FROM events")
def c10(spark, sf_dir):
    """The model of a task type, or none."""
    return t(spark, sf_dir, "events").select("event_id", budget.routed(F.col("event_type"), {"view": "small", "click": "large"}).alias("model"))


@R.query("c11_progress", "SELECT event_id, round(20 + value / 100 * 60, 6) AS progress FROM events")
def c11(spark, sf_dir):
    """Progress within a nested range."""
    return t(spark, sf_dir, "events").select("event_id", F.round(budget.scaled(F.col("value"), F.lit(20.0), F.lit(80.0)), 6).alias("progress"))


@R.query("c12_synthesis_strategy", "SELECT doc_id, CASE WHEN doc_id % 11 = 0 OR length(text) > 1000 * 3.5 THEN 'map_reduce' WHEN doc_id % 5 = 0 THEN 'chain_of_key' WHEN doc_id % 3 > 0 THEN 'entity_anchored' ELSE 'direct' END AS strategy FROM documents")
def c12(spark, sf_dir):
    """How a page is synthesised."""
    i = F.col("doc_id")
    return t(spark, sf_dir, "documents").select("doc_id", budget.synthesis(F.length("text"), F.lit(1000), i % 11 == 0, i % 3, i % 5 == 0).alias("strategy"))


@R.query("c13_related_caps", "SELECT l_suppkey, l_partkey FROM (SELECT l_suppkey, l_partkey, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_partkey) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey FROM lineitem)) WHERE n <= 10")
def c13(spark, sf_dir):
    """The first ten dependencies of each node."""
    return budget.capped(t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey").distinct(), "l_suppkey", "l_partkey", 10)


# vectors


def _vectors(spark, sf_dir):
    rows = model.vectors(spark, sf_dir)
    payload = F.create_map(F.lit("label"), F.col("label"), F.lit("pageTitle"), F.concat(F.lit("Page "), "doc_id"))
    return rows.select("doc_id", "embedding", F.concat(F.lit("text "), "doc_id").alias("text"), payload.alias("payload"))


def _query(spark, sf_dir):
    return [float(x) for x in model.vectors(spark, sf_dir).filter("doc_id = 0").first()["embedding"]]


_COS = "list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[])"


@R.query("v01_collection_size", "SELECT vec_id FROM embeddings WHERE len(embedding) = 64")
def v01(spark, sf_dir):
    """Vectors of the collection's size."""
    return retrieval.collection(_vectors(spark, sf_dir), 64).select(F.col("doc_id").alias("vec_id"))


@R.query("v02_upsert", "SELECT vec_id AS doc_id, CASE WHEN vec_id % 7 = 0 THEN 'new' ELSE 'old' END AS state FROM embeddings")
def v02(spark, sf_dir):
    """The latest row of each id."""
    old = _vectors(spark, sf_dir).select("doc_id", F.lit("old").alias("state"), F.lit(1).alias("seq"))
    new = _vectors(spark, sf_dir).filter("doc_id % 7 = 0").select("doc_id", F.lit("new").alias("state"), F.lit(2).alias("seq"))
    return retrieval.upsert(old, new).select("doc_id", "state")


@R.query("v03_top_k", f"SELECT v.vec_id AS doc_id, round({_COS}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY {_COS} DESC, 1 LIMIT 10")
def v03(spark, sf_dir):
    """The ten nearest vectors."""
    return retrieval.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 10).select("doc_id", F.round("score", 6).alias("score"))


@R.query("v03_top_k_filtered", f"SELECT v.vec_id AS doc_id, round({_COS}, 6) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q WHERE label = 3 ORDER BY {_COS} DESC, 1 LIMIT 10")
def v03_filtered(spark, sf_dir):
    """The ten nearest vectors of one label."""
    return retrieval.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 10, {"label": "3"}).select("doc_id", F.round("score", 6).alias("score"))


_MANY = """m AS (SELECT q.vec_id AS query_id, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 12) DESC, v.vec_id)::INT AS rank, v.vec_id AS doc_id,
  round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 9) AS score FROM embeddings q, embeddings v WHERE q.vec_id % 100 = 0 QUALIFY rank <= 10)"""


def _many(spark, sf_dir):
    rows = model.vectors(spark, sf_dir)
    queries = rows.filter("doc_id % 100 = 0").select(F.col("doc_id").alias("query_id"), "embedding")
    return neighbours.nearest(neighbours.build(rows, 64), queries, 10)


@R.query("v03_many_queries", f"WITH {_MANY} SELECT * FROM m")
def v03_many(spark, sf_dir):
    """The ten nearest of every hundredth vector among all, from an inverted file."""
    return _many(spark, sf_dir).select("query_id", "rank", "doc_id", F.round("score", 9).alias("score"))


@R.query("v09_many_contexts", f"WITH {_MANY} SELECT query_id, string_agg('Source [' || rank || ']: Page ' || doc_id || chr(10) || text || chr(10) || '---' || chr(10), '' ORDER BY rank) AS context FROM m JOIN documents USING (doc_id) WHERE text IS NOT NULL GROUP BY query_id")
def v09_many(spark, sf_dir):
    """The context of every query: the texts of its nearest vectors, numbered and titled."""
    payload = F.create_map(F.lit("pageTitle"), F.concat(F.lit("Page "), "doc_id"))
    documents = t(spark, sf_dir, "documents").select("doc_id", "text", payload.alias("payload"))
    return neighbours.contexts(_many(spark, sf_dir), documents)


@R.query("v04_delete_by_filter", "SELECT vec_id AS doc_id FROM embeddings WHERE label <> 4")
def v04(spark, sf_dir):
    """What stays after a delete by payload."""
    return retrieval.delete(_vectors(spark, sf_dir), {"label": "4"}).select("doc_id")


@R.query("v05_delete_collection", "SELECT label::VARCHAR AS collection, count(*) AS n FROM embeddings WHERE label <> 3 GROUP BY 1")
def v05(spark, sf_dir):
    """The collections left, a folder each, after one of them is deleted."""
    path = scratch(spark, "collections")
    model.vectors(spark, sf_dir).withColumnRenamed("label", "collection").write.partitionBy("collection").parquet(path)
    retrieval.delete_collection(spark, path, "3")
    left = spark.read.schema("doc_id long, embedding array<float>, collection string").parquet(path)
    return left.groupBy("collection").agg(F.count("*").alias("n"))


@R.query("v06_v07_index_chunks", "SELECT doc_id AS page_id, CASE WHEN length(text) <= 2048 THEN 1 ELSE ceil((length(text) - 2048) / 1848.0)::BIGINT + 1 END AS chunks FROM documents WHERE length(text) > 0")
def v06(spark, sf_dir):
    """Chunks of each page with their payload."""
    rows = retrieval.index_pages(model.pages(spark, sf_dir), "repo")
    return rows.groupBy(F.col("payload")["pageId"].cast("long").alias("page_id")).agg(F.count("*").alias("chunks"))


@R.query("v08_delete_index", "SELECT 'kept' AS repo, sum(CASE WHEN length(text) <= 2048 THEN 1 ELSE ceil((length(text) - 2048) / 1848.0)::BIGINT + 1 END)::BIGINT AS chunks FROM documents WHERE length(text) > 0")
def v08(spark, sf_dir):
    """Of two repositories' chunks those of one go, by its path."""
    pages = model.pages(spark, sf_dir)
    both = retrieval.index_pages(pages, "kept").unionByName(retrieval.index_pages(pages, "dropped"))
    left = retrieval.delete(both, {"repoPath": "dropped"})
    return left.groupBy(F.col("payload")["repoPath"].alias("repo")).agg(F.count("*").alias("chunks"))


@R.query("v09_rag_context", f"SELECT string_agg('Source [' || r || ']: Page ' || i || chr(10) || 'text ' || i || chr(10) || '---' || chr(10), '' ORDER BY r) AS context FROM (SELECT v.vec_id AS i, row_number() OVER (ORDER BY {_COS} DESC, v.vec_id) AS r FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q) WHERE r <= 5")
def v09(spark, sf_dir):
    """The five nearest texts as numbered sources."""
    return retrieval.context(retrieval.top_k(_vectors(spark, sf_dir), _query(spark, sf_dir), 5))


@R.query("v10_rag_evaluation", "SELECT count(*) > 10 AS used FROM documents")
def v10(spark, sf_dir):
    """Retrieval is used for evaluation beyond ten pages."""
    return model.pages(spark, sf_dir).agg((F.count("*") > 10).alias("used"))


# change detection and event streams, on tables


@R.query("i01_polling_changes", "SELECT coalesce(a.p, b.p) AS path, CASE WHEN a.p IS NULL THEN 'new' WHEN b.p IS NULL THEN 'deleted' ELSE 'modified' END AS change FROM (SELECT event_id AS p, value AS s FROM events WHERE event_id < 6000) a FULL JOIN (SELECT event_id AS p, CASE WHEN event_id % 10 = 0 THEN value + 1 ELSE value END AS s FROM events WHERE event_id >= 3000) b ON a.p = b.p WHERE a.p IS NULL OR b.p IS NULL OR a.s <> b.s")
def i01(spark, sf_dir):
    """New, modified and deleted files between two snapshots."""
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("path"), F.col("value").alias("stamp"))
    new = e.filter("path >= 3000").withColumn("stamp", F.when(F.col("path") % 10 == 0, F.col("stamp") + 1).otherwise(F.col("stamp")))
    return storage.changes(e.filter("path < 6000"), new)


@R.query("i02_debounced_changes", """SELECT user_id AS key, min(ts) AS started, count(*) AS n FROM (SELECT user_id, ts, sum(b) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS g FROM (SELECT user_id, ts, event_id,
  CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS b FROM events)) GROUP BY user_id, g""")
def i02(spark, sf_dir):
    """Bursts of changes without a longer pause."""
    rows = streams.debounced(t(spark, sf_dir, "events").select(F.col("user_id").alias("key"), "ts"), "30 minutes")
    return rows.select("key", "started", "n")


@R.query("i03_index_refresh", "SELECT event_id AS path FROM events WHERE event_id % 3 = 0 EXCEPT SELECT event_id FROM events WHERE event_id % 2 = 0")
def i03(spark, sf_dir):
    """Paths that the index does not have yet."""
    e = t(spark, sf_dir, "events").select(F.col("event_id").alias("path"))
    return e.filter("path % 3 = 0").join(e.filter("path % 2 = 0"), "path", "left_anti")


@R.query("i04_reindexed_files", on_graph("SELECT src, dst FROM edges WHERE src NOT LIKE 'supplier::%' AND dst NOT LIKE 'supplier::%' UNION ALL SELECT 'supplier::new', 'part::1'"))
def i04(spark, sf_dir):
    """Files parsed again replace what they had."""
    g = model.graph(spark, sf_dir)
    gone = g.nodes.filter("type = 'Service'").select("file_path")
    nodes = spark.sql("select 'supplier::new' node_id, 'Service' type")
    arcs = spark.sql("select 'supplier::new' src, 'part::1' dst, 'Call' type, 1.0D strength")
    return streams.reindexed(g, gone, nodes, arcs).edges.select("src", "dst")


@R.query("i06_routed_messages", "SELECT event_id FROM events WHERE event_type IN ('signup', 'error')")
def i06(spark, sf_dir):
    """Messages of the types subscribed to."""
    return streams.routed(t(spark, sf_dir, "events").withColumnRenamed("event_type", "type"), "signup", "error").select("event_id")


@R.query("i07_telemetry", "SELECT event_type, json_extract(props, '$.k')::BIGINT % 3 AS k, count(*) AS n FROM events WHERE event_type <> 'view' GROUP BY 1, 2")
def i07(spark, sf_dir):
    """Telemetry by type and property."""
    k = F.get_json_object("props", "$.k").cast("long") % 3
    return streams.routed(t(spark, sf_dir, "events").withColumn("type", F.col("event_type")), "purchase", "signup", "click", "error").groupBy("event_type", k.alias("k")).agg(F.count("*").alias("n"))


@R.query("i08_resumed_steps", "SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality = 1)")
def i08(spark, sf_dir):
    """Steps that have no stored result yet."""
    done = t(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return t(spark, sf_dir, "documents").select("doc_id").join(done, "doc_id", "left_anti")


@R.query("i11_live_status", "SELECT user_id AS sender, arg_max(event_type, ts) AS status, max(ts) AS at FROM events GROUP BY 1")
def i11(spark, sf_dir):
    """The last status of each sender."""
    return streams.latest_status(t(spark, sf_dir, "events").select(F.col("user_id").alias("sender"), F.col("event_type").alias("status"), "ts"))


@R.query("u01_registry")
def u01(spark, sf_dir):
    """The names and descriptions of all queries."""
    from . import all_queries

    return spark.createDataFrame([(n, (f.__doc__ or "").strip()) for n, f in sorted(all_queries().items())], "name string, description string")


@R.query("s10_s11_graph_index", on_graph("SELECT src, dst, type FROM edges"))
def s10(spark, sf_dir):
    """A graph through its JSON index and back."""
    from ..sources import index

    return index.from_json(index.to_json(model.graph(spark, sf_dir))).edges.select("src", "dst", "type")


@R.query("f13_first_match_rows", "SELECT l_suppkey, min(l_partkey) AS l_partkey FROM lineitem GROUP BY 1")
def first_match(spark, sf_dir):
    """First match per key."""
    return lookup.first_match(t(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey"), "l_suppkey", "l_partkey").select("l_suppkey", "l_partkey")

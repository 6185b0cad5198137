"""Queries over quality metrics, consensus and module aggregates."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import prose
from ..operators import architecture, quality, trees
from ..registry import Registry
from ..sources import model
from ..sources.tables import table
from .bindings import on_graph

R = Registry()

_W = f"len(regexp_extract_all(text, '{prose.WORDS}'))"
_READ = f"""CASE WHEN {_W} < 50 THEN 80 WHEN {_W} > 2000 THEN 90 ELSE 100 END - CASE WHEN len(regexp_extract_all(text, '(?m)^#+\\s')) < 2 THEN 15 ELSE 0 END
 - CASE WHEN (len(regexp_extract_all(text, '```')) // 2 = 0 AND contains(text, 'class')) OR contains(text, 'function') THEN 10 ELSE 0 END
 - CASE WHEN len(regexp_extract_all(text, '\\[.*?\\]\\(.*?\\)')) = 0 THEN 5 ELSE 0 END"""


@R.query("a05_by_directory", on_graph("SELECT string_split(file_path, '/')[-2] AS directory, count(*) AS n, min(node_id) AS first FROM nodes GROUP BY 1"))
def a05(spark, sf_dir):
    """Nodes of each parent directory."""
    from ..functions.code import parent_directory

    return model.nodes(spark, sf_dir).groupBy(parent_directory(F.col("file_path")).alias("directory")).agg(F.count("*").alias("n"), F.min("node_id").alias("first"))


@R.query("a06_directory_clusters", on_graph("SELECT upper(split_part(file_path, '/', 1)[1]) || split_part(file_path, '/', 1)[2:] AS cluster, count(*) AS n FROM nodes GROUP BY 1"))
def a06(spark, sf_dir):
    """Clusters by top directory, title-cased."""
    top = F.split_part(F.col("file_path"), F.lit("/"), F.lit(1))
    return model.nodes(spark, sf_dir).groupBy(F.initcap(top).alias("cluster")).agg(F.count("*").alias("n"))


@R.query("a07_subdirectory_clusters", on_graph("SELECT CASE WHEN len(string_split(file_path, '/')) > 2 THEN string_split(file_path, '/')[2] ELSE 'Root' END AS cluster, count(*) AS n FROM nodes WHERE type IN ('Domain', 'Entity') GROUP BY 1"))
def a07(spark, sf_dir):
    """Clusters by the first directory below the common one."""
    parts = F.split("file_path", "/")
    rows = model.nodes(spark, sf_dir).filter("type in ('Domain', 'Entity')")
    return rows.groupBy(F.when(F.size(parts) > 2, F.element_at(parts, 2)).otherwise("Root").alias("cluster")).agg(F.count("*").alias("n"))


@R.query("a08_module_rollup", on_graph("SELECT split_part(node_id, '::', 1) AS module, sum(line_count * 1.3::DOUBLE + complexity * 10) AS est_tokens, sum(complexity) AS complexity, bool_or(type = 'Service') AS entry FROM nodes GROUP BY 1").replace("sum(line_count", "round(sum(line_count").replace("* 10) AS est", "* 10), 3) AS est"))
def a08(spark, sf_dir):
    """Tokens, complexity and entry points of each module."""
    rows = model.nodes(spark, sf_dir).groupBy(F.split_part(F.col("node_id"), F.lit("::"), F.lit(1)).alias("module"))
    return rows.agg(F.round(F.sum(F.col("line_count") * F.lit(1.3).cast("double") + F.col("complexity") * 10), 3).alias("est_tokens"), F.sum("complexity").alias("complexity"), F.bool_or(F.col("type") == "Service").alias("entry"))


@R.query("a09_module_metrics", on_graph("SELECT language, count(*) AS files, sum(line_count) AS lines, sum(complexity) AS complexity FROM nodes WHERE complexity <> 3 GROUP BY language"))
def a09(spark, sf_dir):
    """Sums per language without the files in error."""
    return model.nodes(spark, sf_dir).filter("complexity <> 3").groupBy("language").agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.sum("complexity").alias("complexity"))


@R.query("a12_reusable_components", on_graph("SELECT node_id, dependents FROM (SELECT dst AS node_id, count(*) AS dependents FROM edges GROUP BY dst ORDER BY 2 DESC, 1 LIMIT 5) WHERE dependents >= 2"))
def a12(spark, sf_dir):
    """The five nodes most depended on, then those with two dependents."""
    rows = model.graph(spark, sf_dir).edges.groupBy(F.col("dst").alias("node_id")).agg(F.count("*").alias("dependents"))
    return rows.orderBy(F.desc("dependents"), "node_id").limit(5).filter("dependents >= 2")


@R.query("a13_entry_points_grouped", "SELECT event_type AS type, event_id, count(*) OVER (PARTITION BY event_type) AS n FROM events")
def a13(spark, sf_dir):
    """Entry points, each with its type and how many there are of it: no list per type is built."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("type"), "event_id")
    return rows.join(rows.groupBy("type").agg(F.count("*").alias("n")), "type").select("type", "event_id", "n")


@R.query("a14_cross_module_references", "SELECT l_suppkey AS source, l_partkey AS target, count(*) AS n, string_agg(l_linenumber::VARCHAR, ',' ORDER BY l_linenumber) AS lines FROM lineitem GROUP BY 1, 2")
def a14(spark, sf_dir):
    """References grouped by their two ends."""
    rows = table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("source"), F.col("l_partkey").alias("target"))
    return rows.agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("l_linenumber")).cast("array<string>"), ",").alias("lines"))


def _files(spark, sf_dir):
    rows = model.nodes(spark, sf_dir)
    return rows.select("node_id", "complexity", (F.col("complexity") % 9).alias("nesting"), (F.col("line_count") * 2).alias("lines"), (F.col("line_count") % 30).alias("functions"), "language")


_FILES = "f AS (SELECT node_id, complexity, complexity % 9 AS nesting, line_count * 2 AS lines, line_count % 30 AS functions, language FROM nodes)"


@R.query("a15_file_complexity", on_graph("""SELECT node_id, s AS score, len(r) AS reasons, s > 15 OR len(r) >= 2 AS delegate FROM (SELECT node_id,
  CASE WHEN complexity > 10 THEN complexity ELSE 0 END + CASE WHEN nesting > 5 THEN nesting * 2 ELSE 0 END + CASE WHEN lines > 200 THEN lines // 50 ELSE 0 END + CASE WHEN functions > 20 THEN functions ELSE 0 END AS s,
  list_filter([complexity > 10, nesting > 5, lines > 200, functions > 20], lambda x: x) AS r FROM f)""", _FILES))
def a15(spark, sf_dir):
    """Which files are too complex, and why."""
    return quality.file_complexity(_files(spark, sf_dir)).select("node_id", F.col("score").cast("long").alias("score"), F.size("reasons").alias("reasons"), "delegate")


@R.query("a16_maintainability", on_graph("SELECT node_id, round(greatest(0, 171 - 5.2 * ln(lines) - 0.23 * complexity - 16.2 * ln(lines)), 2) AS maintainability FROM f", _FILES))
def a16(spark, sf_dir):
    """Maintainability from lines and complexity."""
    return _files(spark, sf_dir).select("node_id", quality.maintainability(F.col("lines"), F.col("complexity")).alias("maintainability"))


@R.query("a17_semantic_complexity", on_graph("SELECT node_id, round(complexity * (1 + functions / 10.0::DOUBLE), 2) AS value FROM f", _FILES))
def a17(spark, sf_dir):
    """Complexity weighted by diversity."""
    return _files(spark, sf_dir).select("node_id", quality.semantic_complexity(F.col("complexity"), F.col("functions")).alias("value"))


@R.query("a18_technical_debt", on_graph("""SELECT node_id, CASE WHEN complexity > 20 THEN complexity * 2 ELSE 0 END + CASE WHEN nesting > 6 THEN nesting * 3 ELSE 0 END + CASE WHEN lines > 500 THEN lines // 100 * 4 ELSE 0 END AS hours,
  concat_ws(',', CASE WHEN complexity > 10 THEN 'refactoring' END, CASE WHEN nesting > 4 THEN 'structure' END, CASE WHEN functions > 15 THEN 'organization' END) AS advice FROM f""", _FILES))
def a18(spark, sf_dir):
    """Hours of debt, and what is advised."""
    hours = F.aggregate(quality.debt(), F.lit(0).cast("long"), lambda n, x: n + x["hours"])
    return _files(spark, sf_dir).select("node_id", hours.alias("hours"), F.array_join(quality.recommended(), ",").alias("advice"))


@R.query("a19_dependency_weight", on_graph("SELECT e.src, e.dst, round(CASE WHEN a.language = b.language THEN 1.5 ELSE 1.0 END * least(1 + (a.complexity % 30) * 0.1, 3.0), 2)::DOUBLE AS weight FROM edges e JOIN nodes a ON a.node_id = e.src JOIN nodes b ON b.node_id = e.dst"))
def a19(spark, sf_dir):
    """Weight of an edge by language and imports."""
    g = model.graph(spark, sf_dir)
    a = g.nodes.select(F.col("node_id").alias("src"), F.col("language").alias("la"), F.col("complexity").alias("k"))
    b = g.nodes.select(F.col("node_id").alias("dst"), F.col("language").alias("lb"))
    rows = g.edges.join(a, "src").join(b, "dst")
    return rows.select("src", "dst", quality.dependency_weight(F.col("la") == F.col("lb"), F.col("k") % 30).cast("double").alias("weight"))


@R.query("a20_coverage", "SELECT (SELECT count(*) FROM documents) AS components, count(DISTINCT doc_id) AS documented, round(count(DISTINCT doc_id) / (SELECT count(*) FROM documents)::DOUBLE * 100, 6) AS component_coverage FROM labels")
def a20(spark, sf_dir):
    """Documented components in percent."""
    pages = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"))
    parts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("id"), F.lit("Class").alias("type"))
    return quality.coverage(pages, parts).select("components", "documented", F.round("component_coverage", 6).alias("component_coverage"))


@R.query("a21_readability", f"SELECT doc_id AS page_id, ({_READ})::DOUBLE AS score, {_W} AS words FROM documents")
def a21(spark, sf_dir):
    """Readability of each page."""
    rows = model.pages(spark, sf_dir)
    return rows.select("page_id", prose.readability(F.col("content")).alias("score"), prose.word_count(F.col("content")).alias("words"))


@R.query("a22_completeness", f"SELECT avg(contains(text, '```')::INT) * 100 AS example_coverage, round(avg(contains(lower(text), 'param')::INT) * 100, 6) AS parameter_documentation, round(avg(CASE WHEN trim(text) = '' THEN 0 ELSE least(100, {_W} / 10.0::DOUBLE) END), 6) AS description_completeness FROM documents")
def a22(spark, sf_dir):
    """Examples, parameters and descriptions."""
    rows = quality.completeness(model.pages(spark, sf_dir))
    return rows.select("example_coverage", F.round("parameter_documentation", 6).alias("parameter_documentation"), F.round("description_completeness", 6).alias("description_completeness"))


@R.query("a23_a24_overall_quality", f"""SELECT round(0.3 * c + 0.3 * r + 0.2 * d + 0.2 * 90, 6) AS overall, 90.0::DOUBLE AS consistency, 85.0::DOUBLE AS currency FROM
  (SELECT count(DISTINCT doc_id) / (SELECT count(*) FROM documents)::DOUBLE * 100 AS c FROM labels), (SELECT avg({_READ}) AS r, avg(least(100, {_W} / 10.0::DOUBLE)) AS d FROM documents)""")
def a24(spark, sf_dir):
    """The overall score with its fixed accuracy figures."""
    pages = model.pages(spark, sf_dir)
    c = quality.coverage(table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id")), pages.select(F.col("page_id").alias("id"), F.lit("Class").alias("type")))
    one = c.crossJoin(F.broadcast(quality.completeness(pages))).crossJoin(F.broadcast(pages.agg(F.avg(prose.readability(F.col("content"))).alias("r"))))
    value = quality.overall(F.col("component_coverage"), F.col("r"), F.col("description_completeness"), F.lit(quality.CONSISTENCY))
    return one.select(F.round(value, 6).alias("overall"), F.lit(quality.CONSISTENCY).alias("consistency"), F.lit(quality.CURRENCY).alias("currency"))


@R.query("a25_benchmark_comparison", "SELECT p_partkey, round(least(150, p_size / 75.0::DOUBLE * 300), 6) AS percent, CASE WHEN p_size * 4.0 >= 110 THEN 'Excellent' WHEN p_size * 4.0 >= 90 THEN 'Good' WHEN p_size * 4.0 >= 70 THEN 'Average' ELSE 'Poor' END AS status FROM part")
def a25(spark, sf_dir):
    """A figure against its target."""
    percent, status = quality.compared(F.col("p_size") * 3.0, F.lit(quality.TARGETS["ReadabilityScore"]))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(percent, 6).alias("percent"), status.alias("status"))


@R.query("a26_recommendations", "SELECT p_partkey, concat_ws(',', CASE WHEN p_size * 3 < 80 THEN 'Increase component documentation coverage' END, CASE WHEN p_size * 2 < 70 THEN 'Improve documentation readability and structure' END, CASE WHEN p_size < 50 THEN 'Add more code examples throughout documentation' END) AS advice FROM part")
def a26(spark, sf_dir):
    """What to do about low figures."""
    rows = table(spark, sf_dir, "part").select("p_partkey", (F.col("p_size") * 3).alias("component_coverage"), (F.col("p_size") * 2).alias("readability"), F.col("p_size").alias("example_coverage"), F.lit(90).alias("consistency"))
    return rows.select("p_partkey", F.array_join(quality.advice(), ",").alias("advice"))


def _requirements(spark, sf_dir):
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(
        F.col("l_suppkey").alias("parent_id"), F.col("l_quantity").alias("weight"), (F.col("l_discount") * 10).alias("score"), F.col("l_tax").alias("uncertainty"), (F.col("l_returnflag") == "R").alias("failed"),
        F.col("l_linestatus").alias("category"), F.col("l_linenumber").cast("string").alias("judge"), F.col("l_partkey").alias("requirement"),
    )


_REQ = "r AS (SELECT l_suppkey AS parent_id, l_quantity AS weight, l_discount * 10 AS score, l_tax AS uncertainty, l_returnflag = 'R' AS failed, l_linestatus AS category, l_linenumber::VARCHAR AS judge, l_partkey AS requirement FROM lineitem)"


@R.query("a27_a28_weighted_rubric", f"WITH {_REQ} SELECT parent_id, round(sum(weight * score) / sum(weight), 9) AS score, round(sqrt(sum(weight * weight * uncertainty * uncertainty)) / sum(weight), 9) AS uncertainty FROM r WHERE NOT failed GROUP BY 1")
def a27(spark, sf_dir):
    """Weighted mean one level up, with its uncertainty."""
    return quality.weighted(_requirements(spark, sf_dir)).select("parent_id", F.round("score", 9).alias("score"), F.round("uncertainty", 9).alias("uncertainty"))


@R.query("a27_single_judge_rubric", f"WITH {_REQ} SELECT parent_id, round(sum(weight * CASE WHEN failed THEN 0 ELSE score END) / sum(weight), 9) AS score FROM r GROUP BY 1")
def a27_single(spark, sf_dir):
    """The same where failed requirements count as 0."""
    return quality.weighted_single(_requirements(spark, sf_dir)).select("parent_id", F.round("score", 9).alias("score"))


#: A rubric of uneven depth over all parts; leaves have scores, some have failed.
_RUBRIC = """tree AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey > 0 THEN CASE WHEN p_partkey % 5 < 3 THEN p_partkey // 2 ELSE p_partkey // 7 END END AS parent_id, (p_size % 9)::DOUBLE AS weight FROM part),
  leaf AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey % 11 = 0 THEN NULL ELSE p_retailprice % 100 END::DOUBLE AS score, (p_size / 50.0)::DOUBLE AS u FROM part WHERE p_partkey NOT IN (SELECT parent_id FROM tree WHERE parent_id IS NOT NULL))"""


def _rubric_sql(single: bool) -> str:
    """Down from every node: the share of each leaf below it, and the squares of it."""
    score = "coalesce(score, 0)" if single else "score"
    return f"""WITH RECURSIVE {_RUBRIC}, l AS (SELECT node_id, {score} AS score, u FROM leaf),
      v AS (SELECT t.node_id, t.parent_id, t.weight FROM tree t LEFT JOIN l USING (node_id) WHERE t.parent_id IS NOT NULL AND (l.node_id IS NULL OR l.score IS NOT NULL)),
      share AS (SELECT node_id, parent_id, CASE WHEN sum(weight) OVER (PARTITION BY parent_id) > 0 THEN weight / sum(weight) OVER (PARTITION BY parent_id) ELSE 0 END AS w FROM v),
      w AS (SELECT node_id AS top, node_id, 1.0::DOUBLE AS f, 0 AS depth FROM tree UNION ALL SELECT top, s.node_id, f * s.w, depth + 1 FROM w JOIN share s ON s.parent_id = w.node_id),
      h AS (SELECT node_id AS top, node_id, 0 AS height FROM tree UNION ALL SELECT top, t.node_id, height + 1 FROM h JOIN tree t ON t.parent_id = h.node_id)
      SELECT tree.node_id, round(CASE WHEN tree.node_id IN (SELECT node_id FROM l WHERE score IS NULL) THEN NULL ELSE coalesce(sum(f * l.score), 0) END, 6) AS score, round(coalesce(sqrt(sum(f * f * l.u * l.u)), 0), 6) AS uncertainty, any_value(m.height) AS height
      FROM tree JOIN w ON w.top = tree.node_id LEFT JOIN l ON l.node_id = w.node_id JOIN (SELECT top, max(height) AS height FROM h GROUP BY top) m ON m.top = tree.node_id GROUP BY tree.node_id"""


def _rubric(spark, sf_dir, one_judge):
    k = F.col("p_partkey")
    parent = F.when(k > 0, F.when(k % 5 < 3, F.floor(k / 2)).otherwise(F.floor(k / 7)))
    rows = table(spark, sf_dir, "part")
    tree = rows.select(k.alias("node_id"), parent.alias("parent_id"), (F.col("p_size") % 9).alias("weight"))
    scores = rows.select(k.alias("node_id"), (F.col("p_retailprice") % 100).cast("double").alias("score"), (F.col("p_size") / 50.0).alias("uncertainty"), (k % 11 == 0).alias("failed"))
    found = trees.rolled_up(tree, scores, one_judge)
    return found.select("node_id", F.round("score", 6).alias("score"), F.round("uncertainty", 6).alias("uncertainty"), "height")


@R.query("a27_a28_rubric_tree", _rubric_sql(False))
def a27_tree(spark, sf_dir):
    """Scores and uncertainties of every node of a rubric, failed leaves left out."""
    return _rubric(spark, sf_dir, False)


@R.query("a27_single_judge_tree", _rubric_sql(True))
def a27_single_tree(spark, sf_dir):
    """The same for one judge, failed leaves counting as 0."""
    return _rubric(spark, sf_dir, True)


@R.query("a29_reliability", f"WITH {_REQ} SELECT parent_id, round(avg(x), 9) AS reliability FROM (SELECT parent_id, CASE WHEN max(score) > min(score) THEN 1 - stddev_pop(score) / (max(score) - min(score)) ELSE 1 END AS x FROM r GROUP BY parent_id, category) GROUP BY 1")
def a29(spark, sf_dir):
    """Reliability over categories."""
    return quality.reliability(_requirements(spark, sf_dir), "parent_id").select("parent_id", F.round("reliability", 9).alias("reliability"))


_JUDGED = f"""j AS (SELECT doc_id, quality * 100.0::DOUBLE AS score, 0.9::DOUBLE AS reliability FROM labels UNION ALL SELECT doc_id, (1 - toxic) * 100.0, 0.8 FROM labels
  UNION ALL SELECT doc_id, ({_READ})::DOUBLE, 0.7 FROM documents JOIN labels USING (doc_id))"""


def _judged(spark, sf_dir):
    labels = table(spark, sf_dir, "labels")
    rows = labels.select("doc_id", (F.col("quality") * 100.0).alias("score"), F.lit(0.9).alias("reliability"))
    rows = rows.unionByName(labels.select("doc_id", ((1 - F.col("toxic")) * 100.0).alias("score"), F.lit(0.8).alias("reliability")))
    pages = table(spark, sf_dir, "documents").join(labels.select("doc_id"), "doc_id")
    return rows.unionByName(pages.select("doc_id", prose.readability(F.col("text")).alias("score"), F.lit(0.7).alias("reliability")))


@R.query("a30_a31_judge_consensus", f"""WITH {_JUDGED} SELECT doc_id, round(sum(score * reliability) / sum(reliability), 9) AS score, round(CASE WHEN max(score) > min(score) THEN greatest(0, 1 - stddev_pop(score) / (max(score) - min(score))) ELSE 1 END * avg(reliability), 9) AS confidence,
  round(stddev_pop(score), 9) AS uncertainty, CASE WHEN count(*) < 3 THEN 'Insufficient Judges (Minimum 3 Required)' WHEN max(score) - min(score) <= 10 THEN 'Strong Consensus' WHEN max(score) - min(score) <= 25 THEN 'Moderate Consensus' ELSE 'Low Consensus' END AS status FROM j GROUP BY doc_id""")
def a30(spark, sf_dir):
    """Reliability-weighted consensus of three judges."""
    rows = quality.consensus(_judged(spark, sf_dir), "doc_id")
    return rows.select("doc_id", *[F.round(c, 9).alias(c) for c in ("score", "confidence", "uncertainty")], "status")


@R.query("a32_requirement_spread", f"WITH {_REQ} SELECT requirement, round(stddev_pop(score), 9) AS deviation, round(avg(score), 9) AS mean FROM r GROUP BY 1")
def a32(spark, sf_dir):
    """Deviation and mean of each requirement."""
    return quality.spread(_requirements(spark, sf_dir), "requirement").select("requirement", F.round("deviation", 9).alias("deviation"), F.round("mean", 9).alias("mean"))


@R.query("a33_assessment", f"WITH {_REQ} SELECT requirement, round(greatest(0, least(1, avg(score))), 9) AS score, round(stddev_pop(score), 9) AS deviation, string_agg(judge, ',' ORDER BY judge) AS judges FROM r GROUP BY 1")
def a33(spark, sf_dir):
    """Clamped mean, deviation and the judges."""
    rows = quality.assessment(_requirements(spark, sf_dir), "requirement")
    return rows.select("requirement", F.round("score", 9).alias("score"), F.round("deviation", 9).alias("deviation"), F.array_join("judges", ",").alias("judges"))


@R.query("a34_distinct_requirements", "SELECT trim(translate(lower(p_name), '.,;', '')) AS key, arg_min(p_name, p_partkey) AS text, min(p_partkey) AS seq FROM part GROUP BY 1")
def a34(spark, sf_dir):
    """The first requirement of each normalised text."""
    return quality.distinct_requirements(table(spark, sf_dir, "part").select(F.col("p_name").alias("text"), F.col("p_partkey").alias("seq")))


@R.query("a35_rubric_categories", "SELECT CASE WHEN regexp_matches(lower(p_name), 'example|code|sample') THEN 'Code Examples' WHEN regexp_matches(lower(p_name), 'api|endpoint|method') THEN 'API Coverage' WHEN regexp_matches(lower(p_name), 'structure|organization|format') THEN 'Structure & Organization' ELSE 'Documentation Quality' END AS category, 0.25::DOUBLE AS weight, count(*) AS n FROM part GROUP BY 1")
def a35(spark, sf_dir):
    """Requirements regrouped into weighted categories."""
    return quality.rubric(table(spark, sf_dir, "part").select(F.col("p_name").alias("text")))


@R.query("a36_rubric_leaves", "SELECT count(*) AS leaves FROM part WHERE p_partkey NOT IN (SELECT p_partkey // 2 FROM part WHERE p_partkey > 0)")
def a36(spark, sf_dir):
    """Leaves of a rubric tree."""
    from ..operators.traverse import leaves

    k = F.col("p_partkey")
    tree = table(spark, sf_dir, "part").select(k.alias("node_id"), F.when(k > 0, F.floor(k / 2)).alias("parent_id"))
    return leaves(tree).agg(F.count("*").alias("leaves"))


@R.query("a39_estimated_lines", on_graph("SELECT sum(complexity) * 10 AS lines FROM nodes WHERE node_id NOT IN (SELECT src FROM adjacency)"))
def a39(spark, sf_dir):
    """Ten lines for each point of leaf complexity."""
    g = model.graph(spark, sf_dir)
    return g.nodes.join(g.adjacency.select(F.col("src").alias("node_id")), "node_id", "left_anti").agg((F.sum("complexity") * 10).alias("lines"))


@R.query("a41_evaluation_telemetry", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most, round(stddev_pop(value), 6) AS deviation FROM events GROUP BY 1")
def a41(spark, sf_dir):
    """Counters and spread of values by tag."""
    rows = table(spark, sf_dir, "events").groupBy("event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.max("value"), 6).alias("most"), F.round(F.stddev_pop("value"), 6).alias("deviation"))


@R.query("a42_agent_delegates", on_graph("SELECT node_id FROM nodes WHERE complexity > 8 OR line_count > 500"))
def a42(spark, sf_dir):
    """What an agent hands on: complex or long."""
    return model.nodes(spark, sf_dir).filter("complexity > 8 or line_count > 500").select("node_id")


@R.query("a43_tree_statistics", "SELECT count(*) AS modules, count(*) FILTER (leaf) AS leaves, sum(p_size) FILTER (leaf) AS tokens, round(avg(p_size) FILTER (leaf), 9) AS mean FROM (SELECT p_size, p_partkey NOT IN (SELECT p_partkey // 2 FROM part WHERE p_partkey > 0) AS leaf FROM part)")
def a43(spark, sf_dir):
    """Modules, leaves and the tokens of leaves."""
    rows, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    inner = rows.filter(k > 0).select(F.floor(k / 2).alias("p_partkey"), F.lit(True).alias("inner")).distinct()
    rows = rows.join(inner, "p_partkey", "left")
    leaf = F.when(F.col("inner").isNull(), F.col("p_size"))
    return rows.agg(F.count("*").alias("modules"), F.count(leaf).alias("leaves"), F.sum(leaf).alias("tokens"), F.round(F.avg(leaf), 9).alias("mean"))


@R.query("a44_relevant_files", "SELECT lang, string_agg(source, ',' ORDER BY source) AS files FROM (SELECT DISTINCT lang, source FROM documents) GROUP BY lang")
def a44(spark, sf_dir):
    """The distinct files below each parent."""
    return table(spark, sf_dir, "documents").groupBy("lang").agg(F.array_join(F.array_sort(F.collect_set("source")), ",").alias("files"))


_M = "m AS (SELECT split_part(node_id, '::', 1) AS community, node_id FROM nodes)"


def _members(g):
    return g.nodes.select("node_id", F.split_part(F.col("node_id"), F.lit("::"), F.lit(1)).alias("community"))


@R.query("g26_cluster_names", on_graph("SELECT community, CASE community WHEN 'region' THEN 'regions' WHEN 'nation' THEN 'Domain' WHEN 'customer' THEN 'Infrastructure' WHEN 'supplier' THEN 'Application' ELSE 'parts' END AS name FROM m GROUP BY community", _M))
def g26(spark, sf_dir):
    """Names of clusters by directory, layer or common path."""
    g = model.graph(spark, sf_dir)
    return architecture.cluster_names(g, _members(g))


@R.query("g27_hierarchy_modules", on_graph("SELECT community AS module_id, count(*) AS members, 1 AS level, sum(complexity) AS complexity FROM m JOIN nodes USING (node_id) GROUP BY 1", _M))
def g27(spark, sf_dir):
    """A level-one module for each cluster."""
    g = model.graph(spark, sf_dir)
    return _members(g).join(g.nodes, "node_id").groupBy(F.col("community").alias("module_id")).agg(F.count("*").alias("members"), F.lit(1).alias("level"), F.sum("complexity").alias("complexity"))


#: Greedy packing of rows t (community, node_id, est_tokens) in order of id.
PACKED = """r AS (SELECT *, row_number() OVER (PARTITION BY community ORDER BY node_id) AS i FROM t),
  f AS (SELECT community, i, 0 AS part, est_tokens AS size FROM r WHERE i = 1 UNION ALL SELECT r.community, r.i, part + (size > 0 AND size + est_tokens > 32768)::INT,
    CASE WHEN size > 0 AND size + est_tokens > 32768 THEN est_tokens ELSE size + est_tokens END FROM f JOIN r ON r.community = f.community AND r.i = f.i + 1)"""
_TOKENS = "line_count * 1.3::DOUBLE + complexity * 10"


@R.query("g30_size_packing", on_graph("SELECT community, node_id, part FROM f JOIN r USING (community, i)", _M, f"t AS (SELECT community, node_id, {_TOKENS} AS est_tokens FROM m JOIN nodes USING (node_id))", PACKED))
def g30(spark, sf_dir):
    """Greedy packing of a module's nodes by tokens."""
    g = model.graph(spark, sf_dir)
    rows = _members(g).join(g.nodes, "node_id").select("community", "node_id", (F.col("line_count") * 1.3 + F.col("complexity") * 10).cast("double").alias("est_tokens"))
    return architecture.packed(rows, 32768)


@R.query("g29_merged_siblings", """WITH RECURSIVE r AS (SELECT p_brand AS parent_id, p_partkey::VARCHAR AS module_id, p_size * 130.0::DOUBLE AS t, p_partkey % 5 <> 0 AND p_size * 130.0 < 4000 AS small, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey::VARCHAR) AS i FROM part),
  f AS (SELECT parent_id, 0::BIGINT AS i, NULL::VARCHAR AS head, 0.0::DOUBLE AS size, NULL::VARCHAR AS into_ FROM r WHERE i = 1 UNION ALL SELECT parent_id, i, CASE WHEN new_ THEN module_id ELSE head END, CASE WHEN NOT small THEN size WHEN new_ THEN t ELSE size + t END,
    CASE WHEN NOT small OR new_ THEN module_id ELSE head END FROM (SELECT r.parent_id, r.i, r.module_id, r.t, r.small, f.head, f.size, r.small AND (f.head IS NULL OR f.size + r.t >= 32768) AS new_ FROM f JOIN r ON r.parent_id = f.parent_id AND r.i = f.i + 1))
  SELECT parent_id, module_id, into_ AS merged_into FROM f JOIN r USING (parent_id, i)""")
def g29(spark, sf_dir):
    """Small sibling modules merged up to the token limit."""
    rows = table(spark, sf_dir, "part").select(F.col("p_brand").alias("parent_id"), F.col("p_partkey").cast("string").alias("module_id"), (F.col("p_size") * 130.0).cast("double").alias("est_tokens"), (F.col("p_partkey") % 5 != 0).alias("is_leaf"))
    return architecture.merge_siblings(rows)


@R.query("g31_tree_in_graph", on_graph("SELECT 'module::' || community AS src, node_id AS dst, 'Contains' AS type FROM m UNION ALL SELECT node_id, 'module::' || community, 'ChildOf' FROM m", _M))
def g31(spark, sf_dir):
    """Module nodes joined to the graph by Contains and ChildOf."""
    rows = _members(model.graph(spark, sf_dir)).select(F.concat(F.lit("module::"), "community").alias("m"), "node_id")
    down = rows.select(F.col("m").alias("src"), F.col("node_id").alias("dst"), F.lit("Contains").alias("type"))
    return down.unionByName(rows.select(F.col("node_id").alias("src"), F.col("m").alias("dst"), F.lit("ChildOf").alias("type")))


@R.query("g32_delegation_decision", on_graph("""SELECT node_id, CASE WHEN complexity % 5 >= 3 THEN 'max_depth' WHEN line_count % 7 <= 1 THEN 'none' WHEN line_count * 200 > 32768 THEN 'token_limit' WHEN complexity * 6 > 100 THEN 'complexity'
  WHEN (complexity % 10) / 10.0 > 0.6 AND line_count % 7 >= 4 THEN 'semantic_diversity' ELSE 'none' END AS decision FROM nodes"""))
def g32(spark, sf_dir):
    """The first reason to split a module."""
    c, n = F.col("complexity"), F.col("line_count")
    rows = model.nodes(spark, sf_dir).select("node_id", (n % 7).alias("n"), (c % 5).alias("depth"), (n * 200).alias("est_tokens"), (c * 6).alias("complexity"), ((c % 10) / 10.0).alias("diversity"))
    return architecture.delegation(rows).select("node_id", "decision")


@R.query("g33_delegation_thirds", on_graph("SELECT community, node_id, ((row_number() OVER (PARTITION BY community ORDER BY node_id) - 1) // greatest(2, count(*) OVER (PARTITION BY community) // 3))::INT AS part FROM m", _M))
def g33(spark, sf_dir):
    """A module split into thirds by id."""
    g = model.graph(spark, sf_dir)
    return architecture.thirds(_members(g)).select("community", "node_id", "part")


@R.query("g39_layers_by_path", "SELECT 'presentation' AS layer, page_id FROM pages WHERE page_id % 10 = 0 UNION ALL SELECT 'business', page_id FROM pages WHERE contains(lower(url), 'service') OR contains(lower(url), 'th') UNION ALL SELECT 'data', page_id FROM pages WHERE contains(lower(url), 'model') OR contains(lower(url), 'en')")
def g39(spark, sf_dir):
    """Layers by substrings of the path; a file may lie in several."""
    rows, url = table(spark, sf_dir, "pages"), F.lower("url")
    parts = [("presentation", F.col("page_id") % 10 == 0), ("business", url.contains("service") | url.contains("th")), ("data", url.contains("model") | url.contains("en"))]
    layers = F.filter(F.array(*[F.when(t, n) for n, t in parts]), lambda x: x.isNotNull())
    return rows.select(F.explode(layers).alias("layer"), "page_id")


@R.query("a34_first_by_seq", "SELECT p_brand, arg_min(p_name, p_partkey) AS first FROM part GROUP BY 1")
def first_by_seq(spark, sf_dir):
    """First occurrence by ingest order, through a window."""
    w = Window.partitionBy("p_brand").orderBy("p_partkey")
    return table(spark, sf_dir, "part").withColumn("nth", F.row_number().over(w)).filter("nth = 1").select("p_brand", F.col("p_name").alias("first"))

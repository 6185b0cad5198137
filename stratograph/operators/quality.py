"""Documentation quality: coverage, readability, judges and their consensus."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import prose

#: Targets that figures are compared with.
TARGETS = {"ComponentCoverage": 85.0, "ApiCoverage": 90.0, "ReadabilityScore": 75.0, "ExampleCoverage": 60.0}
#: Scores that are not worked out from the pages.
CONSISTENCY, CURRENCY = 90.0, 85.0
#: Thresholds below which a recommendation is made.
ADVICE = (
    ("component_coverage", 80, "Increase component documentation coverage"),
    ("readability", 70, "Improve documentation readability and structure"),
    ("example_coverage", 50, "Add more code examples throughout documentation"),
    ("consistency", 85, "Ensure consistency in terminology and descriptions"),
)


def coverage(pages: DataFrame, components: DataFrame) -> DataFrame:
    """One row.  The numerator is every distinct page id, so coverage can exceed 100."""
    ids = pages.select("page_id").distinct()
    p = ids.agg(F.count("*").alias("documented"))
    api = F.lower("type").isin("controller", "service", "api")
    flagged = components.join(ids.withColumn("has", F.lit(True)), F.col("id") == F.col("page_id"), "left")
    c = flagged.agg(
        F.count("*").alias("components"), F.count_if(api).alias("apis"), F.count_if(api & F.col("has")).alias("documented_apis"), F.count_if(F.col("has").isNull()).alias("undocumented")
    )
    one = c.crossJoin(F.broadcast(p))
    share = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b) * 100).otherwise(0.0)
    return one.select("components", "documented", "undocumented", share("documented", "components").alias("component_coverage"), share("documented_apis", "apis").alias("api_coverage"))


def completeness(pages: DataFrame) -> DataFrame:
    t, words = F.col("content"), prose.word_count(F.col("content"))
    described = F.when(F.trim(t) == "", 0.0).otherwise(F.least(F.lit(100.0), words / 10))
    return pages.agg(
        (F.avg(F.when(t.contains("```"), 1).otherwise(0)) * 100).alias("example_coverage"),
        (F.avg(F.when(F.lower(t).contains("param"), 1).otherwise(0)) * 100).alias("parameter_documentation"),
        F.avg(described).alias("description_completeness"),
    )


def overall(component_coverage: Column, readability: Column, description: Column, consistency: Column) -> Column:
    return component_coverage * 0.3 + readability * 0.3 + description * 0.2 + consistency * 0.2


def compared(value: Column, target: Column) -> tuple[Column, Column]:
    """(percent of the target, 150 at most; status)."""
    percent = value / target * 100
    status = F.when(percent >= 110, "Excellent").when(percent >= 90, "Good").when(percent >= 70, "Average").otherwise("Poor")
    return F.least(percent, F.lit(150.0)), status


def advice() -> Column:
    return F.filter(F.array(*[F.when(F.col(c) < limit, text) for c, limit, text in ADVICE]), lambda x: x.isNotNull())


def weighted(children: DataFrame, parent: str = "parent_id") -> DataFrame:
    """Scores one level up: sum(w s) / sum(w) and sqrt(sum(w^2 u^2)) / sum(w), failed ones left out."""
    ok = children.filter("not failed")
    w = F.sum("weight")
    return ok.groupBy(parent).agg(
        F.when(w > 0, F.sum(F.col("weight") * F.col("score")) / w).otherwise(0.0).alias("score"),
        F.when(w > 0, F.sqrt(F.sum(F.col("weight") * F.col("weight") * F.col("uncertainty") * F.col("uncertainty"))) / w).otherwise(0.0).alias("uncertainty"),
    )


def weighted_single(children: DataFrame, parent: str = "parent_id") -> DataFrame:
    """The same for one judge: failed requirements count as 0."""
    zero = F.when(F.col("failed"), 0.0).otherwise(F.col("score"))
    return children.groupBy(parent).agg((F.sum(F.col("weight") * zero) / F.sum("weight")).alias("score"))


def reliability(scores: DataFrame, *keys: str) -> DataFrame:
    """Mean over categories of 1 - deviation / range (1 without range)."""
    spread = F.max("score") - F.min("score")
    per = scores.groupBy(*keys, "category").agg(F.when(spread > 0, 1 - F.stddev_pop("score") / spread).otherwise(1.0).alias("r"))
    return per.groupBy(*keys).agg(F.avg("r").alias("reliability"))


def consensus(judged: DataFrame, key: str) -> DataFrame:
    """Per page of rows (key, score, reliability): weighted mean, agreement and status."""
    spread = F.max("score") - F.min("score")
    agreed = F.when((spread > 0) & (F.count("*") > 1), F.greatest(F.lit(0.0), 1 - F.stddev_pop("score") / spread)).otherwise(1.0)
    status = F.when(F.count("*") < 3, "Insufficient Judges (Minimum 3 Required)").when(spread <= 10, "Strong Consensus").when(spread <= 25, "Moderate Consensus").otherwise("Low Consensus")
    return judged.groupBy(key).agg(
        (F.sum(F.col("score") * F.col("reliability")) / F.sum("reliability")).alias("score"),
        (agreed * F.avg("reliability")).alias("confidence"),
        F.stddev_pop("score").alias("uncertainty"),
        status.alias("status"),
    )


def spread(scores: DataFrame, *keys: str) -> DataFrame:
    """Population deviation and mean of a requirement over judges."""
    return scores.groupBy(*keys).agg(F.stddev_pop("score").alias("deviation"), F.avg("score").alias("mean"))


def assessment(scores: DataFrame, key: str) -> DataFrame:
    return scores.groupBy(key).agg(F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.avg("score"))).alias("score"), F.stddev_pop("score").alias("deviation"), F.array_sort(F.collect_list("judge")).alias("judges"))


def distinct_requirements(rows: DataFrame) -> DataFrame:
    """The first (by seq) requirement of each normalised text."""
    return rows.withColumn("key", prose.requirement_key(F.col("text"))).groupBy("key").agg(F.min_by("text", "seq").alias("text"), F.min("seq").alias("seq"))


def rubric(rows: DataFrame, weight: float = 0.25) -> DataFrame:
    """(category, weight, n): categories that have any requirement, equally weighted."""
    return rows.groupBy(prose.requirement_category(F.col("text")).alias("category")).agg(F.lit(weight).alias("weight"), F.count("*").alias("n"))


#: Limits of a file's complexity, nesting, lines and functions.
LIMITS = {"complexity": 10, "nesting": 5, "lines": 200, "functions": 20}


def file_complexity(rows: DataFrame) -> DataFrame:
    """rows (complexity, nesting, lines, functions) with score, reasons and delegate."""
    parts = (("complexity", F.col("complexity")), ("nesting", F.col("nesting") * 2), ("lines", F.floor(F.col("lines") / 50)), ("functions", F.col("functions")))
    over = [F.col(k) > LIMITS[k] for k, _ in parts]
    score = sum((F.when(o, v).otherwise(0) for o, (_, v) in zip(over, parts)), F.lit(0))
    reasons = F.filter(F.array(*[F.when(o, k) for o, (k, _) in zip(over, parts)]), lambda x: x.isNotNull())
    return rows.withColumn("score", score).withColumn("reasons", reasons).withColumn("delegate", (F.col("score") > 15) | (F.size("reasons") >= 2))


def maintainability(lines: Column, complexity: Column) -> Column:
    return F.round(F.greatest(F.lit(0.0), 171 - 5.2 * F.log(lines) - 0.23 * complexity - 16.2 * F.log(lines)), 2)


def semantic_complexity(complexity: Column, diversity: Column) -> Column:
    return F.round(complexity * (1 + diversity / 10), 2)


def debt() -> Column:
    """Hours of each kind of debt of a row (complexity, nesting, lines), as a list."""
    kinds = [
        F.when(F.col("complexity") > 20, F.struct(F.lit("complexity").alias("type"), F.lit("high").alias("severity"), (F.col("complexity") * 2).cast("long").alias("hours"))),
        F.when(F.col("nesting") > 6, F.struct(F.lit("nesting").alias("type"), F.lit("medium").alias("severity"), (F.col("nesting") * 3).cast("long").alias("hours"))),
        F.when(F.col("lines") > 500, F.struct(F.lit("size").alias("type"), F.lit("medium").alias("severity"), (F.floor(F.col("lines") / 100) * 4).cast("long").alias("hours"))),
    ]
    return F.filter(F.array(*kinds), lambda x: x.isNotNull())


def recommended() -> Column:
    kinds = [F.when(F.col("complexity") > 10, "refactoring"), F.when(F.col("nesting") > 4, "structure"), F.when(F.col("functions") > 15, "organization")]
    return F.filter(F.array(*kinds), lambda x: x.isNotNull())


def dependency_weight(same_language: Column, imports: Column) -> Column:
    return F.round(F.when(same_language, 1.5).otherwise(1.0) * F.least(1 + imports * 0.1, F.lit(3.0)), 2)

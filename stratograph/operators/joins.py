"""Joins: names to components, files and sections; build steps of the graph."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut
from .lookup import contained, first_match


def stem(path: Column) -> Column:
    return F.regexp_replace(F.element_at(F.split(path, r"[/\\]"), -1), r"\.[^.]+$", "")


def resolve_dependencies(wanted: DataFrame, components: DataFrame) -> DataFrame:
    """(src, dst, type): each wanted (src, dependency, language) to the first component (in
    order of seq) of that name or file stem, whatever the case; CrossBoundary across languages.

    The either-or predicate becomes two equi-joins of one exploded key."""
    keys = components.select("id", "seq", F.col("language").alias("to"), F.explode(F.array_distinct(F.array(F.lower("name"), F.lower(stem(F.col("file_path")))))).alias("key"))
    first = keys.groupBy("key").agg(F.min_by(F.struct("id", "to"), "seq").alias("t"))
    rows = wanted.join(first, F.lower("dependency") == F.col("key"))
    kind = F.when(F.lower("language") == F.lower("t.to"), "Dependency").otherwise("CrossBoundary")
    return rows.select("src", F.col("t.id").alias("dst"), kind.alias("type"))


def import_to_file(imports: DataFrame, files: DataFrame) -> DataFrame:
    """(source, dependency, target): the first file (by path) whose normalised stem contains
    the import's or lies in it, whatever their length."""
    a = imports.withColumn("dep", F.regexp_replace(F.lower("dependency"), "[^a-z0-9]", ""))
    b = files.select(F.col("path").alias("target"), F.lower(stem(F.col("path"))).alias("stem")).groupBy("stem").agg(F.min("target").alias("target"))
    deps, stems = a.select(F.col("dep").alias("s")), b.select(F.col("stem").alias("l"))
    inside = contained(deps, stems).select(F.col("s").alias("dep"), F.col("l").alias("stem"))
    around = contained(stems.withColumnRenamed("l", "s"), deps.withColumnRenamed("s", "l")).select(F.col("l").alias("dep"), F.col("s").alias("stem"))
    first = inside.unionByName(around).join(b, "stem").groupBy("dep").agg(F.min("target").alias("target"))
    return a.join(first, "dep").select("source", "dependency", "target").distinct()


def documented(pages: DataFrame, components: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(undocumented components, documented ones) by id."""
    ids = pages.select(F.col("page_id").alias("id")).distinct()
    return components.join(ids, "id", "left_anti"), components.join(ids, "id", "left_semi")


def service_connectivity(services: DataFrame, arcs: DataFrame) -> DataFrame:
    """One row (services, links, connectivity): distinct ordered pairs of services with an arc."""
    a, b = services.select(F.col("node_id").alias("src")), services.select(F.col("node_id").alias("dst"))
    links = arcs.join(a, "src", "left_semi").join(b, "dst", "left_semi").filter("src <> dst").select("src", "dst").distinct().agg(F.count("*").alias("links"))
    n = services.agg(F.count("*").alias("services"))
    k = F.col("services")
    return n.crossJoin(F.broadcast(links)).withColumn("connectivity", F.when(k > 1, F.col("links") / (k * (k - 1))).otherwise(0.0))


def module_sections(sections: DataFrame) -> DataFrame:
    """(module_id, section_id): the first section (by seq) that lists a module; blank ids drop."""
    rows = sections.select("section_id", "seq", F.explode("module_ids").alias("module_id")).filter("trim(module_id) <> ''")
    return first_match(rows, "module_id", "seq").select("module_id", "section_id")


def summaries(repositories: DataFrame, structures: DataFrame) -> DataFrame:
    """Repositories with whether a structure exists and its title."""
    rows = repositories.join(structures, "repo_id", "left")
    return rows.select("repo_id", "url", F.when(F.col("title").isNull(), "(none)").otherwise(F.col("title")).alias("title"), F.col("title").isNotNull().alias("has_structure"))


def numbered(keys: DataFrame, known: DataFrame, key: str) -> DataFrame:
    """Ids of keys: known ones keep theirs, new ones follow the greatest in order of key.

    New keys are numbered within ranges of keys, and the ranges' sizes give the offsets."""
    new = keys.select(key).distinct().join(known, key, "left_anti")
    new = cut(new.repartitionByRange(key).select(key, F.spark_partition_id().alias("part")), "new-keys")
    top = known.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = new.groupBy("part").agg(F.count("*").alias("n"))  # one row a range
    starts = sizes.select("part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")).crossJoin(F.broadcast(top))
    n = F.row_number().over(Window.partitionBy("part").orderBy(key))
    new = new.withColumn("n", n).join(F.broadcast(starts), "part")
    return known.select(key, "id").unionByName(new.select(key, (F.col("top") + F.col("start") + F.col("n")).cast("long").alias("id")))

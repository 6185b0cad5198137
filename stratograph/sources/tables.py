"""Readers: Parquet tables, source trees, JSON graph indexes; and the scratch folder."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: File name extensions of source code.
CODE_EXTENSIONS = ("cs", "js", "ts", "py", "java", "cpp", "cc", "c", "h", "hpp")

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def source_files(spark: SparkSession, root: str, extensions: tuple[str, ...] = CODE_EXTENSIONS) -> DataFrame:
    """(path, modified_at, length, content) of all files below root with a wanted extension."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    wanted = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1)).isin(*extensions)
    return rows.filter(wanted).select(
        "path", F.col("modificationTime").alias("modified_at"), "length", F.col("content").cast("string").alias("content")
    )


def markdown_context(spark: SparkSession, root: str, most_bytes: int = 20000) -> DataFrame:
    """Markdown files of at most ``most_bytes`` bytes."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").load(root)
    return rows.filter(F.col("length") <= most_bytes).select("path", F.col("content").cast("string").alias("content"))


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in ``spark.checkpoint.dir``, or where that is unset in the warehouse, which all executors share too."""
    top = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return f"{top.rstrip('/')}/{what}-{uuid.uuid4().hex}"


def cut(df: DataFrame, what: str = "round") -> DataFrame:
    """``df`` as a written table: ends its lineage and survives the loss of executors."""
    path = scratch(df.sparkSession, what)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, key: str | list[str], what: str, placed: bool = False, n: int | None = None) -> DataFrame:
    """``df`` as a table in buckets of ``key``, as many as shuffles have partitions or ``n``, so that joins
    and aggregates by the key leave its rows where they are.  It stays in the warehouse.

    placed: rows come out of a shuffle by the key, and need not be dealt again."""
    spark, name = df.sparkSession, f"{what}_{uuid.uuid4().hex}"
    n, keys = n or _partitions(spark), [key] if isinstance(key, str) else key
    rows = df if placed else df.repartition(n, *keys)
    rows.write.format("parquet").bucketBy(n, *keys).sortBy(*keys).saveAsTable(name)
    return spark.table(name)


def few_buckets(spark: SparkSession, rows: int, each: int = 10_000) -> int:
    """Buckets for a job of so many rows: a divisor of the shuffles' partitions, so that each of those has rows of one bucket."""
    most = _partitions(spark)
    return next(n for n in range(1, most + 1) if most % n == 0 and (n * each >= rows or n == most))


def _partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def write_text(pages: DataFrame, path: str, by: str = "audience") -> None:
    """Rows (audience, title, content) as text files, a folder for each audience."""
    pages.select(F.col(by), F.concat_ws("\n", F.concat(F.lit("# "), F.col("title")), F.col("content")).alias("value")).write.partitionBy(by).mode("overwrite").text(path)


def append_json(events: DataFrame, path: str) -> None:
    """Append-only sink for debug snapshots."""
    events.write.mode("append").json(path)


def path_segments(path: Column) -> Column:
    return F.split(path, r"[/\\]")

"""Helpers shared by the training-data operators."""

from __future__ import annotations

import ctypes
import json
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but the six ASCII white-space bytes.
WORD = r"[^\x20\x09-\x0D]+"

def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``, or where the
    cluster names none a folder in the warehouse, which they share as well."""
    named = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir") + "/_scratch"
    return named.rstrip("/")


def scratch(spark: SparkSession, what: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{what}-{uuid.uuid4().hex}"


def written(df: DataFrame, what: str) -> DataFrame:
    """``df`` as a table in the shared folder: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, what)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@dataclass(frozen=True)
class Bucketed:
    """A table of ``bucketed``: its rows, and how to delete it once no later plan reads it."""

    rows: DataFrame
    name: str
    path: str

    def drop(self) -> None:
        spark = self.rows.sparkSession
        spark.sql(f"DROP TABLE {self.name}")
        drop_path(spark, self.path)


def bucketed(df: DataFrame, key: str, what: str, dealt: bool = False) -> Bucketed:
    """``df`` as a table in the shared folder, in as many buckets of ``key`` as shuffles have partitions.

    Joins of such tables by the key move no rows.  ``dealt``: the rows come from such a join and
    lie in their buckets already, so they are not shuffled first."""
    spark, n = df.sparkSession, partitions(df.sparkSession)
    name = f"{what}_{uuid.uuid4().hex}"
    path = f"{shared_dir(spark)}/{name}"
    rows = df if dealt else df.repartition(n, key)
    rows.write.format("parquet").bucketBy(n, key).option("path", path).saveAsTable(name)
    return Bucketed(spark.table(name), name, path)


def drop_path(spark: SparkSession, path: str) -> None:
    """Delete a scratch table that no later plan reads."""
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner remove the shuffle files of plans that have ended."""
    spark._jvm.System.gc()


#: Bytes of an Arrow batch between the JVM and Python, unless the session sets its own.
BATCH = 4 << 20


def by_arrow(df: DataFrame, f: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``df.mapInArrow(f, schema)`` over batches of bounded bytes; a task's memory goes back when it ends."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH_SETTING, None) is None:
        spark.conf.set(_BATCH_SETTING, str(BATCH))

    def run(batches):
        try:
            yield from f(batches)
        finally:
            trim()

    if any("." in c or "`" in c for c in df.columns):  # such names are not found there; batches go by place
        df = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    return df.mapInArrow(run, schema)


_BATCH_SETTING = "spark.sql.execution.arrow.maxBytesPerBatch"


def trim() -> None:
    """Give a Python worker's freed memory back to the system, where the C library can."""
    pa.default_memory_pool().release_unused()
    give = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if give is not None:
        give(0)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def col(name: str) -> Column:
    """The column of that very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(columns: list[str], name: str) -> str:
    """``name``, made longer until no column has it."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def local_rows(spark: SparkSession, rows: list[dict], schema: str) -> DataFrame:
    """A small driver-side table as one literal (no Python on the executors)."""
    text = json.dumps(rows)
    return spark.range(1).select(F.inline(F.from_json(F.lit(text), f"array<struct<{schema}>>")))


def unit(seed: str, *cols: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the columns alone."""
    return F.pmod(F.xxhash64(F.lit(seed), *cols), F.lit(1 << 40)) / F.lit(float(1 << 40))


def few(df: DataFrame, rows: int, per_task: int = 20_000) -> DataFrame:
    """``df`` of about ``rows`` rows in no more tasks than they are worth, eight at least."""
    tasks = max(8, rows // per_task)
    return df.coalesce(tasks) if tasks < partitions(df.sparkSession) else df


def components(nodes_edges: DataFrame, what: str = "components") -> DataFrame:
    """Connected components of edges (a long, b long): rows (node, component).

    component is the smallest node reachable.  Alternates large-star and small-star, so
    rounds grow with the logarithm of the longest path and hubs are only ever joined by a
    partial aggregate.  Each round is written to the shared folder; nothing is collected.
    """
    edges = written(
        nodes_edges.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), what
    )

    def digest(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    seen = digest(edges)
    n = seen[0]
    while n:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = few(both.filter("v > u").join(low, "u"), n).select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = few(large.distinct(), n)
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = few(large.join(low, "u"), n)
        small = small.select(F.inline(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct(F.col("u"), F.col("m").alias("v")))))
        edges = written(few(small.filter("u <> v").distinct(), n), what)
        now = digest(edges)
        if now == seen:
            break
        seen = now
        n = seen[0]
    out = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return out.unionByName(out.select(F.col("component").alias("node"), "component").distinct())

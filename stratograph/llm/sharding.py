"""Sharding by sampled splitters.

Size-weighted samples of the content key give quantile boundaries; records are
range-partitioned by them, overfull ranges (one key that many records share) are
subdivided, and whole ranges are placed, largest first, on the least-filled shard.
"""

from __future__ import annotations

import heapq

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import col, local_rows, unit, written

#: Ranges a shard consists of, and size-weighted key samples drawn for each range.
RANGES_PER_SHARD, SAMPLES_PER_RANGE = 64, 16
#: Cells in which rows are numbered: at most so many, of so many rows at least.
MOST_CELLS, LEAST_CELL_ROWS = 1 << 16, 256


def _range_of(key, splits: list[int]):
    """The number of splitters at or below the key, by binary search over one literal."""
    if not splits:
        return F.lit(0)
    steps, step = [], 1
    while step * 2 <= len(splits):
        step *= 2
    while step:
        steps.append(step)
        step //= 2
    table = F.lit(splits)
    return F.aggregate(
        F.lit(steps),
        F.lit(0),
        lambda at, s: F.when((at + s <= len(splits)) & (key >= F.get(table, at + s - 1)), at + s).otherwise(at),
    )


def _place(items: list[tuple[int, int]], n_shards: int) -> dict[int, int]:
    """Item number -> shard: largest item first on the least-filled shard."""
    heap = [(0, s) for s in range(n_shards)]
    where = {}
    for item, size in sorted(items, key=lambda x: (-x[1], x[0])):
        load, shard = heapq.heappop(heap)
        where[item] = shard
        heapq.heappush(heap, (load + size, shard))
    return where


def shard(docs: DataFrame, n_shards: int = 40, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) by the law of equal bytes.

    size is the text's UTF-8 bytes plus 16 (null text: 16).  Equal texts stay in one shard
    unless together they exceed a shard's share; only then their range is subdivided, by id or,
    where ids repeat as well, by row.  Other ranges above twice their share are subdivided by
    text.  slot counts from 0 without gaps in each shard.  An empty table gives no rows; repeated rows
    are each placed; null ids are placed like others.  Other columns are not read.  The
    driver sees sampled keys, range sums and groups above 1/64 of a shard: all bounded by
    the number of shards, whatever the input.
    """
    spark = docs.sparkSession
    text = col(text_col).cast("string")
    base = docs.select(
        col(id_col).alias("doc_id"),
        F.xxhash64(text).alias("key"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + 16).cast("long").alias("size"),
        F.coalesce(F.crc32(F.encode(text, "UTF-8")), F.lit(0)).cast("long").alias("text_crc32"),
        F.monotonically_increasing_id().alias("row"),  # fixed by the write: tells repeated rows apart
    )
    base = written(base, "shard-base")
    total, rows = base.agg(F.coalesce(F.sum("size"), F.lit(0)), F.count("*")).first()
    n_ranges = n_shards * RANGES_PER_SHARD
    share, item_most = total / n_shards, max(1.0, total / n_ranges)

    groups = base.groupBy("key").agg(F.sum("size").alias("bytes"), F.count("*").alias("n"))
    heavy = [r.asDict() for r in groups.filter(F.col("bytes") > F.lit(item_most)).collect()]  # fewer than n_ranges
    heavy.sort(key=lambda r: (-r["bytes"], r["key"]))
    at = n_ranges
    for r in heavy:
        r["subs"] = -int(-r["bytes"] // item_most) if r["bytes"] > share else 1
        r["first"] = at
        at += r["subs"]
    named = local_rows(spark, heavy, "key long, subs int, first int")
    base = base.join(F.broadcast(named), "key", "left")

    wanted = n_ranges * SAMPLES_PER_RANGE
    sample = base.filter("subs is null").filter(unit("splitters", "doc_id", "key") < F.col("size") * F.lit(wanted / max(1, total)))
    keys = [r[0] for r in sample.select("key").orderBy("key").collect()]  # about `wanted` of them at most
    splits = sorted({keys[i * len(keys) // n_ranges] for i in range(1, n_ranges)}) if keys else []

    repeated = not base.filter("subs > 1").groupBy("key", "doc_id").count().filter("count > 1").isEmpty()
    which = F.xxhash64(F.lit("sub"), "doc_id", *[F.col("row")] * repeated)
    sub = F.col("first") + F.pmod(which, F.coalesce(F.col("subs"), F.lit(1))).cast("int")
    base = base.withColumn("item", F.when(F.col("subs").isNull(), _range_of(F.col("key"), splits)).otherwise(sub))
    base = written(base.select("doc_id", "size", "text_crc32", "item", "key", "row"), "shard-items")
    sums = [F.sum("size").alias("bytes"), F.count("*").alias("n")]
    items = base.groupBy("item").agg(*sums).collect()
    overfull = [{"item": r["item"], "parts": -int(-r["bytes"] // item_most)} for r in items if r["item"] < n_ranges and r["bytes"] > 2 * item_most]
    if overfull:  # the samples missed these ranges' quantiles: equal texts stay together, below a range's size each
        for r in overfull:
            r["begin"], at = at, at + r["parts"]
        named = local_rows(spark, overfull, "item int, parts int, begin int")
        base = base.join(F.broadcast(named), "item", "left")
        part = F.col("begin") + F.pmod(F.xxhash64(F.lit("part"), "key"), F.col("parts")).cast("int")
        base = base.withColumn("item", F.coalesce(part, F.col("item"))).drop("parts", "begin")
        items = base.groupBy("item").agg(*sums).collect()
    where = _place([(r["item"], r["bytes"]) for r in items], n_shards)
    cell_rows = max(LEAST_CELL_ROWS, rows // MOST_CELLS)
    plan = [{"item": r["item"], "shard": where[r["item"]], "cells": -(-r["n"] // cell_rows)} for r in items]
    plan = local_rows(spark, plan, "item int, shard int, cells int")

    base = base.join(F.broadcast(plan), "item")
    base = base.withColumn("cell", F.pmod(F.xxhash64(F.lit("cell"), "doc_id", "row"), F.col("cells")).cast("int"))
    starts = base.groupBy("shard", "item", "cell").agg(F.count("*").alias("n"))
    before = Window.partitionBy("shard").orderBy("item", "cell").rowsBetween(Window.unboundedPreceding, -1)
    starts = starts.select("item", "cell", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start"))
    inside = Window.partitionBy("item", "cell").orderBy("doc_id", "text_crc32", "size")
    return base.join(starts, ["item", "cell"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("start") + F.row_number().over(inside) - 1).alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )

"""Mixing sources to target weights by systematic sampling."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType
from pyspark.sql.window import Window

from .common import WORD, col, fresh, written

#: Weights dealt to the sources in order, the share of all words wanted, and the most repeats.
WEIGHTS, SHARE, MOST_REPEATS = (5, 2, 1), 1.5, 2
#: Cells per size class, so that no class of equal sizes is numbered in one task.
SPREAD = 256


def _offset(seed: int) -> float:
    """The one random offset, a multiple of 2^-20 in (0, 1)."""
    return random.Random(seed).randrange(1, 1 << 20) / (1 << 20)


def targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = MOST_REPEATS) -> DataFrame:
    """Rows (source, source_size, target) from rows (source, source_size), one per source.

    Sources in order of code point, null last, get the weights in turn.  Targets are
    least(cap, level * weight) with caps of ``most`` times the source: sharing the excess of
    capped sources again and again ends at that level.  With sources ordered by cap over
    weight, the level is the largest of (total - caps before) / (weights from here on).
    One row per source goes through one window, however many documents there are.
    """
    by_name = Window.orderBy(F.col("source").isNull(), F.col("source"))
    kind = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    rows = sizes.select("source", "source_size", F.get(F.array(*[F.lit(float(w)) for w in weights]), kind).alias("w"))
    rows = rows.withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").isNull(), F.col("source"))
    before = F.coalesce(F.sum("cap").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    weight = F.sum("w").over(order.rowsBetween(Window.currentRow, Window.unboundedFollowing))
    whole = Window.partitionBy()
    rows = rows.withColumn("level", (F.sum("source_size").over(whole) * F.lit(float(share)) - before) / weight)
    return rows.select("source", "source_size", F.least(F.col("cap"), F.max("level").over(whole) * F.col("w")).alias("target"))


def _as_text(docs: DataFrame, name: str):
    """A column as text; a struct, which ``mix`` makes the id of a row, by its first field."""
    kind = docs.schema[name].dataType
    return (col(name)["i"] if isinstance(kind, StructType) else col(name)).cast("string")


def mix_plan(
    docs: DataFrame,
    weights=WEIGHTS,
    share: float = SHARE,
    most: float = MOST_REPEATS,
    seed: int = 17,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
) -> DataFrame:
    """Rows (doc_id, source, size, source_size, target, taken, copies), one per document.

    size is the number of words (null text: 0).  Each document of a source is expected
    target / source_size times; prefix sums of that, in order of size class, plus one random
    offset, give a copy per integer boundary crossed, so a source's words stay within about
    its longest document of the target.  A null source is a source of its own, last in
    order; sources without words get no copies; an empty table gives no rows; repeated rows
    count each; equal ids in one class are ordered by text hash.  Documents are numbered in
    cells (source, size class, hash), so a source holding most rows spreads over many tasks;
    one task sums up one row per size class of a source, at most 64 * 32, or the 256 cells of one.
    """
    text = col(text_col).cast("string")
    base = docs.select(
        col(id_col).alias("doc_id"),
        col(source_col).cast("string").alias("source"),
        F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long").alias("size"),
        F.md5(_as_text(docs, id_col)).alias("h"),
        F.xxhash64(text).alias("t"),
    )
    bits = F.length(F.bin("size"))
    head = F.expr("cast(floor(size / pow(2, greatest(0, length(bin(size)) - 5))) as int)")
    base = base.withColumn("cell", bits * 32 + head).withColumn("sub", F.coalesce(F.conv(F.substring("h", 1, 2), 16, 10).cast("int"), F.lit(SPREAD)))
    base = written(base.drop("h"), "mix-base")

    cells = base.groupBy("source", "cell", "sub").agg(F.count("*").alias("n"), F.sum("size").alias("words"))
    goal = targets(cells.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, most)
    goal = goal.withColumn("rate", F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0))
    classes = cells.groupBy("source", "cell").agg(F.sum("n").alias("n"))
    before = Window.partitionBy("source").orderBy("cell").rowsBetween(Window.unboundedPreceding, -1)
    classes = classes.select(F.col("source").alias("s"), F.col("cell").alias("k"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    before = Window.partitionBy("source", "cell").orderBy("sub").rowsBetween(Window.unboundedPreceding, -1)
    cells = cells.select("source", "cell", "sub", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("inner"))
    cells = cells.join(classes, F.expr("source <=> s and cell = k")).select("source", "cell", "sub", (F.col("base") + F.col("inner")).alias("start"))
    cells = cells.alias("c").join(goal.alias("g"), F.expr("c.source <=> g.source")).select("c.*", "g.source_size", "g.target", "g.rate")

    inside = Window.partitionBy("source", "cell", "sub").orderBy("doc_id", "t")
    rows = base.withColumn("rn", F.row_number().over(inside)).alias("b")
    rows = rows.join(cells.alias("c"), F.expr("b.source <=> c.source and b.cell = c.cell and b.sub = c.sub"))
    u = F.lit(_offset(seed))
    upto = F.expr("c.start + b.rn")
    copies = F.floor(upto * F.col("c.rate") + u) - F.floor((upto - 1) * F.col("c.rate") + u)
    return rows.select("b.doc_id", "b.source", "b.size", "c.source_size", "c.target", copies.alias("copies")).withColumn(
        "taken", F.col("size") * F.col("copies")
    )


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **options) -> DataFrame:
    """``docs`` with each row repeated as often as the mix takes it (0, 1, 2 ... times).

    All columns stay, whatever their names.  Plan rows meet input rows by id, text and source;
    where rows repeat all three, each is numbered first, so every row gets its own copies and
    the words taken are those planned.
    """
    row, n, nth = (fresh(docs.columns, name) for name in ("_mix_row", "_mix_copies", "_mix_nth"))
    key = F.struct(col(id_col).alias("i"), F.xxhash64(col(text_col).cast("string")).alias("t"), col(source_col).cast("string").alias("s"))
    repeated = not docs.groupBy(key.alias("k")).count().filter("count > 1").isEmpty()
    if repeated:
        rows = written(docs.withColumn(row, F.monotonically_increasing_id()), "mix-rows")
    else:
        rows = docs.withColumn(row, key)
    plan = mix_plan(rows, id_col=row, text_col=text_col, source_col=source_col, **options)
    plan = plan.filter("copies > 0").select(F.col("doc_id").alias(row), F.col("copies").alias(n))
    rows = rows.join(plan, row).withColumn(nth, F.explode(F.sequence(F.lit(1).cast("long"), F.col(n))))
    return rows.select(*[col(c) for c in docs.columns])

"""Context budgets: what fits, how texts and histories are cut, which strategy applies."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.code import text_tokens
from ..sources.tables import cut
from .folds import folded

#: Tokens kept for the answer and for prompt overhead.
RESPONSE, MARGIN = 2048, 200


def fits(tokens: Column, context: int) -> Column:
    return tokens < context - RESPONSE


def needs_chunks(text: Column, system: Column, context: int) -> Column:
    return text + system > context - RESPONSE


def chunk_sizes(context: Column) -> tuple[Column, Column]:
    """(characters of a chunk, characters of overlap)."""
    free = context - RESPONSE - MARGIN
    free = F.when(free <= 0, F.floor(context * F.lit(0.7))).otherwise(free)
    size = F.floor(free * F.lit(0.5)) * 4
    return size, F.floor(size / 10)


def strategy(iterative: Column, rag: Column, simple: Column) -> Column:
    return F.when(iterative, "iterative").when(rag, "rag").when(simple, "simple").otherwise("error")


def compacted(findings: DataFrame, limit: float) -> DataFrame:
    """rows (key, seq, tokens) with the running sum and whether it calls for compaction."""
    w = Window.partitionBy("key").orderBy("seq").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return findings.withColumn("running", F.sum("tokens").over(w)).withColumn("compact", F.col("running") > limit)


def synthesis_batches(texts: DataFrame, context: int, share: float = 0.7) -> DataFrame:
    """(key, seq, batch): greedy batches of up to ``share`` of the budget, in order."""
    limit = int((context - RESPONSE - 300) * share)

    def pack(state, row):
        batch, used = state
        if used > 0 and used + row.tokens > limit:
            batch, used = batch + 1, 0
        return (batch, used + row.tokens), batch

    return folded(texts.select("key", "seq", "tokens"), "key", "seq", lambda: (0, 0), pack, "batch", "int").select("key", "seq", "batch")


def history_batches(turns: DataFrame) -> DataFrame:
    """(conv_id, turn, batch, verbatim): batches of max(3, n / 3); the last one stays as it is."""
    w = Window.partitionBy("conv_id")
    n = F.count("*").over(w)
    size = F.greatest(F.lit(3), F.floor(n / 3))
    batch = F.floor((F.row_number().over(w.orderBy("turn")) - 1) / size)
    last = F.floor((n - 1) / size)
    return turns.select("conv_id", "turn", batch.cast("int").alias("batch"), (batch == last).alias("verbatim"))


def last_messages(turns: DataFrame, k: int = 5) -> DataFrame:
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    return turns.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).drop("nth")


def valid(turns: DataFrame, context: int) -> DataFrame:
    """(conv_id, tokens, valid): the sum of the turns' tokens against the budget."""
    rows = turns.groupBy("conv_id").agg(F.sum(text_tokens(F.col("text"))).alias("tokens"))
    return rows.withColumn("valid", F.col("tokens") <= context - RESPONSE)


def routed(task: Column, models: dict[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in models.items() for x in kv])[task]


def scaled(value: Column, low: Column, high: Column) -> Column:
    return low + value / 100.0 * (high - low)


def synthesis(prompt: Column, context: Column, map_reduce: Column, entities: Column, keyed: Column) -> Column:
    return (
        F.when(map_reduce | (prompt > context * F.lit(3.5)), "map_reduce").when(keyed, "chain_of_key").when(entities > 0, "entity_anchored").otherwise("direct")
    )


def capped(rows: DataFrame, key: str, order: str, k: int) -> DataFrame:
    """The first k rows of each key."""
    w = Window.partitionBy(key).orderBy(order)
    return rows.withColumn("nth", F.row_number().over(w)).filter(F.col("nth") <= k).drop("nth")


#: Shares of the room that a synthesis may fill, a batch may fill and a compacted batch may keep; characters between findings.
FINAL, BATCH, COMPACT, RULE = 0.8, 0.7, 0.4, 7
#: Levels of synthesis, passes over a history, messages it has at least and keeps at last.
LEVELS, PASSES, LONG_HISTORY, KEPT = 5, 5, 10, 5


def halved(length: Column, most: int) -> Column:
    """What stands in for the length of a model's summary: half of the text, ``most`` tokens at most."""
    return F.least(F.ceil(length / 2), F.lit(most * 4))


def synthesis_levels(findings: DataFrame, context: int, compacted=halved) -> DataFrame:
    """(key, level, seq, length, batch, forced) of findings (key, seq, length in characters).

    A key whose findings fit is one call (batch -1).  Others go in batches, in order, each
    compacted to ``compacted(length, tokens)`` characters, and the next level has one finding a
    batch; after LEVELS levels what is left is one call whatever its size (forced).  Only keys
    that do not fit yet take part in a level."""
    room = context - RESPONSE - 300

    def pack(state, row):
        batch, used, some = state
        tokens = row.length // 4
        if some and used + tokens > room * BATCH:
            batch, used = batch + 1, 0
        return (batch, used + tokens, True), batch

    rows = cut(findings.select("key", F.col("seq").cast("long").alias("seq"), F.col("length").cast("long").alias("length")), "findings")
    out = []
    for level in range(LEVELS + 2):
        tokens = F.floor((F.sum("length") + RULE * (F.count("*") - 1)) / 4)
        size = rows.groupBy("key").agg((tokens <= room * FINAL).alias("fits"))
        sized = cut(rows.join(size, "key"), "sized")
        ends = sized if level > LEVELS else sized.filter("fits")
        out.append(ends.select("key", F.lit(level).alias("level"), "seq", "length", F.lit(-1).alias("batch"), (~F.col("fits")).alias("forced")))
        rest = sized.filter("not fits").select("key", "seq", "length")
        if level > LEVELS or rest.isEmpty():
            break
        packed = cut(folded(rest, "key", "seq", lambda: (0, 0, False), pack, "batch", "int"), "batches")
        out.append(packed.select("key", F.lit(level).alias("level"), "seq", "length", "batch", F.lit(False).alias("forced")))
        joined = packed.groupBy("key", "batch").agg((F.sum("length") + 2 * (F.count("*") - 1)).alias("length"))
        rows = joined.select("key", F.col("batch").cast("long").alias("seq"), compacted(F.col("length"), int(room * COMPACT)).cast("long").alias("length"))
    every = out[0]
    for o in out[1:]:
        every = every.unionByName(o)
    return every


def short(length: Column) -> Column:
    """What stands in for the length of a model's summary of a few sentences."""
    return F.least(length, F.lit(200))


def reduced_history(turns: DataFrame, context: int, other: int = 0, summary=short) -> DataFrame:
    """(key, pos, first, last, length, summarised, passes, truncated) of turns (key, pos, role, length).

    A history of more than LONG_HISTORY messages that does not fit beside ``other`` tokens goes
    through passes: batches of max(3, n / 3) messages become one message each, the last batch
    stays.  Only histories that still do not fit go on; after PASSES passes they keep their last
    KEPT messages (truncated).  first, last: the turns a message stands for."""
    room = context - RESPONSE
    every = Window.partitionBy("key")
    tokens = F.floor(F.col("length") / 4)
    start = turns.select("key", F.col("pos").alias("at"), F.length("role").alias("role"), F.col("length").cast("long").alias("length"))
    start = start.select("key", F.row_number().over(every.orderBy("at")).alias("pos"), "role", "length", F.col("at").alias("first"), F.col("at").alias("last"), F.lit(False).alias("summarised"))
    start = start.withColumn("long", (F.count("*").over(every) > LONG_HISTORY) & (F.sum(tokens).over(every) > room))
    start = cut(start, "histories")
    names = ["key", "pos", "first", "last", "length", "summarised"]
    out = [start.filter("not long").select(*names, F.lit(0).alias("passes"), F.lit(False).alias("truncated"))]
    rows = start.filter("long").drop("long")
    for done in range(PASSES + 1):
        sized = cut(rows.withColumn("fits", F.sum(tokens).over(every) + other < room), "sized")
        out.append(sized.filter("fits").select(*names, F.lit(done).alias("passes"), F.lit(False).alias("truncated")))
        rest = sized.filter("not fits").drop("fits")
        if rest.isEmpty():
            break
        if done == PASSES:
            last = rest.withColumn("back", F.row_number().over(every.orderBy(F.desc("pos")))).filter(F.col("back") <= KEPT)
            last = last.withColumn("pos", F.row_number().over(every.orderBy("pos")))
            out.append(last.select(*names, F.lit(done).alias("passes"), F.lit(True).alias("truncated")))
            break
        n = F.count("*").over(every)
        size = F.greatest(F.lit(3), F.floor(n / 3))
        rest = rest.withColumn("batch", F.floor((F.col("pos") - 1) / size)).withColumn("final", F.col("batch") == F.floor((n - 1) / size))
        kept = rest.filter("final").withColumn("pos", F.col("batch") + 1 + F.row_number().over(every.orderBy("pos")) - 1)
        content = F.sum(F.col("role") + 2 + F.col("length")) + 2 * (F.count("*") - 1)
        head = F.length(F.concat(F.lit("[Summary of "), F.count("*").cast("string"), F.lit(" messages]: ")))
        made = rest.filter("not final").groupBy("key", "batch").agg((head + summary(content)).alias("length"), F.min("first").alias("first"), F.max("last").alias("last"))
        made = made.select("key", (F.col("batch") + 1).alias("pos"), F.lit(9).alias("role"), F.col("length").cast("long").alias("length"), "first", "last", F.lit(True).alias("summarised"))  # an assistant says it
        rows = kept.select(made.columns).unionByName(made)
    every_row = out[0]
    for o in out[1:]:
        every_row = every_row.unionByName(o)
    return every_row.select("key", F.col("pos").cast("int").alias("pos"), "first", "last", "length", "summarised", "passes", "truncated")

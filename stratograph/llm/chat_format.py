"""Chat formatting by prefix-target expansion.

Every assistant turn becomes an example of its own: all turns before it as context, the turn
itself as the only text under the loss mask.  A conversation that does not end with an
assistant turn has one more example without any loss, so the files hold every turn.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import scratch

#: The template: a turn is OPEN role, line feed, text, CLOSE.  Inside texts and roles a
#: backslash is doubled and MARK gets one after its first character, so neither tag can
#: occur there; a line feed in a role is written as LINE.
OPEN, CLOSE, MARK, LINE = "<|im_start|>", "<|im_end|>\n", "<|", "<|nl|>"
TARGET = "assistant"


def escaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(MARK), F.lit("<\\|"))


def unescaped(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("<\\|"), F.lit(MARK)), F.lit("\\\\"), F.lit("\\"))


def examples(turns: DataFrame) -> DataFrame:
    """Rows (conv_id, target_turn, n_turns, text, loss_start, loss_chars) from (conv_id, turn, role, text).

    target_turn counts turns from 1; loss_start and loss_chars are code points in text.  The
    example without loss has 0 for both.  Null texts and roles count as empty; turns are
    ordered by turn (null first), role and text, so repeated rows stay and reruns agree;
    null conv_ids form one conversation; an empty table gives no rows.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    role = F.coalesce(F.col("role").cast("string"), F.lit(""))
    turns = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    said = turns.select(
        "conv_id",
        F.struct(
            F.col("turn").alias("turn"),
            F.col("role").alias("role"),
            F.col("text").alias("said"),
            F.concat(F.lit(OPEN), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(LINE)), F.lit("\n")).alias("head"),
            escaped(F.col("text")).alias("body"),
        ).alias("t"),
    )
    convs = said.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    whole = F.transform("t", lambda x: F.concat(x["head"], x["body"], F.lit(CLOSE)))
    ends = F.filter(
        F.sequence(F.lit(1), F.size("t")),
        lambda i: (F.element_at("t", i)["role"] == TARGET) | (i == F.size("t")),
    )
    rows = convs.select("conv_id", "t", whole.alias("w"), F.explode(ends).alias("target_turn"))
    last = F.element_at("t", F.col("target_turn"))
    context = F.array_join(F.slice("w", F.lit(1), F.col("target_turn") - 1), "")
    rows = rows.select("conv_id", "target_turn", last.alias("l"), context.alias("c"))
    mine = F.col("l.role") == TARGET
    return rows.select(
        "conv_id",
        "target_turn",
        F.col("target_turn").cast("long").alias("n_turns"),
        F.concat("c", "l.head", "l.body", F.lit(CLOSE)).alias("text"),
        F.when(mine, F.length("c") + F.length("l.head")).otherwise(0).cast("long").alias("loss_start"),
        F.when(mine, F.length("l.body")).otherwise(0).cast("long").alias("loss_chars"),
    )


def write_examples(turns: DataFrame, path: str) -> None:
    """The examples as Parquet, those of a conversation side by side so that prefixes compress."""
    examples(turns).write.option("compression", "zstd").parquet(path)


def parsed(text: Column) -> Column:
    """The turns of an example: array of (role, text), unescaped."""
    parts = F.split(text, r"<\|im_end\|>\n")
    parts = F.slice(parts, F.lit(1), F.size(parts) - 1)

    def turn(x: Column) -> Column:
        x = F.substring(x, F.lit(len(OPEN) + 1), F.length(x))
        at = F.instr(x, "\n")
        role = unescaped(F.replace(F.substring(x, F.lit(1), at - 1), F.lit(LINE), F.lit("\n")))
        return F.struct(role.alias("role"), unescaped(F.substring(x, at + 1, F.length(x))).alias("text"))

    return F.transform(parts, turn)


def read_digest(spark, path: str) -> DataFrame:
    """One row per conversation, all taken from the files: its turns and its text under the mask."""
    rows = spark.read.parquet(path)
    loss = unescaped(F.expr("substring(text, cast(loss_start + 1 as int), cast(loss_chars as int))"))
    rows = rows.withColumn("loss", loss)
    rows = rows.groupBy("conv_id").agg(
        F.max_by("text", "target_turn").alias("text"),
        F.array_sort(F.collect_list(F.struct("target_turn", "loss"))).alias("loss"),
        F.sum(F.length("text")).alias("formatted_chars"),
    )
    turns = parsed(F.col("text"))
    rows = rows.select("conv_id", turns.alias("t"), F.array_join("loss.loss", "").alias("loss"), "formatted_chars")
    digest = F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return rows.select(
        "conv_id",
        F.size("t").cast("long").alias("n_turns"),
        F.sha2(F.encode(digest, "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def format_conversations(turns: DataFrame, path: str | None = None) -> DataFrame:
    """Write the examples (to a new shared path unless given) and digest them from disk."""
    spark = turns.sparkSession
    path = path or scratch(spark, "chat")
    write_examples(turns, path)
    return read_digest(spark, path)

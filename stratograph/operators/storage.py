"""Keyed tables with the semantics of upserts, guarded updates and job logs; change detection."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Job states that are over, and the state each phase reports.
OVER = ("Completed", "Failed", "Cancelled")
PHASES = {"Decomposition": "Analyzing", "Rubric Generation": "Analyzing", "Content Generation": "Generating", "Evaluation": "Generating", "Complete": "Completed"}


def latest(rows: DataFrame, seq: str, *keys: str) -> DataFrame:
    """The last row of each key by seq."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), seq).alias("r")).select(*keys, "r.*")


def delete(rows: DataFrame, gone: DataFrame, *keys: str) -> DataFrame:
    return rows.join(gone, list(keys), "left_anti")


def by_title(pages: DataFrame, title: str) -> DataFrame:
    """The first page of a title, ASCII case folded."""
    plain = F.translate("title", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return pages.filter(plain == "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in title)).orderBy("page_id").limit(1)


def recent_or_active(jobs: DataFrame, now, hours: int = 24) -> DataFrame:
    return jobs.filter(~F.col("status").isin(*OVER) | (F.col("created_at") > F.lit(now) - F.expr(f"interval {hours} hours"))).orderBy(F.desc("created_at"), "job_id")


def cancel(jobs: DataFrame, job_id, reason: str = "Cancelled") -> DataFrame:
    """The jobs after a cancel that only takes hold of a job that is not over."""
    hit = (F.col("job_id") == job_id) & ~F.col("status").isin(*OVER)
    return jobs.withColumn("status", F.when(hit, reason).otherwise(F.col("status")))


def phase_status(phase):
    table = F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])
    return F.coalesce(table[phase], F.lit("Analyzing"))


def changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """(path, change) between snapshots (path, stamp): new, modified or deleted."""
    a, b = old.select("path", F.col("stamp").alias("was")), new.select("path", F.col("stamp").alias("now"))
    kind = F.when(F.col("was").isNull(), "new").when(F.col("now").isNull(), "deleted").when(F.col("was") != F.col("now"), "modified")
    return a.join(b, "path", "full_outer").select("path", kind.alias("change")).filter("change is not null")

"""Message composition, dispatch, jobs, judges and prompts: orchestration as tables of decisions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..sources.tables import cut


def blank(text: Column) -> Column:
    return F.coalesce(F.trim(text), F.lit("")) == ""


def reduce_messages(contexts: DataFrame, history: DataFrame) -> DataFrame:
    """(id, place, role, content): the final message list of a map-reduce composition.

    Contexts (id, system, text, use_map_reduce, hierarchical) that ask for it and bring
    hierarchical data get the system prompt, the history (id, turn, role, content) and the
    reduced text, blank parts left out; places count from 0.  The others get no rows."""
    wanted = contexts.filter(F.col("use_map_reduce") & F.col("hierarchical"))
    first = wanted.filter(~blank(F.col("system"))).select("id", F.lit(0).alias("part"), F.lit(0).cast("long").alias("turn"), F.lit("system").alias("role"), F.col("system").alias("content"))
    told = history.join(wanted.select("id"), "id", "left_semi").select("id", F.lit(1).alias("part"), F.col("turn").cast("long").alias("turn"), "role", "content")
    last = wanted.filter(~blank(F.col("text"))).select("id", F.lit(2).alias("part"), F.lit(0).cast("long").alias("turn"), F.lit("user").alias("role"), F.col("text").alias("content"))
    # at most one row before a context's history, so places follow from the turn's rank alone
    rows = first.unionByName(told).unionByName(last).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("part", "turn", "role", "content"))).alias("m"))
    return rows.select("id", F.posexplode("m").alias("place", "r")).select("id", "place", "r.role", "r.content")


#: Composition strategies by priority, and iterative ones, which come before all others.
STRATEGIES = (("RAG", False, 0), ("Simple", False, 1), ("MapReduce", False, 3), ("Chunking", True, 4), ("MultiPassReduction", True, 5))


def chosen_strategy(can_handle: dict[str, Column]) -> tuple[Column, Column]:
    """(name, iterative) of the first strategy that can handle a context; null if none can.

    Iterative strategies are tried first, each kind in order of priority."""
    order = sorted((s for s in STRATEGIES if s[0] in can_handle), key=lambda s: (not s[1], s[2]))
    name, iterative = F.lit(None).cast("string"), F.lit(None).cast("boolean")
    for kind, loops, _ in reversed(order):
        name = F.when(can_handle[kind], kind).otherwise(name)
        iterative = F.when(can_handle[kind], F.lit(loops)).otherwise(iterative)
    return name, iterative


def dispatched(tasks: DataFrame, agents: DataFrame, target: Column, most: int = 10) -> tuple[DataFrame, DataFrame]:
    """(results, events) of tasks (task_id, type) handed to agents (place, role, type).

    The first agent (by place) that handles a task's type takes it; where ``target``, a column
    over (task_id, type, hop), names another type, it delegates, which leaves an event, and the
    task of that type is dispatched again, ``most`` times at most.  A task without an agent
    fails.  results: (task_id, role, hops, success); events: (task_id, hop, from_role, to_type)."""
    first = agents.groupBy("type").agg(F.min_by("role", "place").alias("role"))
    open_ = cut(tasks.select("task_id", "type"), "tasks")
    results, events = [], []
    for hop in range(most + 1):
        rows = open_.withColumn("hop", F.lit(hop)).join(first, "type", "left")
        to = F.when(F.col("role").isNotNull() & F.lit(hop < most), target)
        rows = cut(rows.select("task_id", "type", "hop", "role", to.alias("to")), "tasks")
        results.append(rows.filter("to is null").select("task_id", "role", F.col("hop").alias("hops"), F.col("role").isNotNull().alias("success")))
        moved = rows.filter("to is not null")
        events.append(moved.select("task_id", "hop", F.col("role").alias("from_role"), F.col("to").alias("to_type")))
        if moved.isEmpty():
            break
        open_ = moved.select("task_id", F.col("to").alias("type"))
    done, sent = results[0], events[0]
    for r, e in zip(results[1:], events[1:]):
        done, sent = done.unionByName(r), sent.unionByName(e)
    return done, sent


#: A phase's job status.
PHASES = {"Decomposition": "Analyzing", "Rubric Generation": "Analyzing", "Content Generation": "Generating", "Evaluation": "Generating", "Complete": "Completed"}


def job_states(progress: DataFrame, cancels: DataFrame, poll: int = 2) -> DataFrame:
    """(job_id, status, percent) of jobs from progress (job_id, at, phase, percent) and
    cancellation requests (job_id, at).

    A runner looks for requests every ``poll`` seconds: progress at or after the first look
    that sees one no longer counts, and the job is Cancelled with 0 percent unless it had
    completed before.  Else its status is that of the last phase, unknown ones Analyzing."""
    asked = cancels.groupBy("job_id").agg((F.ceil(F.min(F.unix_micros(F.col("at").cast("timestamp"))) / (poll * 1_000_000)) * poll * 1_000_000).alias("seen"))
    status = F.coalesce(F.create_map(*[F.lit(x) for kv in PHASES.items() for x in kv])[F.col("phase")], F.lit("Analyzing"))
    rows = progress.withColumn("us", F.unix_micros(F.col("at").cast("timestamp"))).join(asked, "job_id", "left").withColumn("status", status)
    rows = rows.withColumn("counts", F.col("seen").isNull() | (F.col("us") < F.col("seen")))
    last = rows.groupBy("job_id").agg(
        F.max(F.when(F.col("counts"), F.struct("us", "percent", "status"))).alias("last"), F.max(F.col("seen").isNotNull()).alias("asked")
    )
    cancelled = F.col("asked") & (F.coalesce(F.col("last.status"), F.lit("")) != "Completed")
    return last.select("job_id", F.when(cancelled, "Cancelled").otherwise(F.col("last.status")).alias("status"), F.when(cancelled, 0).otherwise(F.col("last.percent")).alias("percent"))


def judged(pages: DataFrame, judges: list[Column], failed: Column | None = None) -> DataFrame:
    """(page_id, judge_id, score) by each of a list of judges, columns over a page, as Judge_1,
    Judge_2 and so on.  Scores that are null, or where ``failed`` holds, are left out."""
    if not judges:
        raise ValueError("at least one judge is needed")
    scores = F.array(*[F.struct(F.lit(f"Judge_{i}").alias("judge_id"), j.cast("double").alias("score")) for i, j in enumerate(judges, 1)])
    rows = pages.select("page_id", F.inline(scores), *([failed.alias("_failed")] if failed is not None else []))
    if failed is not None:
        rows = rows.filter(~F.col("_failed")).drop("_failed")
    return rows.filter("score is not null")


def default_prompt(requirement: Column, description: Column, outline: Column) -> Column:
    """A judge's prompt: the requirement and an outline of the documentation, without contents."""
    return F.concat(
        F.lit("Judge the documentation against one requirement.\nRequirement: "), requirement, F.lit("\nDescription: "), F.coalesce(description, F.lit("")),
        F.lit("\nOutline:\n"), outline, F.lit('\nAnswer with JSON alone: {"requirement_id", "score" from 0 to 1, "reasoning", "evidence"}\n'),
    )


def retrieval_prompt(requirement: Column, description: Column, passages: Column) -> Column:
    """The same with retrieved passages in place of the outline."""
    return F.concat(
        F.lit("Judge the documentation against one requirement.\nRequirement: "), requirement, F.lit("\nDescription: "), F.coalesce(description, F.lit("")),
        F.lit("\nPassages:\n"), F.array_join(passages, "\n---\n"), F.lit('\nAnswer with JSON alone: {"requirement_id", "score" from 0 to 1, "reasoning", "evidence"}\n'),
    )


def prompt(pages: Column, default: Column, retrieval: Column, most: int = 10) -> Column:
    """Retrieval is used beyond ``most`` pages."""
    return F.when(pages > most, retrieval).otherwise(default)


def resumable(step: Callable[[], DataFrame], spark, path: str) -> DataFrame:
    """The table at ``path`` if an earlier run finished writing it, else that of ``step``, kept there."""
    done = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not done.getFileSystem(spark._jsc.hadoopConfiguration()).exists(done):
        step().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def snapshot(step: Callable[[], DataFrame], spark, path: str, what: str) -> DataFrame:
    """``step``'s table; if it fails, what failed and why is appended at ``path`` and the error rises."""
    from ..sources.tables import append_json

    try:
        return step()
    except Exception as error:
        append_json(spark.createDataFrame([(what, type(error).__name__, str(error))], "step string, kind string, message string"), path)
        raise

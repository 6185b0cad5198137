"""Structured Streaming: debounced file changes, message routing, live state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..sources.model import Graph, without_files


def debounced(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds") -> DataFrame:
    """(key, started, ended, n): bursts of events (key, ts) with no pause as long as the gap.

    A session window: the same on a stream, where the watermark closes bursts, and on a table."""
    rows = events.withWatermark("ts", late) if events.isStreaming else events
    s = rows.groupBy("key", F.session_window("ts", gap)).agg(F.count("*").alias("n"))
    return s.select("key", F.col("session_window.start").alias("started"), F.col("session_window.end").alias("ended"), "n")


def renames(events: DataFrame) -> DataFrame:
    """Renames as a removal of the old path and an addition of the new one."""
    both = F.when(F.col("kind") == "renamed", F.array(F.struct(F.col("old_path").alias("path"), F.lit("deleted").alias("kind")), F.struct("path", F.lit("created").alias("kind"))))
    return events.select("ts", F.inline(F.coalesce(both, F.array(F.struct("path", "kind")))))


def routed(events: DataFrame, *types: str) -> DataFrame:
    """The events of the types subscribed to; * subscribes to all."""
    return events if "*" in types else events.filter(F.col("type").isin(*types))


def latest_status(events: DataFrame) -> DataFrame:
    """(sender, status, at): the last status of each sender, an aggregate for update mode."""
    return events.groupBy("sender").agg(F.max_by("status", "ts").alias("status"), F.max("ts").alias("at"))


def run_once(stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Hand every batch that is there to ``handle``; a crash of it stops the query, not the source."""
    stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def reindexed(graph: Graph, changed: DataFrame, nodes: DataFrame, arcs: DataFrame) -> Graph:
    """The graph after files (file_path) were parsed again or removed: theirs go, the new come."""
    kept = without_files(graph, changed)
    all_nodes = kept.nodes.unionByName(nodes, allowMissingColumns=True)
    ids = all_nodes.select("node_id")
    arcs = arcs.join(ids, F.col("src") == F.col("node_id"), "left_semi").join(ids, F.col("dst") == F.col("node_id"), "left_semi")
    return Graph(all_nodes, kept.edges.unionByName(arcs.select(kept.edges.columns)), kept.adjacency.unionByName(arcs.select("src", "dst")))


def index_states(events: DataFrame) -> DataFrame:
    """(key, state, pending) of indexes from events (key, seq, kind, path): kinds started,
    completed, changed and indexed.

    Only the last start and completion, and what changed after both, matter, so the fold is
    an aggregate: Initializing before any, Indexing after a start, Ready after a completion,
    Stale once a file changed after that.  pending: files changed, not indexed since."""
    last = events.groupBy("key").agg(*[F.max(F.when(F.col("kind") == k, F.col("seq"))).alias(k) for k in ("started", "completed", "changed")])
    reset = last.select("key", F.greatest("started", "completed").alias("reset"))
    files = events.join(reset, "key").filter("kind in ('changed', 'indexed') and (reset is null or seq > reset)")
    files = files.groupBy("key", "path").agg(F.max_by("kind", "seq").alias("kind")).filter("kind = 'changed'")
    pending = files.groupBy("key").agg(F.count("*").alias("pending"))
    state = (
        F.when(F.col("started").isNull() & F.col("completed").isNull(), "Initializing")
        .when(F.col("completed").isNull() | (F.col("started") > F.col("completed")), "Indexing")
        .when(F.col("changed") > F.col("completed"), "Stale").otherwise("Ready")
    )
    return last.join(pending, "key", "left").select("key", state.alias("state"), F.coalesce("pending", F.lit(0)).cast("long").alias("pending"))


def refreshed(graph: Graph, scope: str, path: str | None, nodes: DataFrame, arcs: DataFrame) -> Graph:
    """The graph after a refresh: scope all, file or directory; nodes and arcs are those of the
    files parsed again.  file and directory need a path."""
    scope = scope.lower()
    if scope not in ("all", "file", "directory"):
        raise ValueError(f"scope must be all, file or directory, not {scope}")
    if scope == "all":
        return reindexed(graph, graph.nodes.select("file_path"), nodes, arcs)
    if not path:
        raise ValueError(f"scope {scope} needs a path")
    below = path.rstrip("/\\").lower()
    low = F.lower("file_path")
    inside = (low == below) if scope == "file" else (low.startswith(below + "/") | low.startswith(below + "\\"))
    changed = graph.nodes.filter(inside).select("file_path").unionByName(nodes.select("file_path"))
    return reindexed(graph, changed, nodes, arcs)


class IndexState:
    """Initializing, Indexing, Ready, Stale: the states of an index and what moves it on."""

    def __init__(self) -> None:
        self.state, self.pending = "Initializing", set()

    def begin(self) -> None:
        self.state = "Indexing"

    def ready(self) -> None:
        self.state, self.pending = "Ready", set()

    def changed(self, path: str) -> None:
        self.pending.add(path)
        self.state = "Stale" if self.state in ("Ready", "Stale") else self.state

    def indexed(self, path: str) -> None:
        self.pending.discard(path)
        if not self.pending and self.state == "Stale":
            self.state = "Ready"

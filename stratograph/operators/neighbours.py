"""Nearest neighbours of many queries: an inverted file of vectors, searched exactly.

Centroids are trained on a bounded sample; every vector lies in the cell of its nearest one,
sorted by its angle to it, in blocks.  A table of queries is joined with the blocks of its
nearest cells; the k-th best cosine found so far then tells which further cells can hold
anything better, by the triangle inequality of angles, and only those are joined as well.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..sources.tables import cut

#: Vectors a centroid is trained on at most, cells at most, rounds of training, vectors of a block and queries of a pack.
SAMPLE, MOST_CELLS, ROUNDS, BLOCK, PACK = 20_000, 4096, 5, 4096, 1024
_SLACK, DIGITS = 1e-7, 12
_FOUND = "query_id bigint, doc_id bigint, score double"


@dataclass(frozen=True)
class Index:
    """blocks (cell, ids, vectors, low, high): unit vectors and their range of angles to the
    centroid; centroids: of length 1; low, high: of whole cells, high < low where one is empty."""

    blocks: DataFrame
    centroids: np.ndarray
    low: np.ndarray
    high: np.ndarray
    size: int


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.maximum(np.abs(x).max(axis=1, keepdims=True, initial=0), 1e-300)
    return x / np.maximum(np.sqrt((x * x).sum(axis=1, keepdims=True)), 1e-300)


def _usable(vectors: DataFrame, id_col: str, size: int) -> DataFrame:
    """(id, v) of the vectors of that size that are neither null nor 0 and hold finite numbers alone."""
    rows = vectors.select(F.col(id_col).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("v")).filter(F.size("v") == size)
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return rows.filter(F.col("id").isNotNull() & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0))


def _matrix(column: pa.Array, size: int) -> np.ndarray:
    return _unit(column.flatten().to_numpy(zero_copy_only=False).reshape(-1, size))


def _angles(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(x @ centroids.T, -1.0, 1.0))


def build(vectors: DataFrame, size: int, cells: int | None = None) -> Index:
    """The index of vectors (doc_id, embedding) of ``size`` numbers, about the root of their number of cells."""
    rows = _usable(vectors, "doc_id", size)
    n = rows.count()
    k = max(1, min(MOST_CELLS, n, cells or round(n**0.5)))
    chance = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) < int((1 << 20) * min(1.0, 2.0 * SAMPLE / max(1, n)))
    some = rows.filter(chance).orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("v").toArrow()["v"].combine_chunks()
    some = some if isinstance(some, pa.Array) else pa.concat_arrays(some.chunks)
    x = _matrix(some, size) if len(some) else np.zeros((1, size))
    centroids = x[np.unique(np.linspace(0, len(x) - 1, k).astype(int))]
    for _ in range(ROUNDS):
        own = (x @ centroids.T).argmax(axis=1)
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids = np.where(np.abs(sums).max(axis=1, keepdims=True) > 0, _unit(sums), centroids)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column(1), size)
                a = _angles(x, centroids)
                cell = a.argmin(axis=1)
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), pa.array(a[np.arange(len(x)), cell]), batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], names=["cell", "angle", "id", "v"])

    dealt = cut(rows.mapInArrow(assign, "cell int, angle double, id bigint, v binary"), "assigned")
    dealt = dealt.repartitionByRange("cell", "angle", "id").sortWithinPartitions("cell", "angle", "id")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell, angle = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            edge = np.flatnonzero(np.diff(cell)) + 1
            for a, b in zip(np.append(0, edge), np.append(edge, len(cell))):
                for i in range(a, b, BLOCK):
                    j = min(i + BLOCK, b)
                    if i < j:
                        arrays = [pa.array([cell[i]], pa.int32()), pa.array([batch.column(2)[i:j].to_pylist()], pa.list_(pa.int64())), pa.array([b"".join(batch.column(3)[i:j].to_pylist())], pa.binary()), pa.array([angle[i]]), pa.array([angle[j - 1]])]
                        yield pa.RecordBatch.from_arrays(arrays, names=["cell", "ids", "vectors", "low", "high"])

    blocks = cut(dealt.mapInArrow(pack, "cell int, ids array<bigint>, vectors binary, low double, high double"), "blocks")
    low, high = np.full(len(centroids), 1.0), np.full(len(centroids), 0.0)
    for r in blocks.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high")).collect():
        low[r["cell"]], high[r["cell"]] = r["low"], r["high"]
    return Index(blocks, centroids, low, high, size)


def nearest(index: Index, queries: DataFrame, k: int, probes: int = 4) -> DataFrame:
    """(query_id, rank, doc_id, score, cells) of queries (query_id, embedding): the k vectors of
    greatest cosine, to DIGITS digits, ties by id; cells: how many were read for the query.

    Exact: a cell is left out only if the angles say that nothing in it reaches the k-th best.
    Queries that are null, 0, of another size or hold null or non-finite numbers have no rows,
    as has an empty index.  A query's own vector, if it is in the index, counts like any other."""
    asked = cut(_usable(queries, "query_id", index.size), "queries")
    size, centroids, low, high = index.size, index.centroids, index.low, index.high

    def visits(rows: DataFrame, more: bool) -> DataFrame:
        """(cell, id, v, least): the cells of each query, the nearest ones or those that are left."""

        def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column(1), size)
                a = _angles(x, centroids)
                apart = np.maximum(0.0, np.maximum(a - high, low - a) - _SLACK)
                apart[:, high < low] = np.inf
                order = np.argsort(apart, axis=1, kind="stable")
                first = np.zeros(apart.shape, bool)
                np.put_along_axis(first, order[:, :probes], True, axis=1)
                least = batch.column(2).to_numpy(zero_copy_only=False).astype(float)
                wanted = ~first & (np.cos(np.minimum(apart, np.pi)) >= least[:, None] - _SLACK) if more else first
                q, cell = np.nonzero(wanted & np.isfinite(apart))
                yield pa.RecordBatch.from_arrays([pa.array(cell, pa.int32()), batch.column(0).take(pa.array(q)), pa.array([x[i].tobytes() for i in q], pa.binary()), pa.array(least[q])], names=["cell", "id", "v", "least"])

        return cut(rows.select("id", "v", "least").mapInArrow(visit, "cell int, id bigint, v binary, least double"), "visits")

    def scored(found: DataFrame) -> DataFrame:
        # merged, never broadcast: files of vectors that repeat are small and pass for small tables
        sizes = found.groupBy("cell").agg(F.ceil(F.count("*") / PACK).alias("packs"))
        packs = found.join(sizes.hint("merge"), "cell").groupBy("cell", F.pmod(F.xxhash64("id"), F.col("packs")).alias("pack")).agg(F.collect_list(F.struct("id", "v", "least")).alias("asked"))

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for ids, vectors, asked in zip(batch.column(0), batch.column(1), batch.column(2)):
                    y = np.frombuffer(vectors.as_buffer()).reshape(-1, size)
                    rows = asked.values
                    q = np.frombuffer(b"".join(rows.field("v").to_pylist())).reshape(-1, size)
                    least, doc = rows.field("least").to_numpy(zero_copy_only=False), ids.values.to_numpy()
                    s = np.round(q @ y.T, DIGITS)
                    at = np.lexsort((np.broadcast_to(doc, s.shape), -s), axis=1)
                    at = at[:, :k]
                    best = np.take_along_axis(s, at, axis=1)
                    keep = best >= np.round(least, DIGITS)[:, None] - _SLACK
                    i, j = np.nonzero(keep)
                    yield pa.RecordBatch.from_arrays([rows.field("id").take(pa.array(i)), pa.array(doc[at[i, j]]), pa.array(best[i, j])], names=["query_id", "doc_id", "score"])

        return cut(index.blocks.join(packs.hint("merge"), "cell").select("ids", "vectors", "asked").mapInArrow(score, _FOUND), "scores")

    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "doc_id")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    near = visits(asked.withColumn("least", F.lit(-2.0)), False)
    first = scored(near)
    kth = ranked(first).filter(F.col("rank") == k).select(F.col("query_id").alias("id"), F.col("score").alias("least"))
    far = visits(asked.join(kth.hint("merge"), "id", "left").withColumn("least", F.coalesce("least", F.lit(-2.0))), True)
    cells = near.unionByName(far).groupBy(F.col("id").alias("query_id")).agg(F.count_distinct("cell").alias("cells"))
    return ranked(first.unionByName(scored(far))).join(cells.hint("merge"), "query_id").select("query_id", "rank", "doc_id", "score", "cells")


def contexts(found: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, context): of ``nearest``, the texts of documents (doc_id, text, payload) as numbered
    sources in order of rank, titled by page, else file; what has no text is left out."""
    title = F.coalesce(F.col("payload")["pageTitle"], F.col("payload")["filePath"], F.lit("Unknown Source"))
    block = F.concat(F.lit("Source ["), F.col("rank").cast("string"), F.lit("]: "), title, F.lit("\n"), "text", F.lit("\n---\n"))
    rows = found.join(documents, "doc_id").filter("text is not null").groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", block.alias("block")))).alias("b"))
    return rows.select("query_id", F.array_join("b.block", "").alias("context"))

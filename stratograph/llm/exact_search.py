"""Exact top-k search by inner product, with a table of distances to pivots.

Distances of every vector to the pivots are worked out once.  By the triangle inequality the
largest difference of a query's and a candidate's distances bounds their own distance from
below, and with their norms their inner product from above (the origin is a pivot, so this is
never worse than the product of the norms).  Vectors lie sorted by pivot and distance: runs of
them are bounded together first, what is left one by one, and exact products are taken in the
order of the bounds until the next bound is below the k-th best product found.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_arrow, col, drop_path, partitions, scratch, unit, written
from .vectors import distances, integers, lengths, products


@dataclass(frozen=True)
class Settings:
    """k: results of a query; scale: of components before they become integers; pivots: in the
    table, with the origin; sample: vectors among which pivots are chosen, and whose products give
    a query's first threshold; queries: searched in one pass, about; run: vectors bounded together;
    step: products taken before the bounds are looked at again."""

    k: int = 10
    scale: float = 1024.0
    pivots: int = 32
    sample: int = 2048
    queries: int = 4096
    run: int = 256
    step: int = 64


#: Rounding of single-precision distances, relative to them, and of products, to the norms.
_SLACK, _ROUNDING = np.float32(5e-7), 1e-12
_FOUND = "dim int, query bigint, query_id bigint, vec_id bigint, score bigint"


def top_k(vectors: DataFrame, is_query: Column, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the k best inner products of every query.

    ``is_query`` tells by ``vec_id`` which rows are queries; candidates are all rows but the
    query's own.  Components become integers floor(scale * component).  Ranks count from 1, ties
    go to the smaller vec_id, a null one last; with fewer candidates all are returned.  Vectors
    that are null or hold null or non-finite numbers take no part, nor do those with integers so
    large that a product might not fit a long (beyond 2^27, at 64 numbers).  Vectors of other
    lengths are no candidates; each length is searched on its own, one after another.  Rows that
    share an id count as rows each, queries and candidates alike.  No queries or an empty table
    give no rows.  Other columns are ignored.
    """
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vec_col).cast("array<double>").alias("v")).filter("v is not null")
    rows = rows.select("vec_id", "v", F.coalesce(is_query, F.lit(False)).alias("asks"))
    found, dims = scratch(vectors.sparkSession, "found"), rows.groupBy(F.size("v").alias("dim")).agg(F.count("*").alias("n"), F.count_if("asks").alias("asked"))
    for dim, n, _ in dims.filter("asked > 0 and n > 1").orderBy("dim").collect():
        _search(rows.filter(F.size("v") == dim), n, dim, settings, found)
    spark = vectors.sparkSession
    spark.range(0).selectExpr("int(id) dim", "id query", "id query_id", "id vec_id", "id score").write.mode("append").parquet(found)
    best = spark.read.schema(_FOUND).parquet(found)
    order = Window.partitionBy("dim", "query").orderBy(F.desc("score"), F.asc_nulls_last("vec_id"))
    best = best.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= settings.k)
    out = written(best.select("query_id", "rank", "vec_id", "score"), "nearest")
    drop_path(spark, found)
    return out


def _pivots(x: np.ndarray, most: int) -> np.ndarray:
    """The origin and vectors of ``x``, each the farthest from those before it."""
    out = [np.zeros(x.shape[1], np.int64)]
    near = (x.astype(np.float64) ** 2).sum(axis=1)
    while len(out) < most and near.max(initial=0) > 0:
        out.append(x[near.argmax()])
        near = np.minimum(near, ((x - out[-1]).astype(np.float64) ** 2).sum(axis=1))
    return np.stack(out)


def _matrix(column: pa.Array, dim: int, kind) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(column), dim)


def _search(rows: DataFrame, n: int, dim: int, s: Settings, path: str) -> None:
    """Appends to ``path`` the candidates that may be among the best of a query, k a task at most."""
    spark = rows.sparkSession
    some = rows.select("vec_id", "v", unit("sample", F.col("vec_id"), F.col("v")).alias("u")).filter(F.col("u") < min(1.0, 4 * s.sample / n))
    some = some.orderBy("u", "vec_id").limit(s.sample).select("vec_id", "v").toArrow().combine_chunks()
    at, sample = integers(_chunk(some["v"]), dim, s.scale)
    sample_ids = _chunk(some["vec_id"]).take(pa.array(at)).to_pylist()
    pivots = _pivots(sample, s.pivots)
    p = len(pivots)

    def measure(batches):
        own: dict = {}
        for i, x in zip(sample_ids, sample):
            own.setdefault((i, x.tobytes()), len(own))
        for batch in batches:
            at, x = integers(batch.column(1), dim, s.scale)
            if not len(at):
                continue
            far = np.sqrt(distances(x, pivots))
            cell = far[:, 1:].argmin(axis=1) if p > 1 else np.zeros(len(x), np.int64)
            ids, asks = batch.column(0).take(pa.array(at)), batch.column(2).take(pa.array(at)).to_numpy(zero_copy_only=False)
            least: list[int | None] = [None] * len(x)
            for i in np.flatnonzero(asks):
                scores = np.sort(products(x[i : i + 1], sample)[0])[::-1]
                if (ids[int(i)].as_py(), x[i].tobytes()) in own:  # it may be its own row that the sample holds
                    scores = np.delete(scores, np.flatnonzero(scores == (x[i] * x[i]).sum())[:1])
                least[i] = int(scores[s.k - 1]) if len(scores) >= s.k else -(1 << 63)
            arrays = [ids, pa.array(cell, pa.int32()), pa.array(far[np.arange(len(x)), np.minimum(cell + 1, p - 1)])]
            arrays += [_lists(x.astype(np.int32), pa.int32()), _lists(far.astype(np.float32), pa.float32()), pa.array(least, pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cell", "near", "x", "far", "least"])

    measured, sorted_by_pivot = scratch(spark, "measured"), scratch(spark, "pivot-table")
    by_arrow(rows, measure, "vec_id bigint, cell int, near double, x array<int>, far array<float>, least bigint").write.parquet(measured)
    dealt = spark.read.parquet(measured).repartitionByRange(partitions(spark), "cell", "near", "vec_id").sortWithinPartitions("cell", "near")
    dealt.select(F.monotonically_increasing_id().alias("row"), "vec_id", "x", "far", "least").write.parquet(sorted_by_pivot)
    drop_path(spark, measured)
    table = spark.read.parquet(sorted_by_pivot)
    asked = table.filter("least is not null")
    passes = -(-asked.count() // s.queries)
    for i in range(passes):
        q = asked.filter(F.pmod(F.xxhash64("row"), F.lit(passes)) == i).toArrow().combine_chunks()
        ids, x, far = _chunk(q["vec_id"]), _matrix(_chunk(q["x"]), dim, np.int64), _matrix(_chunk(q["far"]), p, np.float32)
        shared = spark.sparkContext.broadcast((q["row"].to_numpy(), ids, x, far, q["least"].to_numpy()))

        def search(batches):
            row, ids, x, far, least = shared.value
            best = [_Best(row[j], x[j], far[j], int(least[j]), s) for j in range(len(row))]
            for batch in batches:
                if batch.num_rows:
                    _look(batch, best, far, dim, p, s)
            k = np.array([len(b.scores) for b in best], np.int64)
            of = np.repeat(np.arange(len(best)), k)
            arrays = [pa.array(np.full(len(of), dim), pa.int32()), pa.array(row[of]), ids.take(pa.array(of)), pa.array([v for b in best for v in b.ids], pa.int64()), pa.array([v for b in best for v in b.scores], pa.int64())]
            yield pa.RecordBatch.from_arrays(arrays, names=["dim", "query", "query_id", "vec_id", "score"])

        by_arrow(table.select("row", "vec_id", "x", "far"), search, _FOUND).write.mode("append").parquet(path)
        shared.unpersist()
    drop_path(spark, sorted_by_pivot)


class _Best:
    """The best candidates of a query that a task has seen so far."""

    def __init__(self, row: int, x: np.ndarray, far: np.ndarray, least: int, s: Settings):
        self.row, self.x, self.far, self.k, self.least = row, x, far, s.k, least
        self.norm = float((x * x).sum())
        self.ids: list[int | None] = []
        self.scores: list[int] = []

    def add(self, ids: list[int | None], scores: list[int]) -> None:
        both = sorted(zip([*self.scores, *scores], [*self.ids, *ids]), key=lambda b: (-b[0], b[1] is None, b[1] or 0))[: self.k]
        self.scores, self.ids = [b[0] for b in both], [b[1] for b in both]
        if len(both) == self.k:
            self.least = max(self.least, both[-1][0])


def _look(batch: pa.RecordBatch, best: list[_Best], asked: np.ndarray, dim: int, p: int, s: Settings) -> None:
    """Takes what a batch of the pivot table has for the queries, whose distances are ``asked``."""
    row, ids = batch.column(0).to_numpy(), batch.column(1)
    x, far = _matrix(batch.column(2), dim, np.int64), _matrix(batch.column(3), p, np.float32)
    norm = (x * x).sum(axis=1).astype(np.float64)
    first = np.arange(0, len(row), s.run)
    low, high, most = np.minimum.reduceat(far, first), np.maximum.reduceat(far, first), np.maximum.reduceat(norm, first)
    apart = np.zeros((len(best), len(first)), np.float32)
    for i in range(p):
        mine = asked[:, i, None]
        gap = np.maximum(low[:, i] - mine, mine - high[:, i]) - _SLACK * (high[:, i] + mine)
        np.maximum(apart, gap, out=apart)
    own = np.array([b.norm for b in best])
    bound = _bound(own[:, None], most, apart.astype(np.float64))
    run = np.arange(len(row)) // s.run
    for j in np.flatnonzero((bound >= np.array([b.least for b in best], np.float64)[:, None]).any(axis=1)):
        b = best[j]
        at = np.flatnonzero((bound[j] >= b.least)[run])
        apart_of = (np.abs(far[at] - b.far) - _SLACK * (far[at] + b.far)).max(axis=1)
        bounds = _bound(b.norm, norm[at], np.maximum(apart_of, 0).astype(np.float64))
        keep = np.flatnonzero((bounds >= b.least) & (row[at] != b.row))
        keep = keep[np.argsort(-bounds[keep], kind="stable")]
        at, bounds, a = at[keep], bounds[keep], 0
        while a < len(at) and bounds[a] >= b.least:
            now = at[a : a + s.step]
            scores = products(x[now], b.x[None])[:, 0]
            good = np.flatnonzero(scores >= b.least)
            if len(good):
                b.add(ids.take(pa.array(now[good])).to_pylist(), scores[good].tolist())
            a += s.step


def _bound(a: np.ndarray, b: np.ndarray, apart: np.ndarray) -> np.ndarray:
    """The most that the inner product of vectors of square norms a and b can be that far apart."""
    return (a + b - apart * apart) / 2 + _ROUNDING * (a + b) + 1e-6


def _lists(x: np.ndarray, kind: pa.DataType) -> pa.Array:
    offsets = np.arange(len(x) + 1, dtype=np.int32) * x.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel(), kind))


def _chunk(column: pa.ChunkedArray) -> pa.Array:
    found = column.combine_chunks()
    return found if isinstance(found, pa.Array) else pa.concat_arrays(found.chunks)

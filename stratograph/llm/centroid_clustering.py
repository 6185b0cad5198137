"""Centroid clustering by delta Lloyd, in exact integers.

Vectors are packed in blocks, once, into a table in buckets of the block's number; the owners
and distances of a block's vectors are persisted in a table in the same buckets, so a round
moves no vectors.  A round compares the vectors of an unmoved owner with the centroids that
changed and the others with all; a vector that changes its owner gives a signed transfer, taken
from one sum and added to another, and only the transfers, summed per task, are shuffled.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Bucketed, bucketed, by_arrow, col, local_rows, written
from .vectors import distances, integers, narrow


@dataclass(frozen=True)
class Settings:
    """k: centroids; rounds: of Lloyd; dim: length of the vectors kept; scale: of components
    before they become integers; seed: of the draw of first centroids; block: vectors packed together."""

    k: int = 16
    rounds: int = 3
    dim: int = 64
    scale: float = 64.0
    seed: str = "1"
    block: int = 4096


_PACKED = "ids array<bigint>, width int, x binary"
_STATE = "block bigint, owners binary, distances binary, cluster int, moved array<bigint>, inertia decimal(38,0)"


def cluster(vectors: DataFrame, settings: Settings = Settings(), id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256), one per vector kept.

    Kept are vectors of ``settings.dim`` numbers, none null or non-finite, as integers
    floor(scale * component); left out besides are those whose squared distances would not fit
    a long (components beyond 2^27 after scaling, at 64 numbers).  The first centroids are the
    vectors with the smallest sha256 of ``seed:vec_id``; equal ids go by their components, null
    ids come last.  Fewer vectors than ``k`` make fewer centroids.  Ties of distance go to the
    smaller number; a centroid without vectors stays.  Repeated rows count each; no kept
    vectors give no rows.  An inertia beyond the range of a long is null.
    """
    spark, s = vectors.sparkSession, settings
    rows = vectors.select(col(id_col).cast("long").alias("id"), col(vec_col).cast("array<double>").alias("v"))

    def pack(batches):
        for batch in batches:
            at, x = integers(batch.column(1), s.dim, s.scale)
            ids = batch.column(0).take(pa.array(at))
            for a in range(0, len(at), s.block):
                part = narrow(x[a : a + s.block])
                one = pa.ListArray.from_arrays(pa.array([0, len(part)], pa.int32()), ids[a : a + s.block])
                yield pa.RecordBatch.from_arrays([one, pa.array([part.itemsize], pa.int32()), pa.array([part.tobytes()], pa.binary())], names=["ids", "width", "x"])

    blocks = bucketed(by_arrow(rows, pack, _PACKED).withColumn("block", F.monotonically_increasing_id()), "block", "vectors")
    centroids = _first(blocks.rows, s)
    sums = np.zeros((len(centroids), s.dim + 1), object)  # of components, and the number of vectors
    state, changed = None, np.ones(len(centroids), bool)
    for done in range(s.rounds + 1):
        before, state = state, _assigned(blocks.rows, state, centroids, changed, s)
        if before is not None:
            before.drop()
        if done == s.rounds:
            break
        for r in state.rows.filter("cluster is not null").select("cluster", F.posexplode("moved")).groupBy("cluster", "pos").agg(F.sum("col").alias("sum")).collect():
            sums[r["cluster"], r["pos"]] += r["sum"]
        new = np.array([[int(v) // int(row[-1]) for v in row[:-1]] if row[-1] else old for row, old in zip(sums, centroids.tolist())], np.int64).reshape(centroids.shape)
        changed = (new != centroids).any(axis=1)
        centroids = new
        if not changed.any():
            break
    inertia = {r["cluster"]: int(r["sum"]) for r in state.rows.filter("cluster is not null").groupBy("cluster").agg(F.sum("inertia").alias("sum")).collect()}
    total = sum(inertia.values())
    about = [{"cluster": i, "cluster_inertia": _long(inertia.get(i, 0)), "inertia": _long(total), "centroid_sha256": hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()} for i, c in enumerate(centroids.tolist())]

    def unpack(batches):
        for batch in batches:
            for ids, owners, far in zip(*(batch.column(i) for i in range(3))):
                arrays = [ids.values, pa.array(np.frombuffer(owners.as_buffer(), "<i4")), pa.array(np.frombuffer(far.as_buffer(), "<i8"))]
                yield pa.RecordBatch.from_arrays(arrays, names=["vec_id", "cluster", "distance"])

    held = blocks.rows.select("block", "ids").join(state.rows.filter("block is not null").select("block", "owners", "distances"), "block")
    found = by_arrow(held.select("ids", "owners", "distances"), unpack, "vec_id long, cluster int, distance long")
    about = local_rows(spark, about, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    out = written(found.join(F.broadcast(about), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"), "clusters")
    blocks.drop()
    state.drop()
    return out


def _long(x: int) -> int | None:
    return x if x < 1 << 63 else None


def _matrix(width, x, dim: int) -> np.ndarray:
    return np.frombuffer(x.as_buffer(), f"<i{width.as_py()}").reshape(-1, dim).astype(np.int64)


def _first(blocks: DataFrame, s: Settings) -> np.ndarray:
    """The k vectors of the smallest hashes of their ids; each task gives k at most."""

    def smallest(batches):
        best: list[tuple[str, list[int]]] = []
        for batch in batches:
            for ids, width, x in zip(*(batch.column(i) for i in range(3))):
                x = _matrix(width, x, s.dim)
                hashes = [hashlib.sha256(f"{s.seed}:{i}".encode()).hexdigest() if i is not None else "null" for i in ids.as_py()]
                most = best[-1][0] if len(best) == s.k else "~"
                best = sorted(best + [(h, x[i].tolist()) for i, h in enumerate(hashes) if h <= most])[: s.k]
        yield pa.RecordBatch.from_arrays([pa.array([h for h, _ in best], pa.string()), pa.array([x for _, x in best], pa.list_(pa.int64()))], names=["h", "x"])

    found = by_arrow(blocks.select("ids", "width", "x"), smallest, "h string, x array<bigint>").orderBy("h", "x").limit(s.k).collect()
    return np.array([r["x"] for r in found], np.int64).reshape(len(found), s.dim)


def _assigned(blocks: DataFrame, state: Bucketed | None, centroids: np.ndarray, changed: np.ndarray, s: Settings) -> Bucketed:
    """The next state: a row for each block, and rows (cluster, moved, inertia) for what each task moved.

    moved: signed sums of the components and of the number of vectors that came or went."""
    k = len(centroids)
    numbers = np.flatnonzero(changed)

    def assign(batches):
        moved, inertia = np.zeros((k, s.dim + 1), np.int64), [0] * k
        for batch in batches:
            for row in zip(*(batch.column(i) for i in range(batch.num_columns))):
                x = _matrix(row[1], row[2], s.dim)
                if len(row) == 3:
                    old = None
                    far = distances(x, centroids)
                    owner = far.argmin(axis=1).astype(np.int32)
                    far = far[np.arange(len(x)), owner]
                else:
                    old = np.frombuffer(row[3].as_buffer(), "<i4")
                    owner, far = old.copy(), np.frombuffer(row[4].as_buffer(), "<i8").copy()
                    for at, wanted in ((np.flatnonzero(changed[old]), np.arange(k)), (np.flatnonzero(~changed[old]), numbers)):
                        if len(at) and len(wanted):
                            some = distances(x[at], centroids[wanted])
                            near = some.argmin(axis=1)
                            some, near = some[np.arange(len(at)), near], wanted[near]
                            if len(wanted) < k:  # the owner stood still: it keeps what is not nearer to another
                                better = (some < far[at]) | ((some == far[at]) & (near < owner[at]))
                                at, some, near = at[better], some[better], near[better]
                            owner[at], far[at] = near, some
                gone = np.arange(len(x)) if old is None else np.flatnonzero(owner != old)
                for c in np.unique(np.concatenate((owner[gone], owner[:0] if old is None else old[gone]))):
                    came = x[gone[owner[gone] == c]]
                    moved[c, :-1] += came.sum(axis=0)
                    moved[c, -1] += len(came)
                    if old is not None:
                        went = x[gone[old[gone] == c]]
                        moved[c, :-1] -= went.sum(axis=0)
                        moved[c, -1] -= len(went)
                for c in np.unique(owner):
                    mine = far[owner == c]
                    inertia[c] += int((mine >> 31).sum() << 31) + int((mine & 0x7FFFFFFF).sum())
                kinds = [pa.int64(), pa.binary(), pa.binary(), pa.int32(), pa.list_(pa.int64()), pa.decimal128(38, 0)]
                values = [row[0].as_py(), owner.astype("<i4").tobytes(), far.astype("<i8").tobytes(), None, None, None]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, kinds)], names=_NAMES)
        at = [c for c in range(k) if inertia[c] or moved[c].any()]
        arrays = [pa.nulls(len(at), pa.int64()), pa.nulls(len(at), pa.binary()), pa.nulls(len(at), pa.binary()), pa.array(at, pa.int32())]
        arrays += [pa.array([moved[c].tolist() for c in at], pa.list_(pa.int64())), pa.array([inertia[c] for c in at], pa.decimal128(38, 0))]
        yield pa.RecordBatch.from_arrays(arrays, names=_NAMES)

    rows = blocks.select("block", "width", "x")
    if state is not None:
        rows = rows.join(state.rows.filter("block is not null").select("block", "owners", "distances"), "block")
    return bucketed(by_arrow(rows, assign, _STATE), "block", "owners", dealt=True)


_NAMES = ["block", "owners", "distances", "cluster", "moved", "inertia"]

"""Near-duplicate vectors by an exact metric range join.

Equal vectors collapse first.  Pivots then partition the rest into cells by angle, which is a
metric; the triangle inequality tells which other cells a vector can have neighbours in, and
it is copied to those alone.  Large cells are split into blocks, and each block joins its own
vectors with each other and with its visitors, counting links without listing pairs.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_arrow, col, components, written

#: Vectors of a cell aimed at, pivots at most, and, for vectors of 64 numbers, vectors of a
#: block and visitors of a task; of longer vectors so many fewer.
CELL, MOST_PIVOTS, NATIVES, VISITORS = 2048, 1024, 4096, 65536
_SLACK = 1e-7
_PACK = "cell int, block int, chunk int, native boolean, wide boolean, ids binary, weights binary, rows binary"


def _unit(column: pa.Array, dim: int) -> np.ndarray:
    """The vectors of a list column, scaled to length 1."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def _blocks_of(ids: np.ndarray, parts: np.ndarray) -> np.ndarray:
    h = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    return ((h >> np.uint64(33)) % parts.astype(np.uint64)).astype(np.int64)


def _min_labels(near: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Smallest label within reach over the links near[i, j] between a[i] and b[j]."""
    far = np.iinfo(np.int64).max
    while True:
        a2 = np.minimum(a, np.where(near, b[None, :], far).min(axis=1))
        b2 = np.minimum(b, np.where(near, a2[:, None], far).min(axis=0))
        if (a2 == a).all() and (b2 == b).all():
            return a, b
        a, b = a2, b2


def links(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one per row of ``vectors``.

    Two vectors link when their cosine, in double precision, is at least ``threshold`` (above
    0).  n_links counts the other rows linked; component_id is the smallest vec_id reachable;
    kept says vec_id = component_id. Vectors that are null, zero or hold null or non-finite
    numbers link with nothing; those of different lengths do not link with each other, and each
    length is joined on its own, one after another. Rows that share a vec_id count as rows each
    and are one node. A null vec_id links with nothing and has no component. An empty table
    gives no rows.
    """
    spark = vectors.sparkSession
    base = vectors.select(col(id_col).cast("long").alias("vec_id"), col(vec_col).cast("array<double>").alias("v"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    usable = F.col("v").isNotNull() & F.col("vec_id").isNotNull() & finite & F.exists("v", lambda x: x != 0)
    base = base.withColumn("ok", F.coalesce(usable, F.lit(False)))
    v = F.transform("v", lambda x: x + F.lit(0.0))
    rows = base.select("vec_id", "v", "ok")
    rows = rows.select("vec_id", F.when(F.col("ok"), v).alias("v"), F.when(F.col("ok"), F.xxhash64(v)).alias("h1"), F.when(F.col("ok"), F.xxhash64(F.reverse(v))).alias("h2"))
    classes = rows.filter("h1 is not null").groupBy("h1", "h2").agg(F.min("vec_id").alias("rep"), F.count("*").alias("w"), F.first("v").alias("v"))
    classes = written(classes.withColumn("class", F.monotonically_increasing_id()), "vectors")  # numbers that the write fixes
    keys = rows.select("vec_id", "h1", "h2")
    found = spark.createDataFrame([], "id long, links long, label long")
    for dim, n in classes.groupBy(F.size("v").alias("d")).count().filter("count > 1").orderBy("d").collect():
        found = found.unionByName(_joined(classes.filter(F.size("v") == dim), n, dim, threshold))
    found = written(found, "links")
    counts = found.groupBy("id").agg(F.sum("links").alias("links"))
    mapped = written(keys.filter("h1 is not null").join(classes.select("h1", "h2", "class"), ["h1", "h2"]).select("vec_id", "class").distinct(), "classes")
    several = mapped.groupBy("vec_id").agg(F.min("class").alias("lo"), F.max("class").alias("hi")).filter("lo <> hi").select("vec_id", "lo")
    ties = mapped.join(several, "vec_id").select(F.col("class").alias("a"), F.col("lo").alias("b"))  # ids of several vectors
    reached = components(found.select(F.col("id").alias("a"), F.col("label").alias("b")).unionByName(ties))

    home = classes.select("class", "rep").join(reached, F.col("class") == F.col("node"), "left").select("class", "rep", F.coalesce("component", "class").alias("home"))
    least = home.groupBy("home").agg(F.min("rep").alias("component"))
    of_id = mapped.join(home.join(least, "home").select("class", "component"), "class").groupBy("vec_id").agg(F.min("component").alias("component"))
    info = classes.select("h1", "h2", "class", "w").join(counts, F.col("class") == F.col("id"), "left")
    info = info.select("h1", "h2", (F.coalesce("links", F.lit(0)) + F.col("w") - 1).alias("n_links"))
    out = keys.join(info, ["h1", "h2"], "left").join(of_id, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select(
        "vec_id",
        F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        component.alias("component_id"),
        F.coalesce(F.col("vec_id") == component, F.lit(False)).alias("kept"),
    )


def _joined(classes: DataFrame, n: int, dim: int, threshold: float) -> DataFrame:
    """Rows (id, links, label): links of classes of equal vectors, weighted by their sizes, and
    labels that connect them; a label that fell is tied to the lower one by a row of no links."""
    reach = float(np.arccos(min(1.0, threshold)))
    picked = classes.orderBy(F.xxhash64("h1", F.lit("pivot")), "h1", "h2").limit(int(min(MOST_PIVOTS, -(-n // CELL)))).select("v").toArrow()
    pivots = _unit(picked["v"].combine_chunks(), dim)
    m = len(pivots)

    def angles(x):
        return np.arccos(np.clip(x @ pivots.T, -1.0, 1.0))

    def measure(batches):
        count, radius = np.zeros(m, np.int64), np.zeros(m)
        for batch in batches:
            if batch.num_rows:
                a = angles(_unit(batch.column(0), dim))
                cell = a.argmin(axis=1)
                count += np.bincount(cell, minlength=m)
                np.maximum.at(radius, cell, a[np.arange(len(cell)), cell])
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(m)), pa.array(count), pa.array(radius)], names=["cell", "n", "radius"])

    sizes = by_arrow(classes.select("v"), measure, "cell long, n long, radius double")
    sizes = sizes.groupBy("cell").agg(F.sum("n").alias("n"), F.max("radius").alias("radius")).orderBy("cell").toArrow()
    radius = sizes["radius"].to_numpy()
    longer = max(1, dim // 64)
    parts = np.maximum(1, -(-sizes["n"].to_numpy() // max(1, NATIVES // longer)))
    chunks = -(-n // max(1, VISITORS // longer))

    def deal(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, weights = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            x = _unit(batch.column(2), dim)
            raw = batch.column(2).flatten().to_numpy(zero_copy_only=False).astype("<f8").reshape(-1, dim)
            short = raw.astype("<f4")
            wide = bool((short != raw).any())  # numbers that were single precision travel as such
            raw = raw if wide else short
            a = angles(x)
            cell = a.argmin(axis=1)
            own = a[np.arange(len(cell)), cell]
            block, chunk = _blocks_of(ids, parts[cell]), _blocks_of(ids ^ 0x5555, np.full(len(ids), chunks))
            out = []

            def pack(c, b, k, native, at):
                out.append((c, b, k, native, wide, ids[at].astype("<i8").tobytes(), weights[at].astype("<i8").tobytes(), raw[at].tobytes()))

            for c in range(m):
                visits = (c > cell) & (a[:, c] <= radius[c] + reach + _SLACK) & (a[:, c] - own <= 2 * reach + _SLACK)
                for b in range(int(parts[c])):
                    home = np.flatnonzero((cell == c) & (block == b))
                    if len(home):
                        for k in range(chunks):
                            pack(c, b, k, True, home)
                    come = visits | ((cell == c) & (block < b))
                    for k in range(chunks):
                        at = np.flatnonzero(come & (chunk == k))
                        if len(at):
                            pack(c, b, k, False, at)
            kinds = [pa.int32(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_(), pa.binary(), pa.binary(), pa.binary()]
            names = ["cell", "block", "chunk", "native", "wide", "ids", "weights", "rows"]
            yield pa.RecordBatch.from_arrays([pa.array(list(x), t) for x, t in zip(zip(*out), kinds)], names=names)

    def side(table, native):
        part = table.filter(pa.compute.equal(table["native"], native))

        def joined(name, kind):
            return np.frombuffer(b"".join(x.as_buffer() for x in part[name]), kind)

        ids, weights = joined("ids", "<i8"), joined("weights", "<i8")
        x = [np.frombuffer(r.as_buffer(), "<f8" if w else "<f4").astype(np.float64) for r, w in zip(part["rows"], part["wide"].to_pylist())]
        x = np.concatenate([np.zeros(0), *x]).reshape(-1, dim)
        if len(x):
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = x / np.sqrt((x * x).sum(axis=1, keepdims=True))
        return ids, weights, x

    def join(table: pa.Table) -> pa.Table:
        import pyarrow.compute  # noqa: F401

        ids, w, x = side(table, True)
        label, count = ids.copy(), np.zeros(len(ids), np.int64)
        others, other_w, y = side(table, False)
        other_label, other_count = others.copy(), np.zeros(len(others), np.int64)
        step, falls = 1024, []

        def lower(near, mine, rows, theirs, hit):
            """Lowers the labels of linked vectors and keeps which older label each new one belongs with."""
            old = np.concatenate((mine[rows], theirs[hit]))
            mine_new, theirs_new = _min_labels(near, mine[rows], theirs[hit])
            fell = np.stack((old, np.concatenate((mine_new, theirs_new))), axis=1)
            falls.append(np.unique(fell[fell[:, 0] != fell[:, 1]], axis=0))
            mine[rows] = mine_new
            theirs[hit] = np.minimum(theirs_new, theirs[hit])

        if table["chunk"][0].as_py() == 0:
            for i in range(0, len(ids), step):
                near = x[i : i + step] @ x[i:].T >= threshold
                inside = near[:, : min(step, len(ids) - i)]
                np.fill_diagonal(inside, False)
                some = near.any(axis=1)
                if some.any():
                    count[i : i + step] += near @ w[i:]
                    beyond = near[:, inside.shape[1] :]
                    count[i + inside.shape[1] :] += w[i : i + step] @ beyond
                    hit = np.flatnonzero(near.any(axis=0)) + i
                    rows = np.flatnonzero(some) + i
                    lower(near[np.ix_(rows - i, hit - i)], label, rows, label, hit)
        for i in range(0, len(others) if len(ids) else 0, step):
            near = y[i : i + step] @ x.T >= threshold
            rows = np.flatnonzero(near.any(axis=1))
            if len(rows):
                other_count[i + rows] += near[rows] @ w
                count += other_w[i + rows] @ near[rows]
                hit = np.flatnonzero(near.any(axis=0))
                lower(near[np.ix_(rows, hit)], other_label, i + rows, label, hit)
        ids, count, label = (np.concatenate(p) for p in ((ids, others), (count, other_count), (label, other_label)))
        linked = count > 0
        fell = np.concatenate([np.zeros((0, 2), np.int64), *falls])
        ids, count, label = np.append(ids[linked], fell[:, 0]), np.append(count[linked], np.zeros(len(fell), np.int64)), np.append(label[linked], fell[:, 1])
        return pa.table({"id": ids, "links": count, "label": label})

    packed = by_arrow(classes.select("class", "w", "v"), deal, _PACK)
    return packed.groupBy("cell", "block", "chunk").applyInArrow(join, "id long, links long, label long")

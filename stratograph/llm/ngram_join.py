"""N-gram Jaccard join by grouped prefixes.

A document is its set of word n-grams.  Equal sets collapse; a set's n-grams are ordered
rarest first, and sets with the same prefix and size collapse into one group.  Groups that
share a prefix token at places that leave room for enough overlap are candidates, and must share MORE
tokens of prefixes that are so much longer; the groups expand to their members, whose whole
sets are compared.  Candidates are first tried as stars around one member of each token and
size band; only tokens whose members then still lie in different components are tried pair by
pair, so a crowd of near copies costs a comparison or two each.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import by_arrow, col, components, drop_path, fresh, local_rows, release, written
from .exchange import Block, mixed, summed
from .substring_dedup import Words

#: Bytes of text handled at a time, and bytes of text for each counter.
PIECE, BYTES_PER_COUNTER = 1 << 19, 256
#: Tokens that similar sets share at least in prefixes that are longer by one less: sets with
#: an overlap of o share k tokens of their first size - o + k, for any k up to o.
MORE = 4

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def pieces(column: pa.Array):
    """(first, block) of runs of texts of about PIECE bytes, A-Z lower-cased; null is empty."""
    column = pa.array(column.to_pylist(), pa.binary()) if column.offset else column
    column = pc.fill_null(column, b"")
    n = len(column)
    if not n:
        return
    ends = np.frombuffer(column.buffers()[1], np.int32, n + 1).astype(np.int64)
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    first = 0
    while first < n:
        last = max(first + 1, int(np.searchsorted(ends, ends[first] + PIECE, "right")) - 1)
        block = Block.__new__(Block)
        block.ids = np.arange(first, min(last, n))
        block.ends = ends[first : min(last, n) + 1] - ends[first]
        block.data = _LOWER[data[ends[first] : ends[min(last, n)]]]
        yield first, block
        first = last


def _shingles(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, name) of the n-grams of a block's texts; shorter texts are one n-gram whole."""
    words = Words(block, lanes=1)
    if not words.n:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    at = np.arange(words.n)
    end = words.ends[words.text + 1]
    size = end - words.ends[words.text]
    whole = (at + n <= end) | ((size < n) & (at == words.ends[words.text]))
    first = at[whole]
    return words.text[first], words.name(first, np.minimum(first + n, end[first]))


def _sets(block: Block, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The same without repeats, in order of row and name."""
    row, name = _shingles(block, n)
    order, equal = _sorted(row, len(block.ids), name)
    new = np.append(True, ~equal)[: len(row)]
    return row[order][new], name[order][new]


def _sorted(row: np.ndarray, rows: int, name: np.ndarray, code: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(order, equal): an order by row, code (10 bits) and name, and whether each equals the next.

    The sort key is one number of as many bits of each as fit; where they do not tell unlike
    names apart, all are sorted in full."""
    shift = np.uint64(rows.bit_length())
    key = name
    if code is not None:
        key = (code << np.uint64(54)) | (name >> np.uint64(10))
    key = (row.astype(np.uint64) << (np.uint64(64) - shift)) | (key >> shift)
    order = np.argsort(key)
    k, x = key[order], name[order]
    same = k[1:] == k[:-1]
    equal = same & (x[1:] == x[:-1])
    if (same & ~equal).any():
        order = np.lexsort((name, row) if code is None else (name, code, row))
        r, x = row[order], name[order]
        equal = (r[1:] == r[:-1]) & (x[1:] == x[:-1])
    return order, equal


def _rarity(count: np.ndarray) -> np.ndarray:
    """A count's size in sixteenths of powers of two, alike on every machine: 10 bits."""
    m, e = np.frexp(count.astype(np.float64) + 1)
    return (e * 16 + ((m - 0.5) * 32).astype(np.int64)).astype(np.uint64)


def _set_names(name: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit names of each set, whatever the order of its n-grams; 0 for empty sets."""
    out = np.zeros((2, len(size)), np.uint64)
    some = size > 0
    if some.any():
        start = (np.cumsum(size) - size)[some]
        for k, seed in enumerate((0x9E3779B97F4A7C15, 0xD1342543DE82EF95)):
            out[k, some] = np.add.reduceat(mixed(name + np.uint64(seed)), start)
    return out[0], out[1]


def _frequencies(texts: DataFrame, n: int, counters: int) -> np.ndarray:
    """How often n-grams fall on each counter, over all documents: only the order of a set's
    n-grams rests on it, never a result, so chance clashes do no harm."""

    def count(batches):
        total = np.zeros(counters, np.int64)
        for batch in batches:
            for _, block in pieces(batch.column(0)):
                total += np.bincount((_sets(block, n)[1] & np.uint64(counters - 1)).astype(np.int64), minlength=counters)
        return np.minimum(total, (1 << 32) - 1)

    return summed(texts, count, counters, "<u4")


def _overlap(n_a, n_b, num: int, den: int):
    """The least intersection at which |a & b| / |a | b| >= num / den."""
    return F.ceil((n_a + n_b) * F.lit(num) / F.lit(num + den))


def _spread(pairs: DataFrame, side: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``pairs`` (a, b) and the table ``side`` of their a, both with a salt to join on.

    A set that more than a 1000th of all pairs name is copied as often as it exceeds that, so
    its pairs spread over tasks; there are fewer than 1000 such sets, whatever the input."""
    spark = pairs.sparkSession
    share = max(64, -(-pairs.count() // 1000))
    hot = pairs.groupBy("a").agg(F.count("*").alias("c")).filter(F.col("c") > share).collect()
    hot = local_rows(spark, [{"hot": r["a"], "copies": -(-r["c"] // share)} for r in hot], "hot long, copies int")
    pairs = pairs.join(F.broadcast(hot), F.col("a") == F.col("hot"), "left")
    pairs = pairs.withColumn("salt", F.coalesce(F.pmod(F.xxhash64("b"), F.col("copies")), F.lit(0)).cast("int")).drop("hot", "copies")
    side = side.join(F.broadcast(hot), F.col("a") == F.col("hot"), "left")
    return pairs, side.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("copies", F.lit(1)) - 1))).drop("hot", "copies")


def link_documents(
    docs: DataFrame, n: int = 3, num: int = 90, den: int = 100, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one per document.

    Words are runs of non-white-space with A-Z lower-cased; a set holds the distinct n-word
    shingles of the whole text, or the whole sequence where there are fewer words.  Documents
    link when den * |a & b| >= num * |a | b|; component_id is the smallest doc_id reachable.
    Null texts and texts without words have an empty set and link with nothing.  Equal texts
    collapse before any join.  Rows that share a doc_id are one node; a null doc_id links with
    nothing and has no component; an empty table gives no rows.
    """
    spark = docs.sparkSession
    texts = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").cast("binary").alias("text"))
    total = docs.select(F.sum(F.octet_length(col(text_col).cast("string")))).first()[0] or 0
    counters = 1 << int(min(24, max(20, math.ceil(math.log2(total / BYTES_PER_COUNTER + 1)))))
    frequency = spark.sparkContext.broadcast(_frequencies(texts.select("text"), n, counters))

    def digest(batches):
        for batch in batches:
            for first, block in pieces(batch.column(1)):
                rows = len(block.ids)
                row, name = _sets(block, n)
                size = np.bincount(row, minlength=rows)
                h1, h2 = _set_names(name, size)
                rare = _rarity(frequency.value[(name & np.uint64(counters - 1)).astype(np.int64)])
                order, _ = _sorted(row, rows, name, rare)
                row, name = row[order], name[order]
                start = np.cumsum(size) - size
                keep = np.minimum(size, size - -(-size * num // den) + MORE)
                in_prefix = np.arange(len(row)) - start[row] < keep[row]
                tokens = name[in_prefix].view(np.int64)
                ends = np.append(0, np.cumsum(keep)).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, rows),
                        pa.array(size.astype(np.int64)),
                        pa.array(h1.view(np.int64)),
                        pa.array(h2.view(np.int64)),
                        pa.ListArray.from_arrays(pa.array(ends), pa.array(tokens)),
                    ],
                    names=["doc_id", "n", "h1", "h2", "prefix"],
                )

    sets = written(by_arrow(texts, digest, "doc_id long, n long, h1 long, h2 long, prefix array<long>"), "sets")
    full = sets.filter("n > 0 and doc_id is not null")
    repeated = not full.groupBy("doc_id").count().filter("count > 1").isEmpty()
    nodes = full.groupBy("n", "h1", "h2").agg(F.min("doc_id").alias("node"), F.first("prefix").alias("prefix"))
    nodes = written(nodes, "nodes")
    keys = written(sets.select("doc_id", "n", "h1", "h2"), "keys")  # prefixes are in nodes now
    for path in {f.rsplit("/", 1)[0] for f in sets.inputFiles()}:
        drop_path(spark, path)
    full = keys.filter("n > 0 and doc_id is not null")
    frequency.destroy()
    groups = nodes.withColumn("g1", F.xxhash64("n", "prefix")).withColumn("g2", F.xxhash64(F.reverse("prefix"), "n"))
    groups = groups.select("node", "n", "g1", "g2", "prefix")
    release(spark)
    leaders = groups.groupBy("g1", "g2").agg(F.min("node").alias("leader"), F.first("n").alias("n"), F.first("prefix").alias("prefix"), F.count("*").alias("members"))
    leaders = written(leaders, "groups")

    base = F.col("n") - F.ceil(F.col("n") * num / F.lit(den)) + 1
    at = leaders.select(F.col("leader").alias("node"), "n", F.posexplode(F.slice("prefix", F.lit(1), base.cast("int"))).alias("pos", "token"))
    shared = written(at.groupBy("token").agg(F.count("*").alias("c")).filter("c > 1").select("token"), "shared")
    release(spark)
    at = at.join(shared, "token")
    own = groups.join(leaders.filter("members > 1").select("g1", "g2"), ["g1", "g2"])
    own = own.select((F.col("g1").bitwiseXOR(F.col("g2"))).alias("token"), "node", "n", F.lit(-1).alias("pos"))
    classes = written(at.select("token", "node", "n", "pos").unionByName(own), "classes")
    release(spark)

    def near(a: str, b: str):
        """Sizes, and places of a shared token, at which two sets can be similar."""
        na, nb, i, j = F.col(f"n{a}"), F.col(f"n{b}"), F.col(f"p{a}"), F.col(f"p{b}")
        room = 1 + F.least(na - i - 1, nb - j - 1)
        return (F.least(na, nb) * den >= F.greatest(na, nb) * num) & (room >= _overlap(na, nb, num, den))

    heads = groups.select("node", "n", "prefix")

    def promising(pairs: DataFrame, what: str) -> DataFrame:
        pairs = written(pairs, "candidates")
        release(spark)
        a = heads.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("prefix").alias("x"))
        b = heads.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("prefix").alias("y"))
        pairs, a = _spread(pairs, a)
        rows = pairs.join(a, ["a", "salt"]).join(b, "b")
        least = F.least(F.lit(MORE), _overlap(F.col("na"), F.col("nb"), num, den))
        rows = written(rows.filter(F.size(F.array_intersect("x", "y")) >= least).select("a", "b"), what)
        release(spark)
        return rows

    def whole(batches):
        for batch in batches:
            for first, block in pieces(batch.column(1)):
                rows = len(block.ids)
                row, name = _sets(block, n)
                ends = np.append(0, np.cumsum(np.bincount(row, minlength=rows))).astype(np.int32)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, rows), pa.ListArray.from_arrays(pa.array(ends), pa.array(name.view(np.int64)))],
                    names=["node", "grams"],
                )

    def verified(pairs: DataFrame) -> DataFrame:
        if pairs.isEmpty():
            return pairs
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
        copies = texts.join(wanted, F.col("doc_id") == F.col("node"), "left_semi")
        if repeated:  # a text once for each id; ids with several texts keep them all
            copies = copies.withColumn("h", F.md5("text")).dropDuplicates(["doc_id", "h"]).drop("h")
        grams = written(by_arrow(copies, whole, "node long, grams array<long>"), "grams")
        release(spark)
        a = grams.select(F.col("node").alias("a"), F.col("grams").alias("x"))
        b = grams.select(F.col("node").alias("b"), F.col("grams").alias("y"))
        pairs, a = _spread(pairs, a)
        both = pairs.join(b, "b").join(a, ["a", "salt"])
        common = F.size(F.array_intersect("x", "y"))
        found = written(both.filter(common * F.lit(den + num) >= (F.size("x") + F.size("y")) * F.lit(num)).select("a", "b").distinct(), "links")
        for path in {f.rsplit("/", 1)[0] for f in grams.inputFiles()}:
            drop_path(spark, path)
        release(spark)
        return found

    band = F.floor(F.log(F.col("n").cast("double")) / F.lit(math.log(den / num) if den > num else 1.0))
    by_band = classes.withColumn("band", band)
    stars = by_band.groupBy("token", "band").agg(F.min(F.struct("node", "n", "pos")).alias("lead"), F.count("*").alias("c")).filter("c > 1")
    tried = by_band.join(stars, ["token", "band"]).filter("node <> lead.node")
    tried = tried.select(F.col("lead.node").alias("a"), F.col("lead.n").alias("na"), F.col("lead.pos").alias("pa"), F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    tried = promising(tried.filter(near("a", "b")).select("a", "b").distinct(), "pairs")
    edges = verified(tried)
    reached = components(edges)

    members = groups.select("node", "g1", "g2").join(leaders.select("g1", "g2", "leader"), ["g1", "g2"]).join(reached, "node", "left")
    members = written(members.select("leader", "node", F.coalesce("component", "node").alias("comp")), "members")
    release(spark)
    spans = members.groupBy("leader").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("size"))
    labelled = classes.filter("pos >= 0").join(spans, F.col("node") == F.col("leader")).drop("leader")
    mixed_ = labelled.groupBy("token").agg(F.min("lo").alias("least"), F.max("hi").alias("most")).filter("least <> most").select("token")
    labelled = written(labelled.join(mixed_, "token"), "mixed")
    release(spark)
    labelled = labelled.withColumn("band", band)  # similar sets are in one band of sizes or in neighbouring ones
    x = labelled.select("token", "band", F.col("node").alias("a"), F.col("n").alias("na"), F.col("pos").alias("pa"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.col("size").alias("sa"))
    beside = F.explode(F.array(F.struct(F.col("band").alias("band"), F.lit(True).alias("same")), F.struct((F.col("band") - 1).alias("band"), F.lit(False).alias("same"))))
    y = labelled.withColumn("at", beside).select("token", "at.band", "at.same", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.col("size").alias("sb"))
    apart = F.least("la", "lb") != F.greatest("ha", "hb")
    leading = x.join(y, ["token", "band"]).filter((~F.col("same") | (F.col("a") < F.col("b"))) & apart & near("a", "b"))
    leading = leading.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), ((F.col("sa") > 1) | (F.col("sb") > 1)).alias("more")).distinct()
    # a pair tried in vain says nothing of the groups' other members
    leading = leading.join(tried.withColumn("tried", F.lit(True)), ["a", "b"], "left").filter("tried is null or more").select("a", "b")
    leading = promising(leading, "rest")
    x = members.select(F.col("leader").alias("la"), F.col("node").alias("a"), F.col("comp").alias("ca"))
    y = members.select(F.col("leader").alias("lb"), F.col("node").alias("b"), F.col("comp").alias("cb"))
    split = spans.filter("lo <> hi").select(F.col("leader").alias("la"), F.col("leader").alias("lb"))
    both = leading.select(F.col("a").alias("la"), F.col("b").alias("lb")).unionByName(split)
    rest = both.join(x, "la").join(y, "lb").filter((F.col("ca") != F.col("cb")) & ((F.col("la") != F.col("lb")) | (F.col("a") < F.col("b"))))
    rest = rest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).join(tried, ["a", "b"], "left_anti")
    rest = written(rest, "expanded")
    release(spark)
    more = verified(rest)
    home = nodes.select("n", "h1", "h2", F.col("node").alias("home"))
    if repeated:  # ids of several texts tie their components together
        more = more.unionByName(full.join(home, ["n", "h1", "h2"]).select(F.col("doc_id").alias("a"), F.col("home").alias("b")))
    if not more.isEmpty():
        reached = components(reached.select(F.col("node").alias("a"), F.col("component").alias("b")).unionByName(more))
    reached = home.join(reached, F.col("home") == F.col("node"), "left").select("n", "h1", "h2", F.coalesce("component", "home").alias("component"))
    out = keys.join(reached, ["n", "h1", "h2"], "left")
    component = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.coalesce("component", "doc_id")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"))


def keep_one(docs: DataFrame, n: int = 5, num: int = 80, den: int = 100) -> DataFrame:
    """``docs`` with one document of each linked group: that with the smallest doc_id.

    Of rows that share a doc_id one stays; rows without a doc_id all stay."""
    kept, nth = (fresh(docs.columns, name) for name in ("_kept", "_nth"))
    found = link_documents(docs, n, num, den).filter("doc_id = component_id").select(F.col("doc_id").alias(kept)).distinct()
    rows = docs.join(found, F.col("doc_id") == F.col(kept), "left").filter(F.col(kept).isNotNull() | F.col("doc_id").isNull())
    content = F.xxhash64(*[col(c) for c in docs.columns])
    same_id = Window.partitionBy("doc_id", F.when(F.col("doc_id").isNull(), content)).orderBy(content)
    rows = rows.withColumn(nth, F.row_number().over(same_id))
    return rows.filter((F.col(nth) == 1) | F.col("doc_id").isNull()).select(*[col(c) for c in docs.columns])

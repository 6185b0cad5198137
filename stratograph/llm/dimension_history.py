"""Versioned history of dimension rows that change late, by big-integer bitmasks.

Of a key's changes only the last-arrived one of each interval can matter, so maps keep that one
and a key shuffles at most one row for each interval, however often it changes.  The days
between a key's neighbouring boundaries are the bits of one big integer: corrections, newest
first, take what is uncovered of their mask, base intervals take the bits left over, and the
runs of a value's bits are its versions.  What comes after the last boundary, the endless tail,
is kept apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_arrow, col

#: Days that a change of a document can start on, and days that a correction covers.
DAYS, CORRECTION = 60, 10


def runs(bits: int) -> Iterator[tuple[int, int]]:
    """(first, stop) of the maximal runs of ones, lowest first."""
    at = 0
    while bits:
        zeros = (bits & -bits).bit_length() - 1
        bits >>= zeros
        ones = (~bits & (bits + 1)).bit_length() - 1
        yield at + zeros, at + zeros + ones
        bits >>= ones
        at += zeros + ones


def timeline(corrections: list[tuple], bases: list[tuple]) -> list[tuple]:
    """(first day, stop or None, value) of a key's versions, in order of days.

    corrections: (start, stop, value), newest first; bases: (start, deleted, value) by start."""
    points = sorted({x for c in corrections for x in c[:2]} | {b[0] for b in bases})
    place = {p: i for i, p in enumerate(points)}
    last = len(points) - 1
    uncovered, held = (1 << max(0, last)) - 1, {}
    for start, stop, value in corrections:
        taken = ((1 << place[stop]) - (1 << place[start])) & uncovered
        if taken:
            held[value] = held.get(value, 0) | taken
            uncovered ^= taken
    for i, (start, deleted, value) in enumerate(bases):
        stop = place[bases[i + 1][0]] if i + 1 < len(bases) else last
        taken = ((1 << stop) - (1 << place[start])) & uncovered
        if taken and not deleted:
            held[value] = held.get(value, 0) | taken
    out = [(points[a], points[b], value) for value, bits in held.items() for a, b in runs(bits)]
    if bases and not bases[-1][1]:
        value = bases[-1][2]
        first = next((a for a, b, v in out if b == points[-1] and v == value), points[-1])
        out = [x for x in out if x[0] != first or x[2] != value] + [(first, None, value)]
    return sorted(out, key=lambda x: x[0])


def versions(changes: DataFrame, arrival: list[Column | str]) -> DataFrame:
    """Rows (key, version, valid_from, valid_to, value) of ``changes``.

    ``changes`` has key, kind (``update``, ``delete`` or ``correction``), start and stop (whole
    numbers of days; stop, exclusive, counts for corrections alone) and value, of an atomic type; ``arrival``
    orders them, latest last.  A day has the value of the last-arrived correction that covers
    it, else of the update with the latest start not after it (of one start, the last-arrived),
    unless a delete stands there.  A version is a maximal run of days of one value, null equal
    to null; valid_to is exclusive, and null where it never ends.

    Changes without a key, a start or one of the three kinds, and corrections that cover no
    day, have no effect; a null value is a value.  Changes that arrive at the same time: the
    largest value wins, null the least.  Keys that are absent on all days, and an empty table,
    give no rows.  Other columns are ignored.  A key's rows in one task are at most one for each
    of its (kind, start, stop), as every partition keeps only the last-arrived of these.
    """
    late = F.col("kind") == "correction"
    rows = changes.filter("key is not null and start is not null and kind in ('update', 'delete', 'correction')")
    rows = rows.filter(~late | (F.col("stop") > F.col("start")))
    order = F.struct(*[(col(a) if isinstance(a, str) else a).alias(f"a{i}") for i, a in enumerate(arrival)])
    rows = rows.select("key", late.alias("late"), F.col("start").cast("long").alias("start"), F.when(late, F.col("stop").cast("long")).alias("stop"), F.struct(order.alias("at"), F.col("value").alias("value"), (F.col("kind") == "delete").alias("deleted")).alias("last"))
    last = rows.groupBy("key", "late", "start", "stop").agg(F.max("last").alias("last"))
    bases = F.transform(F.array_sort(F.filter("all", lambda x: ~x["late"])), lambda x: F.struct(x["start"].alias("start"), x["last"]["deleted"].alias("deleted"), x["last"]["value"].alias("value")))
    newest = F.reverse(F.array_sort(F.transform(F.filter("all", lambda x: x["late"]), lambda x: F.struct(x["last"]["at"].alias("at"), x["last"]["value"].alias("value"), x["start"].alias("start"), x["stop"].alias("stop")))))
    corrections = F.transform(newest, lambda x: F.struct(x["start"].alias("start"), x["stop"].alias("stop"), x["value"].alias("value")))
    keys = last.groupBy("key").agg(F.collect_list(F.struct("start", "late", "stop", "last")).alias("all")).select("key", corrections.alias("corrections"), bases.alias("bases"))

    def extract(batches):
        for batch in batches:
            kinds = (batch.schema.field(0).type, batch.schema.field(2).type.value_type.field("value").type)
            keys, number, first, stop, values = [], [], [], [], []
            for key, corrections, bases in zip(*(batch.column(i).to_pylist() for i in range(3))):
                found = timeline([tuple(x.values()) for x in corrections], [tuple(x.values()) for x in bases])
                keys += [key] * len(found)
                number += range(1, len(found) + 1)
                for out, part in zip((first, stop, values), zip(*found)):
                    out += part
            arrays = [pa.array(keys, kinds[0]), pa.array(number, pa.int32()), pa.array(first, pa.int64()), pa.array(stop, pa.int64()), pa.array(values, kinds[1])]
            yield pa.RecordBatch.from_arrays(arrays, names=["key", "version", "valid_from", "valid_to", "value"])

    types = {f.name: f.dataType.simpleString() for f in changes.schema.fields}
    return by_arrow(keys, extract, f"key {types['key']}, version int, valid_from long, valid_to long, value {types['value']}")


def document_changes(docs: DataFrame, id_col: str = "doc_id", value_col: str = "source") -> DataFrame:
    """Two changes of every row, told by a hash of its id: what arrives, when, of which kind.

    A change concerns the id rounded to tens towards zero, carries the row's source and arrives by
    (hash, id, number).  Rows without an id make none; repeated rows make repeated changes."""
    rows = docs.select(col(id_col).cast("long").alias("id"), col(value_col).alias("value")).filter("id is not null")
    rows = rows.select("*", F.explode(F.array(F.lit(0), F.lit(1))).alias("j"))
    digest = F.sha2(F.concat_ws(":", F.col("id").cast("string"), F.col("j").cast("string")).cast("binary"), 256)
    rows = rows.withColumn("h", F.conv(F.substring(digest, 1, 12), 16, 10).cast("long"))
    dealt = F.expr("h div 1000") % 10
    kind = F.when(dealt <= 1, "delete").when(dealt <= 4, "correction").otherwise("update")
    start = F.col("h") % DAYS
    return rows.select((F.col("id") - F.col("id") % 10).alias("key"), kind.alias("kind"), start.alias("start"), (start + CORRECTION).alias("stop"), "value", "h", "id", "j")


def document_history(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, version, valid_from, valid_to, value): the versions that the changes of ``docs`` leave.

    Nulls, repeats and empty tables: see ``versions`` and ``document_changes``."""
    return versions(document_changes(docs), ["h", "id", "j"]).withColumnRenamed("key", "doc_id")

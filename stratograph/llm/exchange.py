"""Blocks of text and the packed exchange of fingerprints between them.

Documents are packed, in order of id, into blocks of about a megabyte; the blocks are a table
bucketed by block number, so joining to it moves what is joined alone.  In a step each block
works out its state and the fingerprints it has questions about, both kept in a table of the
same buckets; the fingerprints, without repeats, go packed to buckets of their own, each
sorts what it got and answers: asked by more than one, asked earlier, or a global name.  The
next step starts from state and answers.  A fingerprint that a third of all documents share
is sent once a block, and no task sees more than its bucket.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_arrow, drop_path, partitions, release, scratch

#: Bytes of text in a block (a longer document makes a block of its own), bytes of text in a
#: bucket of the block table, and bytes of fingerprints in a bucket of a round.
BLOCK, TABLE_BUCKET, ROUND_BUCKET = 1 << 20, 8 << 20, 6 << 20
_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Odd factors and seeds of the two lanes of a fingerprint.
_ODD = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD1342543DE82EF95))
_SEED = (np.uint64(0x243F6A8885A308D3), np.uint64(0x13198A2E03707344))
#: Bytes from which a word is hashed by BLAKE2b instead of eight bytes at a time.
LONG_WORD = 256
#: Slices of a vector that is summed over partitions.
SLICES = 64
_REPLY = "array<struct<bucket:int,found:binary>>"
#: What a step asks: whether another question has the fingerprint, whether an earlier one has,
#: or a name for it that is the same everywhere.
AGAIN, EARLIER, NAMES = "again", "earlier", "names"


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M1
    x = (x ^ (x >> np.uint64(27))) * _M2
    return x ^ (x >> np.uint64(31))


def _eights(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each place of ``data`` on as one number, zeros behind the end."""
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    return np.ndarray((len(data) + 1,), "<u8", buffer=padded, strides=(1,))


def _folded(h: np.ndarray, x: np.ndarray, lane: int) -> np.ndarray:
    return mixed((h ^ x) * _ODD[lane])


def byte_names(data: np.ndarray, at: np.ndarray, size: int, lanes: int) -> list[np.ndarray]:
    """A 64-bit name per lane of the ``size`` bytes from each place ``at`` on.

    Eight bytes at a time go through a non-linear mixing, so unlike strings meet by chance
    alone, whatever their structure.  All strings lie inside ``data``."""
    eights = _eights(data)
    out = [np.full(len(at), _SEED[k] ^ np.uint64(size)) for k in range(lanes)]
    full = size - size % 8
    for step in range(0, full, 8):
        x = eights[at + step]
        out = [_folded(h, x, k) for k, h in enumerate(out)]
    if size > full:
        x = eights[at + full] & np.uint64((1 << 8 * (size - full)) - 1)
        out = [_folded(h, x, k) for k, h in enumerate(out)]
    return out


def word_names(data: np.ndarray, first: np.ndarray, stop: np.ndarray, lanes: int) -> list[np.ndarray]:
    """The same for strings of any sizes: those of LONG_WORD bytes and more by BLAKE2b."""
    eights, size = _eights(data), stop - first
    out = [mixed(_SEED[k] + size.astype(np.uint64)) for k in range(lanes)]
    at = np.flatnonzero((size > 0) & (size < LONG_WORD))
    step = 0
    while len(at):
        left = size[at] - step
        x = eights[first[at] + step]
        x &= np.where(left >= 8, _ALL, (np.uint64(1) << (np.minimum(left, 7) * 8).astype(np.uint64)) - np.uint64(1))
        for k, h in enumerate(out):
            h[at] = _folded(h[at], x, k)
        step += 8
        at = at[left > 8]
    for i in np.flatnonzero(size >= LONG_WORD).tolist():
        found = np.frombuffer(hashlib.blake2b(data[first[i] : stop[i]].tobytes(), digest_size=16).digest(), "<u8")
        for k, h in enumerate(out):
            h[i] = found[k]
    return out


_ALL = np.uint64((1 << 64) - 1)


class Hashes:
    """Names of any stretch of a sequence of named items.

    Level k names stretches of 2^k items by their halves, without linearity; a stretch is
    named by the two of the greatest level that cover it, and its length."""

    def __init__(self, ones: np.ndarray, lane: int):
        self.levels, self.lane = [ones], lane

    def _both(self, a: np.ndarray, b: np.ndarray, more) -> np.ndarray:
        return _folded(_folded(a + more, b, self.lane), a, 1 - self.lane)

    def of(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        size = stop - first
        out = np.full(len(first), _SEED[self.lane])
        if not len(first):
            return out
        level = np.frexp(np.maximum(size, 1).astype(np.float64))[1] - 1
        for k in range(int(level.max()) + 1):
            if k == len(self.levels):
                below, half = self.levels[-1], 1 << (k - 1)
                self.levels.append(self._both(below[:-half], below[half:], np.uint64(k)))
            at = np.flatnonzero((level == k) & (size > 0))
            if len(at):
                names = self.levels[k]
                out[at] = self._both(names[first[at]], names[stop[at] - (1 << k)], size[at].astype(np.uint64) << np.uint64(8))
        return out


class Block:
    """data: bytes of its texts end to end; ends: their ends, after a 0; ids: theirs."""

    def __init__(self, number: int, ids: bytes, ends: bytes, data: bytes):
        self.number = number
        self.ids = np.frombuffer(ids, np.int64, len(ids) // 9)  # 0 where there is none
        self.has_id = np.frombuffer(ids, np.bool_, offset=8 * len(self.ids))
        self.ends = np.frombuffer(ends, np.int64)
        self.data = np.frombuffer(data, np.uint8)


@dataclass
class Step:
    """What a step left: the table of (block, state, asks), the answers (block, bucket, found),
    where those lie, how many buckets there are, and the kind of the answers.

    Without a table the states are among the answers, with a bucket below 0."""

    table: str | None
    answers: DataFrame
    path: str
    buckets: int
    kind: str


class Reply:
    """What the buckets answered to one block."""

    def __init__(self, rows: list[dict], buckets: int, kind: str | None):
        self.rows, self.buckets, self.kind = rows, buckets, kind

    def to(self, asked: Questions) -> np.ndarray:
        """For each fingerprint whether it holds, or a pair (name, shared) of arrays."""
        if self.kind == NAMES:
            return asked.names(self.rows, self.buckets)
        return asked.answers(self.rows, self.buckets, self.kind == EARLIER)


class Blocks:
    """The bucketed table of blocks of ``docs`` (doc_id long, data binary)."""

    def __init__(self, docs: DataFrame, total_bytes: int):
        self.spark = docs.sparkSession
        self.bytes = total_bytes
        self.buckets = int(min(65536, max(8, -(-total_bytes // TABLE_BUCKET))))
        self.name = f"blocks_{uuid.uuid4().hex}"
        order = ["doc_id", F.xxhash64("data")]
        rows = docs.repartitionByRange(partitions(self.spark), *order).sortWithinPartitions(*order)
        self._save(by_arrow(rows, _pack, "block long, ids binary, ends binary, data binary"), self.name)
        del rows, docs
        release(self.spark)

    def _save(self, rows: DataFrame, name: str) -> None:
        rows.write.format("parquet").option("compression", "zstd").bucketBy(self.buckets, "block").saveAsTable(name)

    def _rows(self, text: bool, before: Step | None) -> DataFrame:
        rows = self.spark.table(self.name) if text else None
        empty = F.expr(f"cast(array() as {_REPLY})")
        if before is None:
            return rows.select("*", F.lit(b"").alias("state"), empty.alias("reply"))
        got = before.answers.repartition(self.buckets, "block").groupBy("block").agg(F.collect_list(F.struct("bucket", "found")).alias("got"))
        if before.table is None:
            rows = got if rows is None else rows.join(got, "block")
            return rows.withColumn("state", F.lit(b"")).withColumn("reply", F.col("got")).drop("got")
        state = self.spark.table(before.table).select("block", "state")
        rows = state if rows is None else rows.join(state, "block")
        return rows.join(got, "block", "left").withColumn("reply", F.coalesce("got", empty)).drop("got")

    def map(self, f: Callable[..., Iterator[pa.RecordBatch]], schema: str, before: Step | None = None, text: bool = True) -> DataFrame:
        """f(block, state, reply) -> record batches, over all blocks; without ``text`` a block is its number alone."""
        buckets, kind = (before.buckets, before.kind) if before else (0, None)
        among = before is not None and before.table is None

        def run(batches):
            for batch in batches:
                for i in range(batch.num_rows):
                    row = [batch.column(k)[i] for k in range(batch.num_columns)]
                    number = row[0].as_py()
                    block = Block(number, row[1].as_buffer(), row[2].as_buffer(), row[3].as_buffer()) if text else number
                    state, reply = row[-2].as_buffer(), row[-1].as_py()
                    if among:
                        state = next(r["found"] for r in reply if r["bucket"] < 0)
                        reply = [r for r in reply if r["bucket"] >= 0]
                    yield from f(block, state, Reply(reply, buckets, kind))

        return by_arrow(self._rows(text, before), run, schema)

    def step(self, f: Callable[..., tuple[bytes, Questions]], kind: str, density: float, what: str, before: Step | None = None, text: bool = True, saved: bool = True) -> Step:
        """f(block, state, reply) -> (state, questions), and the answers to them of that kind.

        density: bytes of fingerprints expected for a byte of text.  saved: states and
        questions are written to a table; else they go straight to the buckets, which suits
        large questions and small states.  The tables of the step before go once this one's
        are there."""
        n = int(max(64, -(-self.bytes * density // ROUND_BUCKET)))

        homes = self.buckets

        def straight(block, state, reply):
            state, asked = f(block, state, reply)
            buckets, counts, blobs = asked.packed(n)
            number = block if isinstance(block, int) else block.number
            buckets, counts = np.append(buckets, -1 - number % homes), np.append(counts, 0)
            cols = [pa.array(buckets, pa.int32()), pa.array(np.full(len(buckets), number)), pa.array(counts, pa.int32()), pa.array([*blobs, state], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, names=["bucket", "block", "n", "keys"])

        def send(block, state, reply):
            state, asked = f(block, state, reply)
            buckets, counts, blobs = asked.packed(n)
            asks = pa.StructArray.from_arrays([pa.array(buckets, pa.int32()), pa.array(counts, pa.int32()), pa.array(blobs, pa.binary())], names=["bucket", "n", "keys"])
            asks = pa.ListArray.from_arrays(pa.array([0, len(buckets)], pa.int32()), asks)
            number = block if isinstance(block, int) else block.number
            yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([state], pa.binary()), asks], names=["block", "state", "asks"])

        def solve(table: pa.Table) -> pa.Table:
            return _solve(table, kind)

        name = f"{what.replace('-', '_')}_{uuid.uuid4().hex}" if saved else None
        if saved:
            self._save(self.map(send, "block long, state binary, asks array<struct<bucket:int,n:int,keys:binary>>", before, text), name)
            sent = self.spark.table(name).select("block", F.inline("asks"))
        else:
            sent = self.map(straight, "bucket int, block long, n int, keys binary", before, text)
        path = scratch(self.spark, what)
        solved = sent.groupBy("bucket").applyInArrow(solve, "block long, bucket int, found binary")
        solved.write.parquet(path)
        schema = solved.schema
        del sent, solved
        if before is not None:
            if before.table is not None:
                self.spark.sql(f"DROP TABLE IF EXISTS {before.table}")
            drop_path(self.spark, before.path)
        release(self.spark)
        return Step(name, self.spark.read.schema(schema).parquet(path), path, n, kind)


def _pack(batches):
    part, seq, ids, texts, size = TaskContext.get().partitionId(), 0, [], [], 0

    def block():
        ends = np.zeros(len(texts) + 1, np.int64)
        np.cumsum([len(t) for t in texts], out=ends[1:])
        known = np.array([i is not None for i in ids])
        numbers = np.array([i or 0 for i in ids], np.int64).tobytes() + known.tobytes()
        row = [(part << 32) + seq], [numbers], [ends.tobytes()], [b"".join(texts)]
        return pa.RecordBatch.from_arrays([pa.array(row[0], pa.int64()), *[pa.array(x, pa.binary()) for x in row[1:]]], names=["block", "ids", "ends", "data"])

    for batch in batches:
        for i, t in zip(batch.column(0).to_pylist(), batch.column(1)):
            t = t.as_py()
            if size and size + len(t) > BLOCK:
                yield block()
                seq, ids, texts, size = seq + 1, [], [], 0
            ids.append(i)
            texts.append(t)
            size += len(t)
    if ids:
        yield block()


def _dealt(keys: np.ndarray, most: int = 64) -> tuple[np.ndarray, np.ndarray]:
    """(order, same): an order of equal keys side by side, earlier places first, and whether
    each in it equals the one before; only the highest bits of keys count, ``most`` or as many
    as fit beside a place in one number, which sorts many times faster than pairs do."""
    bits = max(1, len(keys) - 1).bit_length()
    place = np.uint64((1 << bits) - 1)
    packed = np.sort((keys & ~place) | np.arange(len(keys), dtype=np.uint64))
    order = (packed & place).astype(np.int64)
    head = packed >> np.uint64(max(bits, 64 - most))
    same = np.zeros(len(keys), bool)
    same[1:] = head[1:] == head[:-1]
    return order, same


def _exactly(order: np.ndarray, same: np.ndarray, high: np.ndarray, low: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same by both words whole."""
    h, o = high[order], low[order]
    equal = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    if (same[1:] & ~equal).any():  # unlike ones share their highest bits: sort in full
        order = np.lexsort((low, high))
        h, o = high[order], low[order]
        equal = (h[1:] == h[:-1]) & (o[1:] == o[:-1])
    same = np.zeros(len(high), bool)
    same[1:] = equal
    return order, same


class Questions:
    """Fingerprints in order of place: high (64 bits) and, unless None, low (32 bits).

    Only the first of equal ones is sent.  Without a low word five bytes of the high one are
    sent, its highest bits choosing the bucket: enough for pruning, where a chance match
    costs work and no more.  With it 96 bits are sent and decide."""

    def __init__(self, high: np.ndarray, low: np.ndarray | None = None):
        self.high, self.low = high, low
        order, same = _dealt(high)
        if low is not None:
            order, same = _exactly(order, same, high, low)
        run = np.cumsum(~same) - 1
        self.first = order[~same]  # one place of each fingerprint, the earliest, in order of the fingerprint
        many = np.bincount(run, minlength=len(self.first)) > 1
        self.leader = np.empty(len(high), np.int64)
        self.leader[order] = self.first[run]
        self.again = np.empty(len(high), bool)
        self.again[order] = many[run]

    def _counts(self, n: int) -> np.ndarray:
        bucket = ((self.high[self.first] >> np.uint64(40)) * np.uint64(n)) >> np.uint64(24)
        return np.bincount(bucket.astype(np.int64), minlength=n)

    def packed(self, n: int) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
        """(buckets, numbers of keys, keys) of the buckets that get any."""
        if not len(self.high):
            return np.zeros(0, np.int32), np.zeros(0, np.int32), []
        count = self._counts(n)
        high = np.ascontiguousarray(self.high[self.first].astype("<u8")).view(np.uint8).reshape(-1, 8)
        if self.low is None:
            keys = high[:, :5]
        else:
            keys = np.concatenate([high, np.ascontiguousarray(self.low[self.first].astype("<u4")).view(np.uint8).reshape(-1, 4)], axis=1)
        width = keys.shape[1]
        keys = np.ascontiguousarray(keys).tobytes()
        some = np.flatnonzero(count)
        stop = np.cumsum(count) * width
        return some.astype(np.int32), count[some].astype(np.int32), [keys[stop[b] - count[b] * width : stop[b]] for b in some]

    def answers(self, reply: list[dict], n: int, earlier: bool) -> np.ndarray:
        """One bool for each fingerprint, from the rows that the buckets sent back."""
        if not len(self.high):
            return np.zeros(0, bool)
        count = self._counts(n)
        start = np.cumsum(count) - count
        flags = np.zeros(len(self.high), bool)
        for r in reply:
            b = r["bucket"]
            bits = np.unpackbits(np.frombuffer(r["found"], np.uint8), count=int(count[b])).view(bool)
            flags[self.first[start[b] : start[b] + count[b]]] = bits
        out = flags[self.leader]
        if earlier:
            return out | (self.leader != np.arange(len(out)))
        return out | self.again


    def names(self, reply: list[dict], n: int) -> tuple[np.ndarray, np.ndarray]:
        """(name, shared) of each fingerprint: bucket and number in it, and whether any other has it."""
        if not len(self.high):
            return np.zeros(0, np.uint64), np.zeros(0, bool)
        count = self._counts(n)
        start = np.cumsum(count) - count
        names, shared = np.zeros(len(self.high), np.uint64), np.zeros(len(self.high), bool)
        for r in reply:
            b = r["bucket"]
            found = np.frombuffer(r["found"], "<u4").astype(np.uint64)
            at = self.first[start[b] : start[b] + count[b]]
            names[at] = (np.uint64(b) << np.uint64(32)) | (found >> np.uint64(1))
            shared[at] = found & np.uint64(1) == 1
        return names[self.leader], shared[self.leader] | self.again


def _solve(table: pa.Table, kind: str) -> pa.Table:
    """Sort one bucket; equal keys are neighbours, in order of block and place.

    A name is the number of the key among the bucket's, and a bit that says whether several asked."""
    if table["bucket"][0].as_py() < 0:  # states on their way to the next step
        return table.select(["block", "bucket", "keys"]).rename_columns(["block", "bucket", "found"])
    numbers = table["block"].to_numpy()
    order = np.argsort(numbers, kind="stable")
    counts = table["n"].to_numpy()[order].astype(np.int64)
    blobs = table["keys"].combine_chunks()
    blobs = blobs if isinstance(blobs, pa.Array) else blobs.chunk(0)
    data = b"".join(blobs[int(i)].as_buffer() for i in order)
    total = int(counts.sum())
    width = len(data) // total
    raw = np.frombuffer(data, np.uint8).reshape(total, width)
    high = np.zeros((total, 8), np.uint8)
    if width > 8:
        high[:] = raw[:, :8]
        high = high.view("<u8").ravel()
        # what is left of the keys in a bucket after its own bits comes first, so that packing keeps enough
        low = np.ascontiguousarray(raw[:, 8:]).view("<u4").ravel()
        turned = (high << np.uint64(24)) | (high >> np.uint64(40))
        at, same = _exactly(*_dealt(turned), turned, low)
    else:
        high[:, 8 - width :] = raw
        high = high.view("<u8").ravel()
        if total < 1 << 24:
            at, same = _dealt(high, 40)
        else:
            at = np.argsort(high, kind="stable")
            same = np.append(False, high[at[1:]] == high[at[:-1]])
    stop = np.cumsum(counts)
    ends = list(zip(stop.tolist(), counts.tolist()))
    if kind == NAMES:
        run = np.cumsum(~same) - 1
        name = np.empty(total, "<u4")
        name[at] = run << 1 | (np.bincount(run)[run] > 1)
        found = [name[b - c : b].tobytes() for b, c in ends]
    else:
        flag = np.zeros(total, bool)
        flag[at] = same
        if kind == AGAIN:
            flag[at[:-1]] |= same[1:]
        found = [np.packbits(flag[b - c : b]).tobytes() for b, c in ends]
    bucket = table["bucket"][0].as_py()
    return pa.table(
        {
            "block": pa.array(numbers[order], pa.int64()),
            "bucket": pa.array(np.full(len(found), bucket, np.int32)),
            "found": pa.array(found, pa.binary()),
        }
    )


def kept_state(*arrays: np.ndarray) -> bytes:
    """Arrays as one byte string; bools as bits, numbers in the fewest bytes that hold them."""
    head, parts = [len(arrays)], []
    for x in arrays:
        kind = -1
        if x.dtype == bool:
            data = np.packbits(x)
        else:
            kind = next(k for k, t in enumerate(_WIDTHS) if not len(x) or (x.min() >= np.iinfo(t).min and x.max() <= np.iinfo(t).max))
            data = x.astype(_WIDTHS[kind])
        head += [kind, len(x)]
        parts.append(data.tobytes())
    return np.array(head, np.int64).tobytes() + b"".join(parts)


_WIDTHS = (np.uint8, np.uint16, np.int32, np.int64, np.uint64)


def from_state(state) -> list[np.ndarray]:
    """The arrays again, numbers as int64 or uint64."""
    many = int(np.frombuffer(state, np.int64, 1)[0])
    head = np.frombuffer(state, np.int64, 1 + 2 * many)[1:].reshape(-1, 2).tolist()
    at, out = 8 * (1 + 2 * many), []
    for kind, n in head:
        if kind < 0:
            size = -(-n // 8)
            out.append(np.unpackbits(np.frombuffer(state, np.uint8, size, at), count=n).view(bool))
        else:
            t = _WIDTHS[kind]
            size = n * np.dtype(t).itemsize
            x = np.frombuffer(bytes(memoryview(state)[at : at + size]), t)
            out.append(x.astype(np.uint64 if t is np.uint64 else np.int64))
        at += size
    return out


def id_column(block: Block) -> pa.Array:
    return pa.array(block.ids, mask=~block.has_id)


def covered(n: int, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """True at the places of 0..n-1 that lie in any [first, stop)."""
    change = np.bincount(first, minlength=n + 1)[: n + 1] - np.bincount(np.minimum(stop, n), minlength=n + 1)[: n + 1]
    return np.cumsum(change[:n]) > 0


def spans(mask: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Maximal runs of True that do not cross ``ends``: (row, first, stop), in place of the row."""
    change = mask.copy()
    inner = ends[1:-1][ends[1:-1] < len(mask)]
    change[1:] = mask[1:] & ~mask[:-1]
    change[inner] |= mask[inner]
    first = np.flatnonzero(change)
    over = mask.copy()
    over[:-1] = mask[:-1] & ~mask[1:]
    inner = inner[inner > 0]
    over[inner - 1] |= mask[inner - 1]
    stop = np.flatnonzero(over) + 1
    row = np.searchsorted(ends, first, "right") - 1
    return row, first - ends[row], stop - ends[row]


def _slice(x: np.ndarray) -> bytes:
    some = np.flatnonzero(x)
    return kept_state(np.diff(some, prepend=0), x[some]) if 3 * len(some) < len(x) else kept_state(x)


def _whole(arrays: list[np.ndarray], width: int, kind: str) -> np.ndarray:
    out = np.zeros(width, kind)
    *places, numbers = arrays
    out[np.cumsum(places[0]) if places else slice(None)] = numbers.astype(kind)
    return out


def summed(rows: DataFrame, count: Callable[[Iterator[pa.RecordBatch]], np.ndarray], length: int, kind: str) -> np.ndarray:
    """The sum over all partitions of count(batches), a vector of ``length`` numbers of ``kind``.

    Partitions send slices, of sparse ones only what is not 0, numbers in the fewest bytes
    that hold them, so what they send grows with what they count.  Slices are added in two
    steps, so what one task adds up is bounded by 1/64 of the partitions' slices; the driver
    gets the one sum."""
    width = -(-length // SLICES)

    def send(batches):
        total = np.zeros(width * SLICES, kind)
        total[:length] = count(batches)
        at = [TaskContext.get().partitionId() % 64] * SLICES
        parts = [_slice(total[i * width : (i + 1) * width]) for i in range(SLICES)]
        yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array(at, pa.int32()), pa.array(parts, pa.binary())], names=["slice", "part", "total"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(width, kind)
        for x in table["total"]:
            total += _whole(from_state(x.as_buffer()), width, kind)
        return pa.table({"slice": table["slice"][:1], "part": table["part"][:1], "total": pa.array([_slice(total)], pa.binary())})

    schema = "slice int, part int, total binary"
    parts = by_arrow(rows, send, schema).groupBy("slice", "part").applyInArrow(add, schema)
    found = parts.groupBy("slice").applyInArrow(add, schema).orderBy("slice").toArrow()
    if not found.num_rows:
        return np.zeros(length, kind)
    return np.concatenate([_whole(from_state(x.as_buffer()), width, kind) for x in found["total"]])[:length]

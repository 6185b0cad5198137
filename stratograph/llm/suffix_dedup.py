"""Exact repeats of long byte strings by difference-cover, blockwise suffix sorting.

Only the first ``length`` bytes of a suffix matter here, so suffixes are sorted to that depth
and equal ones are neighbours.  Positions whose residue lies in a difference cover form the
sample: any two equal windows contain a common pair of sample positions.  The sample is
ranked first, at the depth that always fits behind that pair inside a window, and again at a
greater depth.  A suffix with no shared sample rank has no equal and is never sorted; a tie
longer than the greater depth is resolved by the ranks of its sample positions alone.  The
suffixes that are left go to buckets that are sorted one at a time, each in its own task, so
memory is bounded by a bucket, not by the text.  Ranks and sort keys are 96-bit hashes of the
strings: any total order on strings makes equal suffixes neighbours.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col
from .exchange import AGAIN, EARLIER, Block, Blocks, Questions, Reply, byte_names, covered, from_state, id_column, kept_state, spans

#: Planar difference sets (modulus: residues); every difference occurs.
COVERS = {
    7: (1, 2, 4),
    13: (0, 1, 3, 9),
    21: (3, 6, 7, 12, 14),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
#: The greater depth, in lengths of a window.
DEEP = 4


class Plan:
    """The cover for windows of ``length`` bytes and what it makes of a block."""

    def __init__(self, length: int):
        self.length = length
        fitting = [v for v in COVERS if v <= length // 3]
        self.modulus = max(fitting, default=1)
        self.cover = COVERS.get(self.modulus, (0,))
        self.depth = length - self.modulus + 1

    def sample(self, block: Block) -> np.ndarray:
        n = len(block.data)
        tile = np.zeros(self.modulus, bool)
        tile[list(self.cover)] = True
        return np.flatnonzero(np.tile(tile, -(-n // self.modulus))[:n]) if n else np.zeros(0, np.int64)

    def ranked(self, block: Block, state, reply: Reply) -> tuple[bytes, Questions]:
        """Sample positions with ``depth`` bytes left in their text, by their ranks at that depth."""
        return b"", self._ranks(block)[1]

    def _ranks(self, block: Block) -> tuple[np.ndarray, Questions]:
        at = self.sample(block)
        at = at[at + self.depth <= _end(block, at)]
        return at, Questions(byte_names(block.data, at, self.depth, 1)[0])

    def deep(self, block: Block, state, reply: Reply) -> tuple[bytes, Questions]:
        """Of the positions whose rank another has, those with ``DEEP`` windows left, by rank at that depth."""
        at, asked = self._ranks(block)
        shared = at[reply.to(asked)]
        return kept_state(np.diff(shared, prepend=0)), self._deep(block, shared)[1]

    def _deep(self, block: Block, shared: np.ndarray) -> tuple[np.ndarray, Questions]:
        at = shared[shared + DEEP * self.length <= _end(block, shared)]
        return at, _strings(block, at, DEEP * self.length)

    def left(self, block: Block, state, reply: Reply) -> tuple[bytes, Questions]:
        """State: the windows known to repeat and the suffixes still to be sorted, which are asked."""
        n = len(block.data)
        shared = np.cumsum(from_state(state)[0])
        at, asked = self._deep(block, shared)
        at = at[reply.to(asked)]
        settled = covered(n, at, at + (DEEP - 1) * self.length + 1)
        begin = block.ends[np.searchsorted(block.ends, shared, "right") - 1]
        at = np.flatnonzero(covered(n, np.maximum(begin, shared - self.modulus + 1), shared + 1) & ~settled)
        open_ = np.zeros(n, bool)
        open_[at[at + self.length <= _end(block, at)]] = True
        return kept_state(settled, open_), _strings(block, np.flatnonzero(open_), self.length)


def _end(block: Block, at: np.ndarray) -> np.ndarray:
    return block.ends[np.searchsorted(block.ends, at, "right")]


def _strings(block: Block, at: np.ndarray, size: int) -> Questions:
    high, low = byte_names(block.data, at, size, 2)
    return Questions(high, (low >> np.uint64(32)).astype(np.uint32))


def repeated_spans(docs: DataFrame, length: int = 100, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_bytes, spans, kept): the bytes to remove and the bytes that stay.

    A byte goes if a window of ``length`` bytes of its text that covers it also starts
    earlier: in a text with a smaller id, or before in the same text.  spans are the maximal
    runs of such bytes (first, stop), counted from 0; kept is the rest as binary.  Null texts
    are empty, empty and short texts lose nothing, texts are whole whatever their length,
    rows with equal ids are ordered by text, null ids come first, and an empty table gives
    no rows.  Matches never cross texts.  The block table stays in the warehouse for the
    plan returned here.
    """
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        F.coalesce(col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("data"),
    )
    total = docs.select(F.sum(F.octet_length(col(text_col).cast("string")))).first()[0] or 0
    blocks, plan = Blocks(rows, total), Plan(length)
    share = len(plan.cover) / plan.modulus
    step = blocks.step(plan.ranked, AGAIN, 5 * share, "cover", saved=False)
    step = blocks.step(plan.deep, EARLIER, 3 * share, "deep", step, saved=False)
    step = blocks.step(plan.left, EARLIER, 1.0, "suffixes", step, saved=False)

    def cut(block: Block, state, reply: Reply):
        settled, open_ = from_state(state)
        at = np.flatnonzero(open_)
        asked = _strings(block, at, length)
        window = settled
        window[at[reply.to(asked)]] = True
        at = np.flatnonzero(window)
        gone = covered(len(block.data), at, at + length)
        row, begin, stop = spans(gone, block.ends)
        of_row = np.searchsorted(row, np.arange(len(block.ids) + 1)).astype(np.int32)
        kept = [block.data[a:b][~gone[a:b]].tobytes() for a, b in zip(block.ends[:-1].tolist(), block.ends[1:].tolist())]
        pairs = pa.StructArray.from_arrays([pa.array(begin, pa.int64()), pa.array(stop, pa.int64())], names=["first", "stop"])
        yield pa.RecordBatch.from_arrays(
            [id_column(block), pa.array(np.diff(block.ends)), pa.ListArray.from_arrays(pa.array(of_row), pairs), pa.array(kept, pa.binary())],
            names=["doc_id", "n_bytes", "spans", "kept"],
        )

    out = blocks.map(cut, "doc_id long, n_bytes long, spans array<struct<first:long,stop:long>>, kept binary", step)
    return out


def digest(found: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, n_removed, n_spans, kept_sha256) of what ``repeated_spans`` gave."""
    return found.select(
        "doc_id",
        "n_bytes",
        F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["stop"] - s["first"]).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def brute_force(texts: list[tuple[int, bytes]], length: int) -> list[tuple]:
    """The same digest by a dictionary of windows; for tests."""
    seen, out = set(), []
    for i, t in sorted(texts):
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - length + 1):
            w = t[a : a + length]
            if w in seen:
                gone[a : a + length] = True
            seen.add(w)
        runs = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        out.append((i, len(t), int(gone.sum()), runs, hashlib.sha256(bytes(b for b, g in zip(t, gone) if not g)).hexdigest()))
    return out

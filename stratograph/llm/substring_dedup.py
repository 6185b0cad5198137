"""Long repeated word sequences by recompression.

A text is a sequence of words.  In each round Spark names, alike over all blocks, the runs of
one symbol and the pairs of a symbol of the left class and one of the right class, which take
their place; a symbol's class is a bit of a hash of its name, so equal substrings get equal
symbols but near their ends.  A word, run or pair that occurs once proves that no window
around it, with the words that decided that it exists, repeats: such symbols and windows drop
out, and the rounds go on with what several texts share.  Stretches of the symbols that are
left, seen before, reveal that all windows inside them repeat; the windows left between are
verified by their own words.  Names are numbers dealt by the buckets that sort all runs and
pairs, told apart by 96-bit fingerprints without linear structure.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col
from .exchange import AGAIN, EARLIER, NAMES, Block, Blocks, Hashes, Questions, Reply, covered, from_state, id_column, kept_state, mixed, word_names

#: Rounds of naming, and symbols of a stretch: together they are longer than a window of 20 words.
ROUNDS, STRETCH = 3, 24
#: Where the words that decide on a symbol lie when something unknown decides on it as well,
#: and how far off they are kept: beyond a window it makes no difference.
NOWHERE, FAR = 1 << 30, 255

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


class Words:
    """The words of a block: where they lie, the text each is in, and hashes of stretches.

    space: for each byte, whether it separates words; lanes: 64-bit names of each stretch."""

    def __init__(self, block: Block, space: np.ndarray = _SPACE, lanes: int = 2):
        data = block.data
        inside = ~space[data]
        begin = inside.copy()
        begin[1:] &= ~inside[:-1]
        edge = block.ends[1:-1]
        edge = edge[edge < len(data)]
        begin[edge] = inside[edge]
        over = inside.copy()
        over[:-1] &= ~inside[1:]
        edge = edge[edge > 0]
        over[edge - 1] = inside[edge - 1]
        first, stop = np.flatnonzero(begin), np.flatnonzero(over) + 1
        self.text = np.searchsorted(block.ends, first, "right") - 1
        self.ends = np.searchsorted(self.text, np.arange(len(block.ids) + 1))
        self.hashes = [Hashes(x, k) for k, x in enumerate(word_names(data, first, stop, lanes))]
        self.n = len(first)

    def name(self, first: np.ndarray, stop: np.ndarray) -> np.ndarray:
        return self.hashes[0].of(first, stop)

    def questions(self, first: np.ndarray, stop: np.ndarray) -> Questions:
        low = self.hashes[1].of(first, stop)
        return Questions(self.name(first, stop), (low >> np.uint64(32)).astype(np.uint32))


@dataclass
class Symbols:
    """Symbols of words first..stop that are shared; from_..to are the words that decide that
    they exist.  Symbols that dropped out leave gaps."""

    name: np.ndarray
    first: np.ndarray
    stop: np.ndarray
    from_: np.ndarray
    to: np.ndarray
    text: np.ndarray

    def kept(self) -> tuple[np.ndarray, ...]:
        before, behind = np.minimum(self.first - self.from_, FAR), np.minimum(self.to - self.stop, FAR)
        return self.name, np.diff(self.first, prepend=0), self.stop - self.first, before, behind, np.diff(self.text, prepend=0)

    @classmethod
    def of(cls, name, first, size, before, behind, text) -> Symbols:
        first = np.cumsum(first)
        from_ = np.where(before < FAR, first - before, -NOWHERE)
        to = np.where(behind < FAR, first + size + behind, NOWHERE)
        return cls(name.astype(np.uint64), first, first + size, from_, to, np.cumsum(text))

    def only(self, keep: np.ndarray) -> Symbols:
        return Symbols(*[x[keep] for x in (self.name, self.first, self.stop, self.from_, self.to, self.text)])

    def touching(self) -> np.ndarray:
        """Whether each symbol but the last is followed at once by the next."""
        return (self.stop[:-1] == self.first[1:]) & (self.text[:-1] == self.text[1:])

    def grouped(self, keep: np.ndarray, grown: np.ndarray, left: np.ndarray, right: np.ndarray) -> Symbols:
        """keep: symbols that begin a new one; grown: how many they swallow besides; left, right:
        whether the new one's existence rests on what lies to its left or right as well."""
        last, n = keep + grown, len(self.first)
        near = np.zeros(n + 1, bool)
        near[1:-1] = self.touching()
        before, after = np.maximum(keep - 1, 0), np.minimum(last + 1, n - 1)
        from_ = np.where(left, np.where(near[keep], self.from_[before], -NOWHERE), NOWHERE)
        to = np.where(right, np.where(near[last + 1], self.to[after], NOWHERE), -NOWHERE)
        return Symbols(self.name[keep], self.first[keep], self.stop[last], np.minimum(from_, self.from_[keep]), np.maximum(to, self.to[last]), self.text[keep])


@dataclass
class Proposal:
    """The symbols after a round, which of them are new, and the question for the new ones' names."""

    symbols: Symbols
    new: np.ndarray
    asked: Questions


def propose(symbols: Symbols, number: int, other: np.ndarray | None = None) -> Proposal:
    """Runs, then pairs.  other: the second lane of the words' names, before they have numbers."""
    n = len(symbols.name)
    if not n:
        return Proposal(symbols, np.zeros(0, bool), Questions(np.zeros(0, np.uint64), np.zeros(0, np.uint32)))
    lanes = (symbols.name, symbols.name if other is None else other)
    fresh = np.ones(n, bool)
    fresh[1:] = ~(symbols.touching() & (symbols.name[1:] == symbols.name[:-1]))
    run = np.flatnonzero(fresh)
    size = np.diff(np.append(run, n))
    every = np.ones(len(run), bool)
    runs = symbols.grouped(run, size - 1, every, every)
    one = [mixed(x[run] + size.astype(np.uint64) * _STEP) for x in lanes]  # a run's content
    right = (mixed(one[0] + np.uint64(number)) >> np.uint64(32)) & np.uint64(1) == 1
    joined = np.zeros(len(run), bool)
    joined[:-1] = ~right[:-1] & right[1:] & runs.touching()
    swallowed = np.zeros(len(run), bool)
    swallowed[1:] = joined[:-1]
    keep = np.flatnonzero(~swallowed)
    pair, r = joined[keep], right[keep]
    out = runs.grouped(keep, pair.astype(np.int64), ~pair & r, ~pair & ~r)
    new = pair | (size[keep] > 1)
    at = keep[new]
    second = np.minimum(at + 1, len(run) - 1)
    high, low = (mixed(x[at] * _STEP + np.where(pair[new], mixed(x[second] + _STEP), np.uint64(0))) for x in one)
    return Proposal(out, new, Questions(high, (low >> np.uint64(32)).astype(np.uint32)))


_STEP = np.uint64(0x9E3779B97F4A7C15)


def accept(proposal: Proposal, number: int, answer: tuple[np.ndarray, np.ndarray], open_: np.ndarray, window: int) -> tuple[Symbols, np.ndarray]:
    """(symbols, open windows) once the new ones have names: what occurs once closes the windows
    that hold it with all that decided on it, and symbols in no open window drop out."""
    found, shared = answer
    s = proposal.symbols
    s.name[proposal.new] = (np.uint64(number) << np.uint64(58)) | found
    live = np.ones(len(s.name), bool)
    live[proposal.new] = shared
    open_ = open_ & ~closed(s.from_[~live], s.to[~live], len(open_), window)
    return s.only(live & needed(s, open_, window)), open_


def closed(first: np.ndarray, stop: np.ndarray, n: int, window: int) -> np.ndarray:
    """True at the first words of the windows that hold any of [first, stop)."""
    fits = (first >= 0) & (stop <= n) & (stop - first <= window)
    return covered(n, np.maximum(0, stop[fits] - window), first[fits] + 1)


def needed(s: Symbols, open_: np.ndarray, window: int) -> np.ndarray:
    """Whether an open window holds any word of a symbol."""
    before = np.concatenate([[0], np.cumsum(open_)])
    return before[s.stop] > before[np.maximum(0, s.first - window + 1)]


class Plan:
    """What the steps ask of a block."""

    def __init__(self, window: int):
        self.window = window

    def words(self, block: Block, state, reply: Reply) -> tuple[bytes, Questions]:
        """Which words occur more than once."""
        return b"", Questions(Words(block, lanes=1).hashes[0].levels[0])

    def first(self, block: Block, state, reply: Reply) -> tuple[bytes, Questions]:
        """The first round, over the words that occur more than once."""
        words = Words(block)
        live = reply.to(Questions(words.hashes[0].levels[0]))
        at = np.arange(words.n)
        whole = at + self.window <= words.ends[words.text + 1] if words.n else np.zeros(0, bool)
        lone = np.flatnonzero(~live)
        open_ = whole & ~closed(lone, lone + 1, words.n, self.window)
        before = np.concatenate([[0], np.cumsum(open_)])
        keep = live & (before[1:] > before[np.maximum(0, at - self.window + 1)])
        return kept_state(open_, keep), self._of_words(words, keep).asked  # the words are named again in the next step

    @staticmethod
    def _of_words(words: Words, keep: np.ndarray) -> Proposal:
        at = np.flatnonzero(keep)
        names, other = (h.levels[0][at] for h in words.hashes)
        return propose(Symbols(names, at, at + 1, at, at + 1, words.text[at]), 1, other)

    def _accepted(self, block, state, reply: Reply, number: int) -> tuple[Symbols, np.ndarray]:
        """Symbols and open windows after round ``number``, of which the names have come."""
        open_, *arrays = from_state(state)
        proposal = self._of_words(Words(block), arrays[0]) if number == 1 else propose(Symbols.of(*arrays), number)
        return accept(proposal, number, reply.to(proposal.asked), open_, self.window)

    def round(self, number: int):
        """A step that takes the names of the round before and asks for those of this one."""

        def step(block, state, reply: Reply) -> tuple[bytes, Questions]:
            symbols, open_ = self._accepted(block, state, reply, number - 1)
            return kept_state(open_, *symbols.kept()), propose(symbols, number).asked

        return step

    def stretches(self, block: int, state, reply: Reply) -> tuple[bytes, Questions]:
        """After the last round: STRETCH symbols in a row, from each symbol on."""
        symbols, open_ = self._accepted(block, state, reply, ROUNDS)
        first, stop, asked = self._stretches(symbols)
        return kept_state(open_, symbols.name, np.diff(symbols.first, prepend=0), symbols.stop - symbols.first, np.diff(symbols.text, prepend=0)), asked

    def _stretches(self, symbols: Symbols) -> tuple[np.ndarray, np.ndarray, Questions]:
        n = len(symbols.name)
        gaps = np.concatenate([[0], np.cumsum(~symbols.touching())]) if n else np.zeros(0, np.int64)
        at = np.arange(max(0, n - STRETCH + 1))
        at = at[gaps[at + STRETCH - 1] == gaps[at]]
        first, stop = symbols.first[at], symbols.stop[at + STRETCH - 1]
        long = stop - first >= self.window
        at, first, stop = at[long], first[long], stop[long]
        high, low = (Hashes(mixed(symbols.name + np.uint64(k)), k).of(at, at + STRETCH) for k in (0, 1))
        return first, stop, Questions(high, (low >> np.uint64(32)).astype(np.uint32))

    def left(self, block: Block, state, reply: Reply) -> tuple[bytes, Questions]:
        """State: the windows known to repeat and those still open, which are asked."""
        open_, name, first, size, text = from_state(state)
        first = np.cumsum(first)
        symbols = Symbols(name.astype(np.uint64), first, first + size, first, first + size, np.cumsum(text))
        first, stop, asked = self._stretches(symbols)
        seen = reply.to(asked)
        settled = covered(len(open_), first[seen], stop[seen] - self.window + 1)
        open_ &= ~settled
        return kept_state(settled, open_), self._windows(Words(block), open_)

    def _windows(self, words: Words, open_: np.ndarray) -> Questions:
        at = np.flatnonzero(open_)
        return words.questions(at, at + self.window)


def repeated_words(docs: DataFrame, window: int = 20, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept): kept joins the words that stay by one space.

    A word goes if a window of ``window`` consecutive words of its text that covers it also
    starts earlier: in a text with a smaller id, or before in the same text.  Words are
    separated by ASCII white space and compared as they are.  Null and empty texts have no
    words; texts below a window lose nothing; texts are whole whatever their length; rows
    with equal ids are ordered by text; null ids come first; an empty table gives no rows.
    The block table stays in the warehouse for the plan returned here.
    """
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        F.coalesce(col(text_col).cast("string").cast("binary"), F.lit(b"")).alias("data"),
    )
    total = docs.select(F.sum(F.octet_length(col(text_col).cast("string")))).first()[0] or 0
    blocks, plan = Blocks(rows, total), Plan(window)
    step = blocks.step(plan.words, AGAIN, 0.3, "words", saved=False)
    step = blocks.step(plan.first, NAMES, 0.3, "round-1", step, saved=False)
    for k in range(2, ROUNDS + 1):
        step = blocks.step(plan.round(k), NAMES, 0.1 / (k - 1), f"round-{k}", step, text=k == 2)
    step = blocks.step(plan.stretches, EARLIER, 0.1, "stretches", step, text=ROUNDS == 1)
    step = blocks.step(plan.left, EARLIER, 0.2, "windows", step, saved=False)

    def cut(block: Block, state, reply: Reply):
        words = Words(block)
        settled, open_ = from_state(state)
        settled[np.flatnonzero(open_)[reply.to(plan._windows(words, open_))]] = True
        at = np.flatnonzero(settled)
        gone = covered(words.n, at, at + window)
        stay = (~gone).tolist()
        count = np.bincount(words.text[gone], minlength=len(block.ids)).astype(np.int64)
        kept, data = [], block.data.tobytes()
        for i, (a, b) in enumerate(zip(block.ends[:-1].tolist(), block.ends[1:].tolist())):
            found = data[a:b].split()
            if count[i]:
                found = compress(found, stay[words.ends[i] : words.ends[i + 1]])
            kept.append(b" ".join(found))
        yield pa.RecordBatch.from_arrays(
            [id_column(block), pa.array(np.diff(words.ends).astype(np.int64)), pa.array(count), pa.array(kept, pa.binary())],
            names=["doc_id", "n_words", "n_removed", "kept"],
        )

    out = blocks.map(cut, "doc_id long, n_words long, n_removed long, kept binary", step)
    return out.select("doc_id", "n_words", "n_removed", F.col("kept").cast("string").alias("kept"))


def digest(found: DataFrame) -> DataFrame:
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def brute_force(texts: list[tuple[int, bytes]], window: int) -> list[tuple]:
    """The same digest by a dictionary of windows; for tests."""
    seen, out = set(), []
    for i, t in sorted(texts):
        words = t.split()
        gone = [False] * len(words)
        for a in range(len(words) - window + 1):
            w = tuple(words[a : a + window])
            if w in seen:
                gone[a : a + window] = [True] * window
            seen.add(w)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out

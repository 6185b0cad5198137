"""Benchmark decontamination by latent semantic retrieval.

Passages are TF-IDF vectors over hashed words, with document frequencies counted over the
whole corpus.  A distributed randomised SVD of all passages of the corpus gives its latent
space: every partition multiplies its passages by a random matrix and back, the sums of all of
them are factorised.  Items are folded in, and passages compared with them by cosine there; what
comes near is aligned word by word, and counts as a leak if a long enough share of the item,
and of its answer, occurs there in order and the whole vectors are near enough as well.

A latent space of low rank loses items of rare words, so two more searches lead to the alignment
as well: spaces of the benchmark's own passages at full rank, which hold every item whole, and
for items lost in a passage that holds them, short ones or of common words, runs of words that
a text has in common with them: what stands word for word is found whatever its length and words.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_arrow, col
from .exchange import Block, mixed, summed
from .ngram_join import pieces
from .substring_dedup import Words


@dataclass(frozen=True)
class Settings:
    """features: hash buckets of words; latent, sketch: dimensions of the corpus's latent space and columns of the
    random matrix it comes from; near, near_long: cosine of a candidate in it, of items too long for
    their rarest words to tell where they may be; rank: passages, and so dimensions at most, of a
    space of items' own; window, stride: words of a passage and between passages; least_*: cosine of a candidate, share of an
    item's words found in order, share of its answer's, and weight that a word keeps although
    every document holds it; items: items searched in one pass; run: words of the runs that
    lead to an item (of a shorter item: all of it); least_runs: share of an item's runs that a
    stretch of text holds; short: items of fewer words must stand there word for word."""

    features: int = 1 << 15
    rank: int = 96
    window: int = 64
    stride: int = 32
    least_cosine: float = 0.2
    least_common: float = 0.7
    least_answer: float = 0.5
    least_weight: float = 0.1
    items: int = 4096
    run: int = 3
    least_runs: float = 0.25
    short: int = 8
    latent: int = 32
    sketch: int = 48
    near: float = 0.3
    near_long: float = 0.8


#: Segments, and features, projected at a time; passages compared with all items at a time.
CACHED = 32
COMPARED = 1024
#: Tasks that sketch the corpus at most, and parts of 1 in what they sum up: whole numbers have one sum in any order.
SKETCHES = 256
PARTS = 1024

_SEPARATOR = np.ones(256, bool)
_SEPARATOR[128:] = False
for _span in ((48, 58), (65, 91), (97, 123)):
    _SEPARATOR[slice(*_span)] = False


class _Terms:
    """The words of a block as hashes and as features."""

    def __init__(self, block: Block, settings: Settings):
        self.words = Words(block, _SEPARATOR, 1)
        at = np.arange(self.words.n)
        self.names = self.words.name(at, at + 1)
        self.features = (self.names & np.uint64(settings.features - 1)).astype(np.int64)


class _Passages:
    """The passages of a block: segments of ``stride`` words, each with the next ones of its text up to ``window`` words.

    first, stop, text: of segments; last: the last segment of the passage that begins with one; norm: square
    lengths of passages in all features; more: the passages that also hold the next segment, the one after it
    and so on."""

    def __init__(self, terms: _Terms, weight: np.ndarray, s: Settings):
        words = terms.words
        at = np.arange(words.n)
        begins = (at - words.ends[words.text]) % s.stride == 0
        self.first, self.segment = np.flatnonzero(begins), np.cumsum(begins) - 1
        self.text = text = words.text[self.first]
        self.stop = np.minimum(self.first + s.stride, words.ends[text + 1])
        w = weight[terms.features]
        own = np.add.reduceat(w * w, self.first)
        self.norm, self.last, self.more = own.copy(), np.arange(len(self.first)), []
        for k in range(1, max(1, s.window // s.stride)):
            rows = np.flatnonzero(text[:-k] == text[k:]) if len(text) > k else np.zeros(0, np.int64)
            self.more.append(rows)
            self.norm[rows] += own[rows + k]
            self.last[rows] = rows + k

    def sums(self, part: np.ndarray) -> np.ndarray:
        """Of the segments of each passage."""
        out = part.copy() if self.more else part
        for k, rows in enumerate(self.more, 1):
            out[rows] += part[rows + k]
        return out

    def spread(self, passages: np.ndarray) -> np.ndarray:
        """Of the passages that each segment lies in: the transpose of ``sums``."""
        out = passages.copy()
        for k, rows in enumerate(self.more, 1):
            out[rows + k] += passages[rows]
        return out


def _summed_rows(matrix: np.ndarray, row: np.ndarray, begin: np.ndarray, out: np.ndarray, into: np.ndarray) -> None:
    """Adds the rows ``row`` of a matrix, summed from each ``begin`` to the next, to the rows ``into``."""
    ends = np.append(begin, len(row))
    for a in range(0, len(begin), CACHED):  # so many at a time stay in the processor's cache
        b = min(a + CACHED, len(begin))
        out[into[a:b]] += np.add.reduceat(matrix[row[ends[a] : ends[b]]], begin[a:b] - ends[a], axis=0)


def _test_matrix(s: Settings) -> np.ndarray:
    return np.random.default_rng(6).standard_normal((s.features, s.sketch), np.float32)


def _sketched(terms: _Terms, weight: np.ndarray, wide: np.ndarray, total: np.ndarray, s: Settings) -> None:
    """Adds A'A times a random matrix to ``total``, A being the passages of a block at length 1; wide: that matrix times weights."""
    if not terms.words.n:
        return
    p = _Passages(terms, weight, s)
    part = np.zeros((len(p.first), s.sketch), np.float32)
    _summed_rows(wide, terms.features, p.first, part, np.arange(len(p.first)))
    part = p.spread(p.sums(part) / np.maximum(p.norm, 1e-12)[:, None].astype(np.float32))
    short = terms.features.astype(np.uint16 if s.features <= 1 << 16 else np.int64)  # sorted by their digits
    order = np.argsort(short, kind="stable")
    features = terms.features[order]
    begin = np.flatnonzero(np.diff(features, prepend=-1))
    sums = np.zeros((len(begin), s.sketch), np.float32)
    _summed_rows(part, p.segment[order], begin, sums, np.arange(len(begin)))
    found = features[begin]
    total[found] += sums * weight[found, None]


def _latent_axes(texts: DataFrame, weight: np.ndarray, s: Settings) -> np.ndarray:
    """(features x dimensions): the first right singular vectors of all passages of the corpus, of length 1 each.

    Randomised, in one pass: Z = A'A R for a random R is summed up over all partitions, and A'A is
    Z (R'Z)^-1 Z' but for what the sketch misses.  What is sent and summed up is bounded by the
    features times the columns of R, whatever the corpus."""
    h, k = s.features, s.sketch

    def sketch(batches):
        wide = _test_matrix(s) * weight[:, None].astype(np.float32)
        total = np.zeros((h, k))
        for batch in batches:
            for _, block in pieces(batch.column(0)):
                _sketched(_Terms(block, s), weight, wide, total, s)
        return np.rint(total.ravel() * PARTS).astype(np.int64)

    return _axes(summed(texts.coalesce(SKETCHES), sketch, h * k, "<i8").reshape(h, k) / PARTS, s)


def _axes(z: np.ndarray, s: Settings) -> np.ndarray:
    inner = _test_matrix(s).astype(float).T @ z
    size, turn = np.linalg.eigh((inner + inner.T) / 2)
    some = size > 1e-6 * max(1e-300, size.max(initial=0))
    if not some.any():
        return np.zeros((s.features, 0))
    axes, size, _ = np.linalg.svd(z @ (turn[:, some] / np.sqrt(size[some])), full_matrices=False)
    return axes[:, : s.latent][:, size[: s.latent] > 1e-6 * size[0]]


def _latent_space(passages: list[np.ndarray], axes: np.ndarray, weight: np.ndarray) -> dict | None:
    """The corpus's latent space with the items' passages folded in, as ``_spaces`` gives those of items alone."""
    basis = (axes * weight[:, None]).astype(np.float32)
    queries = np.array([basis[x].sum(axis=0) for x in passages], np.float32).reshape(len(passages), basis.shape[1])
    length = np.sqrt(np.einsum("ij,ij->i", queries, queries))
    owner = np.flatnonzero(length > 1e-6)
    if not len(owner):
        return None
    return {"basis": basis, "queries": queries[owner] / length[owner, None], "owner": owner, "used": np.arange(len(weight), dtype=np.int32), "latent": True}


def _document_frequency(texts: DataFrame, settings: Settings) -> tuple[np.ndarray, int]:
    h = settings.features

    def count(batches):
        total = np.zeros(h + 1, np.int64)
        for batch in batches:
            total[h] += batch.num_rows
            for _, block in pieces(batch.column(0)):
                terms = _Terms(block, settings)
                both = np.unique(terms.words.text * h + terms.features)
                total[:h] += np.bincount(both % h, minlength=h)
        return total

    found = summed(texts, count, h + 1, "<i8")
    return found[:h], int(found[h])


def _places(used: np.ndarray, settings: Settings) -> np.ndarray:
    """The row of a feature among those used, or -1."""
    place = np.full(settings.features, -1, np.int32)
    place[used] = np.arange(len(used))
    return place


def _spaces(passages: list[np.ndarray], weight: np.ndarray, settings: Settings) -> list[dict]:
    """Spaces of the items' passages alone (features of their words), ``rank`` passages each.

    They complete the corpus's latent space: what that one's low rank loses of an item is here.  A space has as many dimensions as its passages need, so it holds each of them whole and a
    cosine worked out in it is that of the unprojected vectors.  basis: (features of the space
    x dimensions), times the features' weights; queries: the passages, of length 1; owner:
    their numbers; used: the features of the space."""
    out = []
    for a in range(0, len(passages), settings.rank):
        group = passages[a : a + settings.rank]
        used = np.unique(np.concatenate(group))
        used = used[weight[used] > 0]
        place = _places(used, settings)
        rows = np.zeros((len(group), len(used)))
        for i, x in enumerate(group):
            np.add.at(rows[i], place[x[weight[x] > 0]], weight[x[weight[x] > 0]])
        length = np.sqrt((rows * rows).sum(axis=1))
        rows /= np.where(length > 0, length, 1)[:, None]
        _, size, axes = np.linalg.svd(rows, full_matrices=False)
        axes = axes[size > 1e-6 * max(1e-300, size.max(initial=0))]
        if len(axes):
            basis = (axes.T * weight[used, None]).astype(np.float32)
            queries = (rows @ axes.T).astype(np.float32)
            out.append({"basis": basis, "queries": queries, "owner": np.arange(a, a + len(group)), "used": used.astype(np.int32), "latent": False})
    return out


class _Item:
    """A sequence of word names, ready for the longest common subsequence with another one."""

    def __init__(self, names: list[int]):
        self.size, self.places, self.masks = len(names), {}, {}
        for i, x in enumerate(names):
            self.places.setdefault(x, []).append(i)

    def _mask(self, x: int) -> int:
        """The places of a word as bits; kept for short sequences, so memory stays linear."""
        found = sum(1 << i for i in self.places[x])
        if self.size <= 4096:
            self.masks[x] = found
        return found

    def in_order(self, names: list[int], least: float = 0) -> int:
        """Length of the longest common subsequence; 0 where it is surely below ``least``."""
        places = self.places
        shared = [x for x in names if x in places]
        if len(shared) < least:
            return 0
        v = full = (1 << self.size) - 1
        for x in shared:
            m = self.masks.get(x) or self._mask(x)
            u = v & m
            v = ((v + u) | (v - u)) & full
        return self.size - v.bit_count()


def _answer(text: str) -> str:
    """The last sentence of an item, or all of it."""
    parts = [p for p in re.split(r"[.!?]\s+|\n", text.strip()) if re.search(r"\w", p)]
    return parts[-1] if parts else text


def _names(texts: list[str], settings: Settings) -> list[list[int]]:
    out: list[list[int]] = []
    for _, block in pieces(pa.array([t.encode() for t in texts], pa.binary())):
        terms = _Terms(block, settings)
        out += [terms.names[a:b].tolist() for a, b in zip(terms.words.ends[:-1], terms.words.ends[1:])]
    return out


class _Rare:
    """The rarest words of items, some of which any text must hold that holds enough of an item.

    Of an item's words a leak may lack a share of 1 - least_common; of its so many rarest words
    and MORE it holds MORE at least.  Items of more than LONG words are not told apart by this."""

    MORE, LONG = 4, 256

    def __init__(self, names: list[list[int]], frequency: np.ndarray, s: Settings):
        features, item, need, size = [], [], [], []
        for i, x in enumerate(names):
            f = (np.array(x if len(x) <= self.LONG else [], np.uint64) & np.uint64(s.features - 1)).astype(np.int64)
            lacking = int((1 - s.least_common) * len(f) + 1e-9)
            rare = f[np.argsort(frequency[f], kind="stable")[: lacking + self.MORE]]
            features.append(rare)
            item.append(np.full(len(rare), i))
            need.append(len(rare) - lacking)
            size.append(len(x))
        self.long = np.flatnonzero(np.array(size) > self.LONG)
        self.everywhere = len(self.long) > 0
        self.need, self.size = np.array(need, np.int64), np.array(size, np.int64)
        f, i = (np.concatenate([np.zeros(0, np.int64), *x]) for x in (features, item))
        both, self.count = np.unique(f * max(1, len(names)) + i, return_counts=True)
        f, self.item = both // max(1, len(names)), both % max(1, len(names))
        self.first = np.searchsorted(f, np.arange(s.features + 1)).astype(np.int64)

    def near(self, terms: _Terms, s: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(which words of a block lie where an item may be; the stretches (item, first, stop) where one that is not long may be)."""
        words = terms.words
        n = (self.first[1:] - self.first[:-1])[terms.features]
        place = np.flatnonzero(n)
        n = n[place]
        which = np.repeat(self.first[terms.features[place]] - np.concatenate(([0], np.cumsum(n)[:-1])) if len(n) else n, n) + np.arange(n.sum())
        place, item = np.repeat(place, n), self.item[which]
        key = (words.text[place].astype(np.int64) * len(self.need) + item) * (words.n + 1)
        order = np.argsort(key + place, kind="stable")
        key, place, item = key[order], place[order], item[order]
        far = s.window + 2 * self.size[item]
        total = np.concatenate(([0], np.cumsum(self.count[which[order]])))
        stop = np.searchsorted(key + place, key + np.minimum(place + far, words.n), "right")
        ok = total[stop] - total[:-1] >= self.need[item]
        place, reach = place[ok], s.window + self.size[item[ok]]  # of the first rare word, to the ends of the passage
        first, stop = np.maximum(place - reach, 0), np.minimum(place + reach, words.n)
        edge = np.bincount(first, minlength=words.n + 1) - np.bincount(stop, minlength=words.n + 1)
        return (np.cumsum(edge)[:-1] > 0) | self.everywhere, item[ok], first, stop


class _Runs:
    """The runs of words of some items by their hashes, of one length."""

    def __init__(self, size: int, names: list[tuple[int, list[int]]]):
        self.size = size
        found = []
        for _, block_names in names:
            x = np.array(block_names, np.uint64)
            found.append(_run_hashes([x[i : len(x) - size + 1 + i] for i in range(size)]))
        self.item = np.repeat([i for i, _ in names], [len(f) for f in found])
        self.at = np.concatenate([np.arange(len(f)) for f in found])
        hashes = np.concatenate(found)
        order = np.argsort(hashes, kind="stable")
        self.hashes, self.item, self.at = hashes[order], self.item[order], self.at[order]
        self.known = np.zeros(1 << 20, bool)
        self.known[(self.hashes & np.uint64((1 << 20) - 1)).astype(np.int64)] = True

    def hits(self, terms: _Terms) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place, item, place in the item) of the runs of a block that are an item's."""
        words, n = terms.words, self.size
        at = np.arange(max(0, words.n - n + 1))
        at = at[words.text[at] == words.text[at + n - 1]]
        h = _run_hashes([terms.names[at + i] for i in range(n)])
        keep = self.known[(h & np.uint64((1 << 20) - 1)).astype(np.int64)]
        at, h = at[keep], h[keep]
        first, stop = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        count = stop - first
        begin = np.repeat(first - np.concatenate(([0], np.cumsum(count)[:-1])) if len(count) else first, count)
        which = begin + np.arange(count.sum())
        return np.repeat(at, count), self.item[which], self.at[which]


def _run_hashes(words: list[np.ndarray]) -> np.ndarray:
    h = np.zeros(len(words[0]), np.uint64)
    for i, x in enumerate(words):
        h = mixed(h * np.uint64(0x9E3779B97F4A7C15) + x + np.uint64(i + 1))
    return h


def _runs(names: list[list[int]], s: Settings) -> list[_Runs]:
    by_size: dict[int, list[tuple[int, list[int]]]] = {}
    for i, x in enumerate(names):
        if x:
            by_size.setdefault(min(s.run, len(x)), []).append((i, x))
    return [_Runs(size, found) for size, found in sorted(by_size.items())]


def find_leaks(
    docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings(), id_col="doc_id", text_col="text", item_col="item_id", item_text_col="text"
) -> DataFrame:
    """Rows (doc_id, item_id, cosine, common, answer): the benchmark items that documents hold.

    common and answer are the shares of the item's words and of its last sentence's words
    found in order in and around the best passage.  Whole texts are searched.  Null and empty
    texts and items match nothing; an empty corpus or benchmark gives no rows; repeated rows
    give repeated findings.  The benchmark is the query set: it is searched in blocks of
    ``settings.items`` items, so what a pass broadcasts is bounded.
    """
    spark = docs.sparkSession
    rows = docs.select(col(id_col).cast("long").alias("doc_id"), col(text_col).cast("string").cast("binary").alias("text"))
    out = spark.range(0).selectExpr("id doc_id", "id item_id", "cast(0 as double) cosine", "cast(0 as double) common", "cast(0 as double) answer")
    for find in _searches(rows.select("text"), benchmark, settings, item_col, item_text_col):

        def search(batches, find=find):
            for batch in batches:
                rows = [(batch.column(0)[i].as_py(), *x) for i, x in find(batch.column(1))]
                kinds = [pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.float64()]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["doc_id", "item_id", "cosine", "common", "answer"])

        out = out.unionByName(by_arrow(rows, search, "doc_id long, item_id long, cosine double, common double, answer double"))
    return out


def _searches(texts: DataFrame, benchmark: DataFrame, s: Settings, item_col: str = "item_id", item_text_col: str = "text") -> Iterator[Callable]:
    """For each block of items a function: a column of texts -> (row, (item_id, cosine, common, answer)) of what they hold."""
    items = benchmark.select(col(item_col).cast("long").alias("item_id"), col(item_text_col).cast("string").alias("text"))
    items = items.filter("text is not null and item_id is not null").dropDuplicates()
    n_items = items.count()
    frequency, n = _document_frequency(texts, s)
    weight = np.log((n + 1) / (frequency + 1)).clip(0) + s.least_weight
    blocks = -(-n_items // s.items)
    axes = _latent_axes(texts, weight, s) if blocks else None
    for b in range(blocks):
        shared = texts.sparkSession.sparkContext.broadcast(_model(items.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b), weight, frequency, s, axes))

        def find(column, shared=shared):
            m = shared.value
            for first, block in pieces(column):
                for (d, i), x in sorted(_matches(_Terms(block, s), weight, m, s).items()):
                    yield first + d, (m["ids"][i], *x)

        yield find


def _model(items: DataFrame, weight: np.ndarray, frequency: np.ndarray, s: Settings, axes: np.ndarray | None = None) -> dict:
    found = items.orderBy("item_id", "text").collect()
    names = _names([r["text"] for r in found], s)
    answers = _names([_answer(r["text"]) for r in found], s)
    passages, owner = [], []
    for i, x in enumerate(names):
        features = (np.array(x, np.uint64) & np.uint64(s.features - 1)).astype(np.int64)
        for a in range(0, max(1, len(x) - s.window // 2) if x else 0, s.window):
            passages.append(features[a : a + s.window])
            owner.append(i)
    latent = None if axes is None else _latent_space(passages, axes, weight)
    return {
        "spaces": [*([] if latent is None else [latent]), *_spaces(passages, weight, s)],
        "passages": passages,
        "owner": np.array(owner, np.int64),
        "ids": [r["item_id"] for r in found],
        "items": [_Item(x) for x in names],
        "answers": [_Item(x) for x in answers],
        "runs": _runs(names, s),
        "rare": _Rare(names, frequency, s),
        "names": [np.array(x, np.uint64) for x in names],
    }


def _near(features: np.ndarray, p: _Passages, where: np.ndarray, may: tuple, m: dict, space: dict, s: Settings):
    """(passage, item passage, cosine) of the pairs of a block and a space that are near enough.

    features: of each word; where: segments that may hold an item; may: (passage, item) of the pairs
    where one that is not long may be.  In the latent space, where much is near, only those are
    compared, and all passages with long items; the cosine is that of the projections there, in
    spaces of items' own passages that of the whole vectors."""
    row = _places(space["used"], s)[features]
    used = np.flatnonzero((row >= 0) & where[p.segment])
    if not len(used):
        return
    begin = np.flatnonzero(np.diff(p.segment[used], prepend=-1))
    part = np.zeros((len(p.norm), space["basis"].shape[1]), np.float32)
    _summed_rows(space["basis"], row[used], begin, part, p.segment[used[begin]])
    passage, least = p.sums(part), s.near if space["latent"] else s.least_cosine
    size = np.einsum("ij,ij->i", passage, passage)
    length = np.sqrt(np.maximum(size if space["latent"] else p.norm, 1e-12))
    rows, queries = np.flatnonzero(size >= (0.999 * least * length) ** 2), np.arange(len(space["owner"]))  # the others are too far from all
    if space["latent"]:
        items = m["owner"][space["owner"]]  # in ascending order, as items' passages are numbered
        first, stop = np.searchsorted(items, may[1], "left"), np.searchsorted(items, may[1], "right")
        n = stop - first
        at, query = np.repeat(may[0], n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())
        for a in range(0, len(at), COMPARED):
            i, q = at[a : a + COMPARED], query[a : a + COMPARED]
            cosine = np.einsum("ij,ij->i", passage[i], space["queries"][q]) / length[i]
            for k in np.flatnonzero(cosine >= least):
                yield i[k], space["owner"][q[k]], float(cosine[k])
        queries = np.flatnonzero(np.isin(items, m["rare"].long))
    for a in range(0, len(rows) if len(queries) else 0, COMPARED):
        some, least = rows[a : a + COMPARED], s.near_long if space["latent"] else s.least_cosine
        cosine = (passage[some] @ space["queries"][queries].T) / length[some, None]
        for i, q in zip(*np.nonzero(cosine >= least)):
            yield some[i], space["owner"][queries[q]], float(cosine[i, q])


def _matches(terms: _Terms, weight: np.ndarray, m: dict, s: Settings) -> dict:
    """(text, item) -> (cosine, common, answer) of the pairs that pass all three tests."""
    words = terms.words
    best: dict[tuple[int, int], tuple[float, float, float]] = {}
    if not words.n or not m["names"]:
        return best
    _by_spaces(terms, weight, m, s, best)
    for runs in m["runs"]:
        _by_runs(terms, runs, weight, m, s, best)
    return best


def _by_spaces(terms: _Terms, weight: np.ndarray, m: dict, s: Settings, best: dict) -> None:
    """Adds the items that a passage is near to, in the corpus's latent space or in one of items' own, after alignment."""
    p = _Passages(terms, weight, s)
    words, item, first, stop = m["rare"].near(terms, s)
    where = np.logical_or.reduceat(words, p.first)
    if not m["spaces"] or not where.any():
        return
    begin = p.segment[first]
    n = p.segment[stop - 1] - begin + 1
    passage = np.repeat(begin - (np.cumsum(n) - n), n) + np.arange(n.sum())
    passage, item = np.divmod(np.unique(passage * len(m["items"]) + np.repeat(item, n)), len(m["items"]))
    near = ((*x, space["latent"]) for space in m["spaces"] for x in _near(terms.features, p, where, (passage, item), m, space, s))
    seen = set()  # a long item's passages lead to the same stretch of text again and again
    for i, q, cosine, projected in near:
        item = int(m["owner"][q])
        wanted = m["items"][item]
        row = int(p.text[i])
        a = max(int(terms.words.ends[row]), int(p.first[i]) - wanted.size)
        b = min(int(terms.words.ends[row + 1]), int(p.stop[p.last[i]]) + wanted.size)
        if (item, a, b, projected) in seen:
            continue
        seen.add((item, a, b, projected))
        around = terms.names[a:b].tolist()
        common = wanted.in_order(around, s.least_common * wanted.size) / wanted.size
        if common < s.least_common:
            continue
        wanted = m["answers"][item]
        answer = wanted.in_order(around) / max(1, wanted.size)
        if answer < s.least_answer:
            continue
        if projected:  # common words alone are near to much in the latent space
            cosine = _cosine(terms.names[p.first[i] : p.stop[p.last[i]]], m["passages"][q].astype(np.uint64), weight, s)
        if cosine >= s.least_cosine:
            _keep(best, row, item, (cosine, common, answer))


def _keep(best: dict, row: int, item: int, got: tuple[float, float, float]) -> None:
    if got[1:] > best.get((row, item), (0, 0, 0))[1:]:
        best[row, item] = got


def _by_runs(terms: _Terms, runs: _Runs, weight: np.ndarray, m: dict, s: Settings, best: dict) -> None:
    """Adds the items whose runs of words a stretch of text holds often enough, after alignment."""
    words = terms.words
    place, item, at = runs.hits(terms)
    if not len(place):
        return
    size = np.array([x.size for x in m["items"]])[item]
    fixed = size < s.short  # every run in its place; of longer items some near each other
    need = np.where(fixed, size - runs.size + 1, np.maximum(1 + (size > runs.size + 1), (s.least_runs * (size - runs.size + 1)).astype(np.int64)))
    start = place - at
    where = np.where(fixed, start, place)
    order = np.lexsort((where, item, words.text[place]))
    place, item, size, fixed, need, start, where = (x[order] for x in (place, item, size, fixed, need, start, where))
    text = words.text[place]
    last = np.arange(len(place)) + need - 1
    ok = last < len(place)
    last = np.minimum(last, len(place) - 1)
    ok &= (text[last] == text) & (item[last] == item) & (where[last] - where <= np.where(fixed, 0, size))
    seen: dict[tuple[int, int], int] = {}
    for k in np.flatnonzero(ok):
        row, i, wanted = int(text[k]), int(item[k]), m["items"][int(item[k])]
        slack = 0 if fixed[k] else wanted.size // 2
        a = max(int(words.ends[row]), int(start[k]) - slack)
        b = min(int(words.ends[row + 1]), int(start[k]) + wanted.size + slack)
        if seen.get((row, i), -1) >= b or best.get((row, i), (0, 0, 0))[1] == 1.0:
            continue
        seen[row, i] = b
        around = terms.names[a:b].tolist()
        common = wanted.in_order(around, s.least_common * wanted.size) / wanted.size
        answer = m["answers"][i].in_order(around) / max(1, m["answers"][i].size)
        if common >= (1.0 if fixed[k] else s.least_common) and answer >= s.least_answer:
            _keep(best, row, i, (_cosine(terms.names[a:b], m["names"][i], weight, s), common, answer))


def _cosine(a: np.ndarray, b: np.ndarray, weight: np.ndarray, s: Settings) -> float:
    """Of two runs of words as TF-IDF vectors."""
    x, y = (np.bincount((v & np.uint64(s.features - 1)).astype(np.int64), minlength=s.features) * weight for v in (a, b))
    return float(x @ y / max(1e-300, np.sqrt((x @ x) * (y @ y))))


def drop_leaks(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``docs`` without the rows whose text holds a benchmark item.

    Each row is judged by its own text, whatever its doc_id: rows without an id go too where
    they hold an item, and of rows that share an id those that hold none stay."""
    place = docs.columns.index("text")
    for find in _searches(docs.select(col("text").cast("string").cast("binary").alias("text")), benchmark, settings):

        def keep(batches, find=find):
            for batch in batches:
                mask = np.ones(batch.num_rows, bool)
                mask[[i for i, _ in find(batch.column(place).cast(pa.binary()))]] = False
                yield batch.filter(pa.array(mask))

        docs = by_arrow(docs, keep, docs.schema)
    return docs

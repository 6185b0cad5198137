"""Cross references: names of a dictionary, of any shape and number, found in whole texts.

A name matches where both of its ends lie between a word character and any other one.  Runs
of word characters and the runs between them are tokens, so a match is a run of whole tokens
that spells the name: dictionary matching is an equality join of token runs.  Which runs can
be names is told by a bit table of bounded size that hashes all names, so one pass over the
texts serves a dictionary of any size; what it lets through is joined with the names themselves.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F



#: Texts that a task makes strings of at a time.
TEXTS = 256


@dataclass(frozen=True)
class Settings:
    """a_name: bits of the table a name; least, most: powers of two that the table lies between;
    longest: of names of more tokens the table knows so many and how many there are;
    characters: looked at together, about."""

    a_name: int = 16
    least: int = 16
    most: int = 26
    longest: int = 64
    characters: int = 1 << 20


_BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(_BASE, -1, 1 << 64)


@cache
def _word_table() -> np.ndarray:
    """Which code points are word characters: letters, marks without width, digits, connectors."""
    return np.array([(k := unicodedata.category(chr(c)))[0] == "L" or k in ("Mn", "Nd", "Pc") for c in range(0x110000)])


@cache
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for base in (_BASE, _INVERSE):
        x = np.full(n, base, np.uint64)
        x[0] = 1
        out.append(np.multiply.accumulate(x))
    return out[0], out[1]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class _Tokens:
    """The tokens of some texts, and hashes of runs of them."""

    def __init__(self, texts: list[str]):
        joined = "".join(texts)
        codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
        self.ends = np.concatenate(([0], np.cumsum([len(t) for t in texts], dtype=np.int64)))
        self.word = _word_table()[codes]
        starts = np.ones(len(codes), bool)
        starts[1:] = self.word[1:] != self.word[:-1]
        starts[self.ends[:-1][self.ends[:-1] < len(codes)]] = True
        self.first = np.flatnonzero(starts)  # characters that begin tokens
        self.stop = np.append(self.first[1:], len(codes))
        self.text = np.searchsorted(self.ends, self.first, "right") - 1
        power, self.inverse = _powers(1 << max(10, int(len(codes)).bit_length()))
        self.sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((codes.astype(np.uint64) + np.uint64(1)) * power[: len(codes)], dtype=np.uint64)))

    def hashes(self, at: np.ndarray, size: int) -> np.ndarray:
        """Of the runs of ``size`` tokens that begin with tokens ``at``."""
        a, b = self.first[at], self.stop[at + size - 1]
        return _mixed((self.sums[b] - self.sums[a]) * self.inverse[a] + np.uint64(size))


def _entries(tokens: _Tokens, at: np.ndarray, sizes: np.ndarray, bits: int) -> np.ndarray:
    """Entries of the bit table for names that begin with tokens ``at``: one says that a name of so
    many tokens begins with that token, another one which name it is."""
    mask = np.uint64((1 << bits) - 1)
    out = [np.zeros(0, np.uint64)]
    for size in np.unique(sizes):
        mine = at[sizes == size]
        out += [_gate(tokens.hashes(mine, 1), int(size), mask), tokens.hashes(mine, int(size)) & mask]
    return np.unique(np.concatenate(out))


def _gate(first: np.ndarray, size: int, mask: np.uint64) -> np.ndarray:
    return _mixed(first + np.uint64(size * 0x94D049BB133111EB % (1 << 64))) & mask


def _filter(names: DataFrame, s: Settings) -> tuple[np.ndarray, list[int], int]:
    """(bit table, numbers of tokens that names have, bits): bounded, whatever the number of names."""
    n = names.count()
    bits = min(s.most, max(s.least, (s.a_name * max(1, n)).bit_length()))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, sizes = np.zeros(1 << bits, bool), set()
        for batch in batches:
            if batch.num_rows:
                tokens = _Tokens(batch.column(0).to_pylist())
                at = np.searchsorted(tokens.first, tokens.ends[:-1])
                count = np.diff(np.append(at, len(tokens.first)))
                table[_entries(tokens, at, np.minimum(count, s.longest), bits).astype(np.int64)] = True
                sizes.update(count.tolist())
        words = np.packbits(table, bitorder="little").view("<i8")
        used = np.flatnonzero(words)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, np.full(len(sizes), -1))), pa.array(np.append(words[used], np.array(sorted(sizes), np.int64)))], names=["word", "bits"])

    found = names.mapInArrow(build, "word long, bits long").groupBy("word", F.when(F.col("word") < 0, F.col("bits")).alias("size")).agg(F.bit_or("bits").alias("bits")).toArrow()
    word, value = found["word"].to_numpy(), found["bits"].to_numpy()
    words = np.zeros(1 << (bits - 6), "<i8")
    words[word[word >= 0]] = value[word >= 0]
    return words, sorted(value[word < 0].tolist()), bits


def _pieces(ids: list, texts: list[str], characters: int) -> Iterator[tuple[list, list[str]]]:
    a, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= characters or i == len(texts) - 1:
            yield ids[a : i + 1], texts[a : i + 1]
            a, size = i + 1, 0


def _candidates(texts: list[str], table: np.ndarray, sizes: list[int], bits: int, longest: int) -> Iterator[tuple[int, int, int]]:
    """(text, offset, length) of the runs of tokens that the bit table takes for names, by text and length of run."""
    t = _Tokens(texts)
    mask = np.uint64((1 << bits) - 1)
    n = len(t.first)
    at_start, at_end = np.zeros(n, bool), np.zeros(n, bool)  # tokens that no word character borders on
    bound = np.flatnonzero(np.diff(t.text, prepend=-1, append=len(texts)))
    at_start[bound[:-1]] = at_end[bound[1:] - 1] = True
    between = ~t.word[t.first] if n else np.zeros(0, bool)
    every = np.arange(n)
    first = t.hashes(every, 1) if n else np.zeros(0, np.uint64)

    def known(h: np.ndarray) -> np.ndarray:
        h = h.astype(np.int64)
        return (table[h >> 6] >> (h & 63)) & 1 == 1

    for size in sizes:
        begin = min(size, longest)
        at = every[known(_gate(first, begin, mask))]
        at = at[at + size <= n]
        last = at + size - 1
        good = (t.text[last] == t.text[at]) & ~(at_start[at] & between[at]) & ~(at_end[last] & between[last])
        at = at[good]
        at = at[known(t.hashes(at, begin) & mask)]
        last, text = at + size - 1, t.text[at]
        yield from zip(text.tolist(), (t.first[at] - t.ends[text]).tolist(), (t.stop[last] - t.first[at]).tolist())


def _occurrences(texts: DataFrame, names: DataFrame, rows, schema: str, s: Settings) -> DataFrame:
    """rows(ids, texts, candidates) of each piece of the texts, as a DataFrame; no names give none."""
    names = names.select("name").filter("name <> ''").distinct()
    table, sizes, bits = _filter(names, s)
    shared = texts.sparkSession.sparkContext.broadcast(table)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = (batch.slice(a, TEXTS) for a in range(0, batch.num_rows, TEXTS))
            for ids, own in (x for part in parts for x in _pieces(part.column(0).to_pylist(), part.column(1).to_pylist(), s.characters)):
                out = rows(ids, own, _alone(own, _candidates(own, shared.value, sizes, bits, s.longest))) if sizes else []
                kinds = [batch.schema.field(0).type, *_KINDS[schema]]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out) if out else [[]] * len(kinds), kinds)], names=["id", *_NAMES[schema]])

    kind = texts.schema["id"].dataType.simpleString()
    return texts.select("id", "t").filter("t is not null").mapInArrow(scan, f"id {kind}, {schema}").join(names, "name", "left_semi")


def _alone(texts: list[str], found: Iterator[tuple[int, int, int]]) -> Iterator[tuple[int, int, str]]:
    """(text, offset, name): of occurrences of one name that overlap, the first."""
    free: dict[tuple[int, str], int] = {}
    for text, offset, length in found:
        name = texts[text][offset : offset + length]
        if free.get((text, name), 0) <= offset:
            free[text, name] = offset + length
            yield text, offset, name


_COUNT, _PLACE = "name string, n long", "name string, offset long, length long, context string, bracketed boolean"
_NAMES = {s: [p.split()[0] for p in s.split(", ")] for s in (_COUNT, _PLACE)}
_KINDS = {_COUNT: [pa.string(), pa.int64()], _PLACE: [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()]}


def counted(texts: DataFrame, names: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """(id, name, n): how often each name (name) occurs in each text (id, t), whole words alone.

    Names may hold blanks, dots, brackets or anything else; empty and null ones are none.
    Occurrences of different names that overlap each count; of one name those do that follow
    each other.  Null texts hold nothing; ids that repeat are texts each."""

    def rows(ids, own, found):
        count: dict[tuple[int, str], int] = {}
        for text, _, name in found:
            count[text, name] = count.get((text, name), 0) + 1
        return [(ids[text], name, n) for (text, name), n in count.items()]

    return _occurrences(texts, names, rows, _COUNT, settings).select("id", "name", "n")


def strengths(texts: DataFrame, names: DataFrame, most: int = 10) -> DataFrame:
    """(src, dst, strength) between components (id, name): references, ``most`` at most; a
    component does not refer to itself, and Configuration is never a target."""
    targets = names.filter("type <> 'Configuration'").select("name", F.col("id").alias("dst"))
    found = counted(texts, targets).join(targets, "name")
    return found.filter("id <> dst").select(F.col("id").alias("src"), "dst", F.least("n", F.lit(most)).cast("double").alias("strength"))


def _places(texts: DataFrame, names: DataFrame, before: int = 20, after: int = 50, settings: Settings = Settings()) -> DataFrame:
    def rows(ids, own, found):
        out = []
        for text, offset, name in found:
            t, stop = own[text], offset + len(name)
            around = t[max(0, offset - before) : offset + after].replace("\n", " ").strip()
            out.append((ids[text], name, offset, len(name), around, t[max(0, offset - 1) : offset] == "[" or t[stop : stop + 1] == "]"))
        return out

    return _occurrences(texts, names, rows, _PLACE, settings)


def places(texts: DataFrame, names: DataFrame, before: int = 20, after: int = 50, settings: Settings = Settings()) -> DataFrame:
    """(id, name, offset, length, context) of each occurrence that ``counted`` counts."""
    return _places(texts, names, before, after, settings).select("id", "name", "offset", "length", "context")


def enriched(texts: DataFrame, links: DataFrame) -> DataFrame:
    """(id, t): every text with the names of ``links`` (name, target) made Markdown links.

    Longer names go first, of names of one length the lesser; what lies in a link made before
    stays as it is, and so do names with ``[`` before or ``]`` behind them.  The least target of
    a name counts, a null one none.  ids of the texts must be unique."""
    links = links.filter("target is not null").groupBy("name").agg(F.min("target").alias("target"))
    found = _places(texts, links.select("name"), 0, 0).filter("not bracketed").join(links, "name")
    found = found.groupBy("id").agg(F.collect_list(F.struct("offset", "name", "target")).alias("found"))
    rows = texts.select("id", "t").join(found, "id", "left")

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a in range(0, batch.num_rows, TEXTS):
                part = batch.slice(a, TEXTS)
                done = [t if not f else _linked(t, [tuple(x.values()) for x in f]) for t, f in zip(part.column(1).to_pylist(), part.column(2).to_pylist())]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(done, pa.string())], names=["id", "t"])

    return rows.mapInArrow(link, f"id {texts.schema['id'].dataType.simpleString()}, t string")


def _linked(text: str, found: list[tuple[int, str, str]]) -> str:
    taken = np.zeros(len(text), bool)
    kept = []
    for offset, name, target in sorted(found, key=lambda f: (-len(f[1]), f[1], f[0])):
        own = slice(offset, offset + len(name))
        if not taken[own].any():
            taken[own] = True
            kept.append((offset, name, target))
    out, at = [], 0
    for offset, name, target in sorted(kept):
        out += [text[at:offset], f"[{name}]({target})"]
        at = offset + len(name)
    return "".join(out) + text[at:]


def linked(text: Column, links: dict[str, str]) -> Column:
    """``enriched`` for a few names known to the caller, as one expression."""
    for name, target in sorted(links.items(), key=lambda x: (-len(x[0]), x[0])):
        text = F.regexp_replace(text, rf"(?<!\[)\b{re.escape(name)}\b(?!\])", f"[{name}]({target})")
    return text

"""Byte-level BPE encoding of Arrow text columns with the tokenizers library.

The library's pre-tokenizer cuts a text into words that are encoded on their own, and the
same words come again and again.  Texts whose characters all lie below U+0250 are therefore
cut with vectorised rules equal to the pre-tokenizer's pattern, and each new word is encoded
once by the library and remembered by its bytes; any other text goes to the library whole.
"""

from __future__ import annotations

import os
import unicodedata

import numpy as np
import pyarrow as pa

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

_LETTER, _NUMBER, _SPACE, _OTHER, _ODD = 1, 2, 3, 4, 5
_LIMIT = 0x250
#: Bytes of text handled at a time; ids of known words, and number and bytes of long known
#: words, beyond any of which all are forgotten.
PIECE, MOST_IDS, MOST_WORDS, MOST_BYTES = 1 << 18, 1 << 24, 1 << 17, 1 << 25
#: Slots, as a power of two, of the table of words of 16 bytes at most, which are compared as two numbers.
SLOT_BITS = 21
_FACTOR = np.uint64(0x9E3779B97F4A7C15)
_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def _classes() -> np.ndarray:
    kind = np.full(0x800, _ODD, np.uint8)
    for code in range(_LIMIT):
        major = unicodedata.category(chr(code))[0]
        kind[code] = {"L": _LETTER, "N": _NUMBER}.get(major, _OTHER)
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    kind[[0x85, 0xA0]] = _ODD  # white space of two bytes: left to the library
    return kind


_KIND = _classes()
_BYTE_KIND = np.concatenate([_KIND[:128], np.full(128, _ODD, np.uint8)])
class Encoder:
    """Encodes columns of text; one per Python worker and tokenizer file."""

    _known: dict[str, Encoder] = {}

    @classmethod
    def of(cls, path: str) -> Encoder:
        if path not in cls._known:
            cls._known[path] = cls(path)
        return cls._known[path]

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.library.encode_special_tokens = True  # their strings inside a text are ordinary text
        self._forget()

    def _forget(self) -> None:
        # a row: the word as two numbers; its size, its number of ids and their place in the pool
        self.table = np.zeros((1 << SLOT_BITS, 3), np.uint64)
        self.known: dict[bytes, tuple[int, int]] = {}  # the same for longer words
        self.pool, self.used, self.bytes = np.empty(1 << 16, np.int32), 0, 0

    def pieces(self, texts: pa.StringArray):
        """(first, number) of runs of rows of about PIECE bytes."""
        offsets = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
        first = 0
        while first < len(texts):
            last = int(np.searchsorted(offsets, offsets[first] + PIECE, "right")) - 1
            last = min(len(texts), max(first + 1, last))
            yield first, last - first
            first = last

    def encode(self, texts: pa.StringArray, end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, offsets) of the texts, each closed by end_id."""
        n = len(texts)
        texts = pa.concat_arrays([texts]) if texts.offset == 0 else pa.array(texts.to_pylist(), pa.string())
        raw = np.frombuffer(texts.buffers()[1], np.int32, n + 1).astype(np.int64)
        data = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[raw[0] : raw[-1]] if raw[-1] > raw[0] else np.empty(0, np.uint8)
        ends = raw - raw[0]
        kind, odd = self._kinds(data, ends)
        start = self._cuts(data, kind, ends)
        first = np.flatnonzero(start)
        stop = np.append(first[1:], len(data))
        doc = np.searchsorted(ends, first, "right") - 1
        if odd.any():
            keep = ~odd[doc]
            first, stop, doc = first[keep], stop[keep], doc[keep]
        sizes, where = self._look_up(data, first, stop)
        per_doc = np.bincount(doc, sizes, n).astype(np.int64) if len(doc) else np.zeros(n, np.int64)
        whole = {}
        for i in np.flatnonzero(odd).tolist():
            whole[i] = self.library.encode(texts[i].as_py(), add_special_tokens=False).ids
            per_doc[i] = len(whole[i])
        offsets = np.zeros(n + 1, np.int64)
        np.cumsum(per_doc + 1, out=offsets[1:])
        out = np.full(offsets[-1], end_id, np.int32)
        total = int(sizes.sum())
        if total:
            before = np.cumsum(sizes) - sizes
            word = np.repeat(np.arange(len(sizes)), sizes)
            step = np.arange(total)
            skipped = offsets[doc] - (np.cumsum(per_doc * ~odd) - per_doc * ~odd)[doc]  # end ids and odd texts so far
            out[step + skipped[word]] = self.pool[step + (where - before)[word]]
        for i, ids in whole.items():
            out[offsets[i] : offsets[i + 1] - 1] = ids
        if self.used > MOST_IDS or len(self.known) > MOST_WORDS or self.bytes > MOST_BYTES:
            self._forget()
        return out, offsets

    def _kinds(self, data, ends):
        """The class of each byte's character, and the rows with a character of no known class."""
        kind = _BYTE_KIND[data]
        lead = np.flatnonzero((data >= 0xC2) & (data < 0xE0))
        if len(lead):
            code = ((data[lead].astype(np.int32) & 31) << 6) | (data[lead + 1] & 63)
            kind[lead] = kind[lead + 1] = _KIND[code]
        odd = np.zeros(len(ends) - 1, bool)
        odd[np.searchsorted(ends, np.flatnonzero(kind == _ODD), "right") - 1] = True
        return kind, odd

    @staticmethod
    def _cuts(data, kind, ends):
        """True at each byte that begins a word of
        's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+"""
        start = np.ones(len(data), bool)
        if not len(data):
            return start
        start[1:] = kind[1:] != kind[:-1]
        edge = np.zeros(len(data) + 1, bool)
        edge[ends] = True
        after = np.flatnonzero((kind[1:] != _SPACE) & (kind[:-1] == _SPACE) & ~edge[1:-1]) + 1
        start[after - 1] = True  # the last white space of a run stands alone or joins what follows
        start[after] = data[after - 1] != 32
        start[ends[:-1][ends[:-1] < len(data)]] = True
        quote = np.flatnonzero((data == 39) & start)
        if len(quote):
            stop = ends[np.searchsorted(ends, quote, "right")]
            one = np.where(quote + 1 < stop, data[np.minimum(quote + 1, len(data) - 1)], 0)
            two = np.where(quote + 2 < stop, data[np.minimum(quote + 2, len(data) - 1)], 0)
            short = np.isin(one, np.frombuffer(b"stmd", np.uint8))
            long = ((one == 114) & (two == 101)) | ((one == 118) & (two == 101)) | ((one == 108) & (two == 108))
            for found, size in ((short, 2), (long, 3)):
                q, s = quote[found], stop[found]
                start[q + 1] = False
                then = q + size
                start[then[then < s]] = True
        return start

    def _look_up(self, data, first, stop):
        """Sizes and places in the pool of the words' ids."""
        size = stop - first
        eights = np.ndarray((len(data) + 1,), "<u8", buffer=np.concatenate([data, np.zeros(8, np.uint8)]), strides=(1,))
        one = eights[first] & _MASKS[np.minimum(size, 8)]
        two = eights[np.minimum(first + 8, len(data))] & _MASKS[np.clip(size - 8, 0, 8)]
        slot = (((one * _FACTOR) ^ two ^ size.astype(np.uint64)) * _FACTOR) >> np.uint64(64 - SLOT_BITS)
        slot = slot.astype(np.int64)
        row = self.table[slot]
        what = row[:, 2]
        hit = (row[:, 0] == one) & (row[:, 1] == two) & ((what >> np.uint64(48)).astype(np.int64) == size)
        count, place = ((what >> np.uint64(32)) & np.uint64(0xFFFF)).astype(np.int64), (what & np.uint64(0xFFFFFFFF)).astype(np.int64)
        rest = np.flatnonzero(~hit)
        if not len(rest):
            return count, place
        text = data.tobytes()
        words = [text[a:b] for a, b in zip(first[rest].tolist(), stop[rest].tolist())]
        new = [w for w in dict.fromkeys(words) if w not in self.known]
        ids = [x.ids for x in self.library.encode_batch_fast([w.decode() for w in new], add_special_tokens=False)]
        many = np.fromiter(map(len, ids), np.int64, len(ids))
        need = self.used + int(many.sum())
        if need > len(self.pool):
            self.pool = np.concatenate([self.pool, np.empty(max(need, len(self.pool)), np.int32)])
        self.pool[self.used : need] = np.fromiter((i for x in ids for i in x), np.int32, need - self.used)
        where = dict(zip(new, zip((self.used + np.cumsum(many) - many).tolist(), many.tolist())))
        self.used = need
        found = np.array([where.get(w) or self.known[w] for w in words], np.int64).reshape(-1, 2)
        place[rest], count[rest] = found[:, 0], found[:, 1]
        long = [w for w in new if len(w) > 16]
        self.known.update((w, where[w]) for w in long)
        self.bytes += sum(map(len, long))
        put = rest[size[rest] <= 16]
        at = slot[put]
        self.table[at, 0], self.table[at, 1] = one[put], two[put]
        self.table[at, 2] = (size[put] << 48 | count[put] << 32 | place[put]).astype(np.uint64)
        return count, place

"""Byte-level BPE of many texts at once: pieces are cut and looked up in numpy, and only new ones are merged.

public_tokenizers.PATTERN cuts a text into runs of letters, of numbers and of other characters, each with
one space before it if there is one, the short English endings after an apostrophe, and runs of white space.
"""

from __future__ import annotations

import os
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import regex
from tokenizers import Regex, pre_tokenizers

from .common import lane, lanes, lanes_within, span_hashes, utf8

#: Slots of a worker's table of pieces; it starts anew when half of them are in use.
TABLE_BITS = 21
#: Bytes of a piece that the table takes; longer ones, which are rare, are merged whenever they are met.
PIECE_BYTES = 64
#: The endings of the pattern, after an apostrophe.
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
WHITE, LETTER, NUMBER, OTHER, UNKNOWN = range(5)


class Classes:
    """The class of each code point as the tokenizer libraries' patterns have it, found when first met.

    The regex module knows a later Unicode than they do, so letters and numbers are asked of them.
    """

    def __init__(self) -> None:
        self.table = np.full(0x110000, UNKNOWN, np.uint8)
        self.white, self.letter, self.number = (regex.compile(p) for p in (r"\s", r"\p{L}", r"\p{N}"))
        self.theirs = pre_tokenizers.Split(Regex(r"[\p{L}\p{N}]"), "removed")

    def __call__(self, points: np.ndarray) -> np.ndarray:
        out = self.table[points]
        if (out == UNKNOWN).any():
            for c in np.unique(points[out == UNKNOWN]).tolist():
                self.table[c] = self._of(chr(c))
            out = self.table[points]
        return out

    def _of(self, c: str) -> int:
        if self.white.match(c):
            return WHITE
        kind = LETTER if self.letter.match(c) else NUMBER if self.number.match(c) else OTHER
        return OTHER if kind != OTHER and self.theirs.pre_tokenize_str(c) else kind


def piece_starts(points: np.ndarray, at: np.ndarray, kinds: np.ndarray) -> np.ndarray:
    """Where the pieces of the pattern start in code points of several documents, which start at `at`."""
    n = len(points)
    first = np.zeros(n + 1, bool)
    first[at] = True
    first = first[:n]
    white = kinds == WHITE
    start = first.copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    joined = start & ~white & ~first  # the space before a run belongs to it
    joined[1:] &= points[:-1] == 32
    start &= ~joined
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:]  # the last of several white spaces before a run
    quote = np.flatnonzero(start & (points == 39))
    end_of = np.append(at[1:], n)[np.searchsorted(at, quote, "right") - 1] if len(quote) else quote
    for ending in ENDINGS:
        fits = quote + len(ending) < end_of
        for k, c in enumerate(ending, 1):
            fits[fits] = points[quote[fits] + k] == ord(c)
        start[quote[fits] + 1] = False
        after = quote[fits] + len(ending) + 1
        start[after[after < n]] = True
    return np.flatnonzero(start)


class PieceTable:
    """Open-addressing table from a piece to its ids, looked up for many at once: by hash, then the bytes are compared."""

    def __init__(self, bits: int = TABLE_BITS):
        self.bits, self.mask = bits, (1 << bits) - 1
        self.clear()

    def clear(self) -> None:
        self.keys = np.zeros(1 << self.bits, np.uint64)
        self.value = np.full(1 << self.bits, -1, np.int32)
        self.used, self.probes = 0, 1
        self.ids, self.bytes = Spans(self.room, np.uint32), Spans(self.room, np.uint8)

    @property
    def room(self) -> int:
        """Pieces that it holds at most."""
        return 1 << self.bits - 1

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The entry with each key, -1 where there is none."""
        slot = (keys >> np.uint64(64 - self.bits)).astype(np.int64)
        out = np.where(self.keys[slot] == keys, self.value[slot], -1)
        rest = np.flatnonzero((out < 0) & (self.value[slot] >= 0))
        slot = slot[rest]
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            slot = (slot + 1) & self.mask
            value = self.value[slot]
            hit = (self.keys[slot] == keys[rest]) & (value >= 0)
            out[rest[hit]] = value[hit]
            go = ~hit & (value >= 0)
            rest, slot = rest[go], slot[go]
        return out

    def same(self, entries: np.ndarray, view: np.ndarray, lo: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Whether the entries are of the very bytes of the spans (lanes, start, length)."""
        out = self.bytes.size[entries] == n
        own, rest, done = lanes_within(self.bytes.flat), np.flatnonzero(out), 0
        while len(rest):
            left = n[rest] - done
            equal = lane(own, self.bytes.start[entries[rest]] + done, left) == lane(view, lo[rest] + done, left)
            out[rest[~equal]] = False
            rest, done = rest[equal & (left > 8)], done + 8
        return out

    def add(self, keys: np.ndarray, pieces: list[bytes], ids: list[np.ndarray]) -> None:
        """Add keys that aren't there, with their pieces and ids."""
        new = np.arange(self.used, self.used + len(keys), dtype=np.int32)
        self.ids.add(ids)
        self.bytes.add([np.frombuffer(p, np.uint8) for p in pieces])
        self.used += len(keys)
        slot, left, probes = (keys >> np.uint64(64 - self.bits)).astype(np.int64), np.arange(len(keys)), 0
        while len(left):
            probes += 1
            free = left[self.value[slot[left]] < 0]
            self.keys[slot[free]], self.value[slot[free]] = keys[free], new[free]  # of several for one slot the last one wins
            left = left[self.value[slot[left]] != new[left]]
            slot[left] = (slot[left] + 1) & self.mask
        self.probes = max(self.probes, probes)


class Spans:
    """Arrays by number, end to end."""

    def __init__(self, room: int, kind: type):
        self.start, self.size = np.zeros(room, np.int32), np.zeros(room, np.int32)
        self.flat, self.filled, self.used = np.zeros(1 << 16, kind), 0, 0

    def add(self, arrays: list[np.ndarray]) -> None:
        size = np.fromiter(map(len, arrays), np.int64, len(arrays))
        new = slice(self.used, self.used + len(arrays))
        self.size[new], self.start[new] = size, self.filled + np.cumsum(size) - size
        end = self.filled + int(size.sum())
        while end + 8 > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.filled : end] = np.concatenate(arrays)
        self.used, self.filled = new.stop, end


class Encoder:
    """Ids of whole texts. encode_many gives the ids of pieces, each merged on its own."""

    def __init__(self, encode_many: Callable[[list[str]], list[np.ndarray]], bits: int = TABLE_BITS):
        self.encode_many, self.classes, self.table = encode_many, Classes(), PieceTable(bits)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row (uint32), and where the ids of each text start and the last one's end.

        A piece is taken from the table only where its bytes are those of the entry; a long one, and one
        whose hash another piece has, is merged here.
        """
        raw, at = utf8(texts)
        points = np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
        byte_of = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        starts = piece_starts(points, np.searchsorted(byte_of, at), self.classes(points))
        lo = byte_of[starts]
        hi = np.append(lo[1:], len(raw))[: len(lo)]
        entry = self._entries(raw, lo, hi)
        flat, start, size = self.table.ids.flat, self.table.ids.start[entry].astype(np.int64), self.table.ids.size[entry].astype(np.int64)
        other = np.flatnonzero(entry < 0)
        if len(other):
            pieces = [raw[lo[i] : hi[i]].tobytes() for i in other.tolist()]
            place = {p: k for k, p in enumerate(dict.fromkeys(pieces))}
            own = self.encode_many([p.decode() for p in place])
            n = np.fromiter(map(len, own), np.int64, len(own))
            which = np.array([place[p] for p in pieces])
            start[other], size[other] = len(flat) + (np.cumsum(n) - n)[which], n[which]
            flat = np.concatenate([flat, *own])
        last = np.concatenate([[0], np.cumsum(size)])
        ids = flat[np.arange(last[-1]) + np.repeat(start - last[:-1], size)]
        return ids, last[np.searchsorted(lo, at)]

    def _entries(self, raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The table's entry of each piece, which is added where it is new; -1 for those that can't be in the table."""
        out = np.full(len(lo), -1, np.int64)
        short = np.flatnonzero(hi - lo <= PIECE_BYTES)
        lo, hi = lo[short], hi[short]
        keys = span_hashes(raw, lo, hi)
        found = self.table.find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            if self.table.used + len(new) > self.table.room:
                self.table.clear()
                new, where = np.unique(keys, return_index=True)
                missing = np.arange(len(keys))
            while len(new) > self.table.room:  # one text with more pieces than the table holds
                self.table = PieceTable(self.table.bits + 1)
            pieces = [raw[lo[i] : hi[i]].tobytes() for i in missing[where].tolist()]
            self.table.add(new, pieces, self.encode_many([p.decode() for p in pieces]))
            found[missing] = self.table.find(keys[missing])
        same = self.table.same(found, lanes(raw), lo, hi - lo)
        out[short[same]] = found[same]
        return out


_library: dict[tuple[str, int], Encoder] = {}


def library_encoder(path: str, bits: int = TABLE_BITS) -> Encoder:
    """The encoder of a byte-level tokenizer file of the tokenizers library, one per Python worker."""
    if (path, bits) not in _library:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        from tokenizers import Tokenizer

        tokenizer = Tokenizer.from_file(path)
        tokenizer.encode_special_tokens = True

        def encode_many(pieces: list[str]) -> list[np.ndarray]:
            return [np.array(e.ids, np.uint32) for e in tokenizer.encode_batch_fast(pieces, add_special_tokens=False)]

        _library[path, bits] = Encoder(encode_many, bits)
    return _library[path, bits]

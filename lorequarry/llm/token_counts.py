"""Operator 12: token counts by byte-pair merging with a heap and a linked list, without ids.

A word's symbols stand in a doubly linked list. A heap holds the ranks of adjacent pairs; the lowest is
popped again and again and its pair merged, and pairs whose symbols have changed since are passed over. The
count is the number of initial symbols less the merges.

The tokenizer's own normaliser and pattern never look beyond white space, so a text's count is the sum of the
counts of its words `[^\\x20\\x09-\\x0D]+`. A worker keeps the counts of the words that it has met in a table
of fixed size, in which words are compared by their bytes.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import chunks, lanes, span_hashes, tidied, utf8, words
from .pretokens import PIECE_BYTES, PieceTable

#: Slots of a worker's table of words (90 MB); it starts anew when half of them are in use.
TABLE_BITS = 21
#: Pieces of words whose counts a worker remembers besides.
PIECES = 1 << 18


class Merger:
    """Number of tokens of a word by a tokenizer file of the tokenizers library (model BPE)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, vocab = spec["model"], spec["model"]["vocab"]
        if model["type"] != "BPE" or model.get("unk_token") or model.get("byte_fallback") or model.get("ignore_merges") or model.get("continuing_subword_prefix") or model.get("dropout"):
            raise ValueError("only plain BPE models can be counted here")
        library = Tokenizer.from_file(path)
        self.normal, self.cut, self.suffix = library.normalizer, library.pre_tokenizer, model.get("end_of_word_suffix") or ""
        if self.cut is None or self.pieces(" \t\n\v\f\r") != []:
            raise ValueError("the tokenizer keeps white space, so words can't be counted one by one")
        added = spec["added_tokens"]
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] or regex.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens with options are not counted here")
        self.special = regex.compile("|".join(regex.escape(t["content"]) for t in added)) if added else None
        self.symbols = vocab
        self.known = functools.lru_cache(PIECES)(self.merged)
        self.merges: dict[int, tuple[int, int]] = {}  # a pair of symbols (left << 32 | right): rank, merged symbol
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges.setdefault(vocab[left] << 32 | vocab[right], (rank, vocab[left + right]))

    def pieces(self, text: str) -> list[str]:
        text = self.normal.normalize_str(text) if self.normal else text
        return [piece for piece, _ in self.cut.pre_tokenize_str(text)]

    def count(self, word: str) -> int:
        """Tokens of a word; an added token inside it, as the library's default has it, is one."""
        if self.special is None or not (found := len(self.special.findall(word))):
            return sum(map(self.known, self.pieces(word)))
        return found + sum(self.known(p) for part in self.special.split(word) if part for p in self.pieces(part))

    def merged(self, piece: str) -> int:
        """Initial symbols of a piece less its merges. Symbols that the vocabulary lacks are dropped, as the library does."""
        if not piece:
            return 0
        symbol = [self.symbols.get(c, -1) for c in (*piece[:-1], piece[-1] + self.suffix)]
        symbol = [s for s in symbol if s >= 0]
        n = count = len(symbol)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        merges = self.merges
        heap = [found[0] << 40 | i for i in range(n - 1) if (found := merges.get(symbol[i] << 32 | symbol[i + 1]))]
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i = top & 0xFFFFFFFFFF
            j = after[i]
            if symbol[i] < 0 or j >= n:
                continue
            found = merges.get(symbol[i] << 32 | symbol[j])
            if found is None or found[0] != top >> 40:
                continue  # one of the two has been merged since
            symbol[i], symbol[j] = found[1], -1
            after[i] = k = after[j]
            count -= 1
            if k < n:
                before[k] = i
                if right := merges.get(symbol[i] << 32 | symbol[k]):
                    heapq.heappush(heap, right[0] << 40 | i)
            h = before[i]
            if h >= 0 and (left := merges.get(symbol[h] << 32 | symbol[i])):
                heapq.heappush(heap, left[0] << 40 | h)
        return count


class Counter:
    """Counts of many words at once: known ones from the table, new ones by the merger."""

    def __init__(self, path: str, bits: int = TABLE_BITS):
        self.merger, self.table = Merger(path), PieceTable(bits)

    def _merge(self, raw: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> list[int]:
        return [self.merger.count(raw[a:b].tobytes().decode()) for a, b in zip(lo.tolist(), hi.tolist(), strict=True)]

    def count(self, texts: pa.Array) -> np.ndarray:
        """Tokens of each text."""
        raw, at = utf8(texts)
        lo, hi, first = words(raw, at)
        out = np.full(len(lo), -1, np.int64)
        short = np.flatnonzero(hi - lo <= PIECE_BYTES)
        keys = span_hashes(raw, lo[short], hi[short])
        table = self.table
        found = table.find(keys)
        missing = np.flatnonzero(found < 0)
        if len(missing):
            new, where = np.unique(keys[missing], return_index=True)
            if table.used + len(new) > table.room:
                table.clear()
                missing = np.arange(len(keys))
                new, where = np.unique(keys, return_index=True)
            while len(new) > table.room:  # one text with more words than the table holds
                self.table = table = PieceTable(table.bits + 1)
            at_new = short[missing[where]]
            pieces = [raw[a:b].tobytes() for a, b in zip(lo[at_new].tolist(), hi[at_new].tolist(), strict=True)]
            table.add(new, pieces, [np.array([n], np.uint32) for n in self._merge(raw, lo[at_new], hi[at_new])])
            found[missing] = table.find(keys[missing])
        same = table.same(found, lanes(raw), lo[short], (hi - lo)[short])
        out[short[same]] = table.ids.flat[table.ids.start[found[same]]]
        rest = np.flatnonzero(out < 0)  # long words, and those that share a hash with another
        out[rest] = self._merge(raw, lo[rest], hi[rest])
        return np.diff(np.concatenate([[0], np.cumsum(out)])[np.append(first, len(lo))[: len(at)]])


_counters: dict[tuple[str, int], Counter] = {}


def counter(path: str, bits: int = TABLE_BITS) -> Counter:
    """The counter of a tokenizer file, one per Python worker."""
    if (path, bits) not in _counters:
        _counters[path, bits] = Counter(path, bits)
    return _counters[path, bits]


def count_tokens(docs: DataFrame, tokenizer: str, limit: int = 2048, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit`) of every whole text, in one scan without a shuffle.

    tokenizer is a BPE file of the tokenizers library whose pattern drops white space; others are refused
    with a ValueError. No begin, end or other special token is counted unless its string stands in the text.

    A null or empty text has no bytes and no tokens; a very long one is a step of its own, and a single word
    of n symbols takes n log n steps; repeated rows and ids give a row each; null ids stay null; an empty
    table gives none; other columns are never read, whatever their names. There are no ties: of equal ranks
    the leftmost pair is merged.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counter(tokenizer)
        for batch in batches:
            for part, texts in chunks(batch):
                n = counts.count(texts)
                size = pc.binary_length(texts).cast(pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), size, pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return rows.mapInArrow(tidied(run), f"doc_id {kind}, n_bytes long, n_tokens long, over_limit boolean")

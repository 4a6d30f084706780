"""Operator 1: byte-level BPE encoding and decoding on length-bucketed numpy matrices."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import chunks, tidied
from .pretokens import Encoder

#: Pieces up to this many bytes are merged in matrices; a longer one by a heap, as its matrix would cost its square.
MATRIX_BYTES = 256
NONE = np.int32(2**31 - 1)


class PairTable:
    """Open-addressing table from a pair of ids to the id (and so the rank) of their merge."""

    def __init__(self, ranks: dict[bytes, int]):
        found = []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                left, right = ranks.get(token[:i]), ranks.get(token[i:])
                if left is not None and right is not None:
                    found.append((left << 32 | right, rank))
        self.bits = max(4, (4 * len(found)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.ids = np.full(1 << self.bits, NONE, np.int32)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        slot, left, self.probes = self._slot(pairs[:, 0]), np.arange(len(pairs)), 0
        while len(left):
            self.probes += 1
            free = left[self.keys[slot[left]] == -1]
            self.keys[slot[free]] = pairs[free, 0]  # of several for one slot the last one wins
            self.ids[slot[left]] = np.where(self.keys[slot[left]] == pairs[left, 0], pairs[left, 1], self.ids[slot[left]])
            left = left[self.keys[slot[left]] != pairs[left, 0]]
            slot[left] = (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merged(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ids of the merges, NONE where a pair has none or an id is negative."""
        keys = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(keys)
        out = np.where(self.keys[slot] == keys, self.ids[slot], NONE)
        rest = np.flatnonzero((self.keys[slot] != keys) & (self.keys[slot] != -1))
        for _ in range(self.probes - 1):
            if not len(rest):
                break
            slot[rest] = (slot[rest] + 1) & ((1 << self.bits) - 1)
            hit = self.keys[slot[rest]] == keys[rest]
            out[rest[hit]] = self.ids[slot[rest[hit]]]
            rest = rest[~hit & (self.keys[slot[rest]] != -1)]
        return out


class BytePairs:
    """Encoder and decoder of one rank table. Ids are ranks, as in the tiktoken library."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks, self.table = ranks, PairTable(ranks)
        self.of_byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        size = max(ranks.values()) + 1
        tokens = [b""] * size
        for token, rank in ranks.items():
            tokens[rank] = token
        self.tokens = Spans(tokens)
        self.decimals = Spans([b"%d," % i for i in range(size)])

    def encode_many(self, pieces: list[str]) -> list[np.ndarray]:
        """Ids of each piece. A piece that is a token itself is that token."""
        raw = [p.encode() for p in pieces]
        out: list[np.ndarray | None] = [None] * len(raw)
        buckets: dict[int, list[int]] = {}
        for i, b in enumerate(raw):
            if (rank := self.ranks.get(b)) is not None:
                out[i] = np.array([rank], np.uint32)
            elif len(b) > MATRIX_BYTES:
                out[i] = np.array(self._by_heap(b), np.uint32)
            else:
                buckets.setdefault((max(4, len(b)) - 1).bit_length(), []).append(i)
        for bits, rows in buckets.items():
            for k in range(0, len(rows), step := max(1, (1 << 20) >> bits)):
                part = rows[k : k + step]
                for i, ids in zip(part, self._by_matrix([raw[i] for i in part], 1 << bits), strict=True):
                    out[i] = ids
        return out  # type: ignore[return-value]

    def _by_matrix(self, rows: list[bytes], width: int) -> list[np.ndarray]:
        n = len(rows)
        size = np.fromiter(map(len, rows), np.int64, n)
        padded = np.frombuffer(b"".join(b.ljust(width, b"\0") for b in rows), np.uint8).reshape(n, width)
        columns = np.arange(width)
        ids = np.where(columns < size[:, None], self.of_byte[padded], np.int32(-1))
        pairs = self._ranks(ids)
        out: list[np.ndarray | None] = [None] * n
        row = np.arange(n)
        while True:
            at = pairs.argmin(1)  # the leftmost of the smallest
            best = pairs[np.arange(len(row)), at]
            done = best == NONE
            if done.any():  # compaction: finished rows leave the matrix
                for i, ids_, m in zip(row[done].tolist(), ids[done].astype(np.uint32), size[done].tolist(), strict=True):
                    out[i] = ids_[:m]
                go = ~done
                row, ids, pairs, size, at, best = row[go], ids[go], pairs[go], size[go], at[go], best[go]
                if not len(row):
                    return out  # type: ignore[return-value]
                width = int(size.max())
                ids, pairs = ids[:, :width], pairs[:, : width - 1]
            each = np.arange(len(row))
            moved = np.concatenate([ids[:, 1:], np.full((len(row), 1), -1, np.int32)], 1)
            ids = np.where(columns[:width] > at[:, None], moved, ids)
            ids[each, at] = best
            moved = np.concatenate([pairs[:, 1:], np.full((len(row), 1), NONE, np.int32)], 1)
            pairs = np.where(columns[: width - 1] > at[:, None], moved, pairs)
            size = size - 1
            right = np.where(at + 1 < size, ids[each, np.minimum(at + 1, width - 1)], -1)
            pairs[each, np.minimum(at, width - 2)] = self._joined(best, right)
            has = np.flatnonzero(at > 0)
            pairs[has, at[has] - 1] = self._joined(ids[has, at[has] - 1], best[has])

    def _joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return np.where((left < 0) | (right < 0), NONE, self.table.merged(left, right))

    def _ranks(self, ids: np.ndarray) -> np.ndarray:
        return self._joined(ids[:, :-1].ravel(), ids[:, 1:].ravel()).reshape(len(ids), -1)

    def _by_heap(self, raw: bytes) -> list[int]:
        ids = self.of_byte[np.frombuffer(raw, np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        first = self.table.merged(np.array(ids[:-1]), np.array(ids[1:])).tolist()
        heap = [(r, i, ids[i], ids[i + 1]) for i, r in enumerate(first) if r != NONE]
        heapq.heapify(heap)

        def push(i: int, j: int) -> None:
            r = int(self.table.merged(np.array([ids[i]]), np.array([ids[j]]))[0])
            if r != NONE:
                heapq.heappush(heap, (r, i, ids[i], ids[j]))

        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = r, -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
                push(i, after[i])
            if before[i] >= 0:
                push(before[i], i)
        return [x for x in ids if x >= 0]


class Spans:
    """Byte strings by number, gathered for many numbers at once."""

    def __init__(self, items: list[bytes]):
        self.flat = np.frombuffer(b"".join(items), np.uint8)
        self.size = np.fromiter(map(len, items), np.int64, len(items))
        self.start = np.cumsum(self.size) - self.size

    def gather(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of all ids in a row, and where each id's bytes end."""
        size = self.size[ids]
        ends = np.cumsum(size)
        where = np.arange(ends[-1] if len(ends) else 0) + np.repeat(self.start[ids] - (ends - size), size)
        return self.flat[where], ends


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


_made: dict[str, tuple[BytePairs, Encoder]] = {}


def byte_pairs(path: str) -> tuple[BytePairs, Encoder]:
    """The coder of a rank file, one per Python worker."""
    if path not in _made:
        pairs = BytePairs(read_ranks(path))
        _made[path] = (pairs, Encoder(pairs.encode_many))
    return _made[path]


def encode_documents(docs: DataFrame, ranks_path: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Encode whole texts and decode the ids again: id_col, n_tokens, ids_sha256, decoded_sha256, and ids if wanted.

    ids_sha256 is of the decimal ids joined by commas, decoded_sha256 of the decoded bytes. No shuffle:
    every partition is encoded where it is read. ranks_path: a rank file that all executors can open.

    A null or empty text has no ids; a null id is kept; repeated rows give repeated results; an empty
    table gives no rows; other columns are never read, whatever their names. A very long text is encoded whole,
    in a step of its own, and a piece above MATRIX_BYTES by a heap. Of pairs of one rank the leftmost is merged.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, encoder = byte_pairs(ranks_path)
        for batch in batches:
            for part, texts in chunks(batch, "text"):
                ids, edges = encoder.encode(texts)
                ids, last, n = ids.astype(np.int64), edges[1:], np.diff(edges)
                digests = []
                for table, less in ((pairs.decimals, 1), (pairs.tokens, 0)):
                    flat, ends = table.gather(ids)
                    ends = np.concatenate([[0], ends])
                    lo, hi = ends[last - n], ends[last]
                    digests.append([hashlib.sha256(flat[a : max(a, b - less)]).hexdigest() for a, b in zip(lo.tolist(), hi.tolist(), strict=True)])
                columns = [part.column("id"), pa.array(n), *map(pa.array, digests)]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), pa.array(ids.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(columns, names)

    names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256", *["ids"] * with_ids]
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    return source.mapInArrow(tidied(run), f"`{id_col}` {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids)

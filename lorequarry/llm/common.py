"""Helpers that the operators share: joins by key, Arrow text buffers, hashes of spans."""

from __future__ import annotations

import ctypes
import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..staging import attach_groups, drop_staged, fits, scratch, small, staged, staged_tables

Batches = Iterator[pa.RecordBatch]
#: Text bytes that one numpy step works on; a longer document is a step of its own.
CHUNK_BYTES = 500_000
#: Bytes of an Arrow batch between Spark and Python, as a batch is held whole and rows have texts.
BATCH_BYTES = 4 << 20


def bound_batches(spark: SparkSession) -> None:
    """Bound Arrow batches by bytes in this session, unless they are bounded lower. A single larger row is a batch."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).removesuffix("b")
    if not now.isdigit() or not 0 < int(now) <= BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def tidied(run: Callable[[Batches], Batches]) -> Callable[[Batches], Batches]:
    """run for mapInArrow, after which the Python worker, which later tasks use again, gives memory that it doesn't need back to the system."""

    def whole(batches: Batches) -> Batches:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        getattr(ctypes.CDLL(None), "malloc_trim", int)(0)

    return whole


# ---------------------------------------------------------------- joins
def keep_by_key(rows: DataFrame, keys: DataFrame, on: list[str], how: str = "left_semi") -> DataFrame:
    """Semi or anti join with a set of keys: broadcast if they fit, by a shuffle when they are many."""
    return rows.join(F.broadcast(keys) if fits(keys) else keys, on, how)


def drop_by_key(rows: DataFrame, ids: DataFrame, id_col: str, how: str = "left_anti") -> DataFrame:
    """The rows whose id is not among ids (a null id equals a null id): broadcast if they fit, else by a shuffle.

    how: left_anti, or left_semi for the rows whose id is.
    """
    ids = ids.select(F.col(id_col).alias("_id"))
    return rows.join(F.broadcast(ids) if fits(ids) else ids, rows[id_col].eqNullSafe(ids["_id"]), how)


# ---------------------------------------------------------------- Arrow text
def strings(column: pa.Array) -> pa.Array:
    """The column as large_string without nulls (null: empty)."""
    return pc.fill_null(column.cast(pa.large_string()), "")


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a column that strings() has made."""
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64, len(column) + 1, column.offset * 8)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return raw[at[0] : at[-1]], at - at[0]


def chunks(batch: pa.RecordBatch, text: str = "text", limit: int = CHUNK_BYTES) -> Iterator[tuple[pa.RecordBatch, pa.Array]]:
    """Slices of the batch with at most `limit` text bytes each, or one document, and their texts."""
    size = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    at = np.concatenate([[0], np.cumsum(size)])
    lo = 0
    while lo < len(size):
        hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
        part = batch.slice(lo, hi - lo)
        yield part, strings(part.column(text))
        lo = hi


SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: Spans up to this many bytes are hashed eight bytes at a time, longer ones by BLAKE2b.
LANE_BYTES = 64
_KEEP = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finaliser on uint64."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def lanes(data: np.ndarray) -> np.ndarray:
    """For each place of the bytes, and the one behind them, the eight bytes from there on as a number (zeros behind the end)."""
    return lanes_within(np.concatenate([data, np.zeros(8, np.uint8)]))


def lanes_within(data: np.ndarray) -> np.ndarray:
    """The same without a copy, for all places but the last seven."""
    return np.ndarray(len(data) - 7, "<u8", data, strides=(1,))


def lane(view: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
    """The next eight bytes of spans that start at `at` and have `left` bytes, zeros behind their end."""
    return view[at] & _KEEP[np.minimum(left, 8)]


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the bytes of each span, equal for equal bytes wherever they stand.

    Spans of one length up to eight bytes never collide; others do like random numbers.
    """
    size = ends - starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93))
    view, rest, done = lanes(data), np.flatnonzero(size <= LANE_BYTES), 0
    while len(rest):
        left = size[rest] - done
        out[rest] = mix(out[rest] ^ lane(view, starts[rest] + done, left))
        rest, done = rest[left > 8], done + 8
    for i in np.flatnonzero(size > LANE_BYTES).tolist():
        out[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]].tobytes(), digest_size=8).digest(), "little")
    return out


def words(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words [^\\x20\\x09-\\x0D]+ of all documents, and the first word of each document."""
    inside = ~SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    starts = np.flatnonzero(inside & np.concatenate([[True], ~inside[:-1]] if len(data) else [[]]).astype(bool) | inside & edge[:-1])
    ends = np.flatnonzero(inside & (np.concatenate([~inside[1:], [True]] if len(data) else [[]]).astype(bool) | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, at)

"""Operator 10: packing documents into sequences by linear grouping and best fit.

The packing depends on the number of pieces of each length only. That histogram has at most `capacity`
rows whatever the input, so the driver plans with it; documents are then dealt to the planned places.
"""

from __future__ import annotations

import warnings
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import chunks, staged, tidied
from .pretokens import library_encoder

#: The linear program ends when it is within this part of its optimum.
SLACK = 0.003
#: Groups of nearly equal cardinality that large lengths are rounded up in.
GROUPS = 1000
#: Lengths above this part of the capacity are large, so a configuration has under SMALL_PART sizes.
SMALL_PART = 3

Run = tuple[int, tuple[tuple[int, int], ...]]  # sequences alike, and their (length, how many)


def linear_groups(histogram: np.ndarray, least: int, groups: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Large lengths, longest first, in groups of nearly equal cardinality: (rounded size, [(length, count)])."""
    cells = [(length, int(histogram[length])) for length in range(len(histogram) - 1, least - 1, -1) if histogram[length]]
    share = -(-sum(n for _, n in cells) // groups) if cells else 1
    out: list[tuple[int, list[tuple[int, int]]]] = []
    held = share
    for length, n in cells:
        if held >= share:
            out.append((length, []))
            held = 0
        out[-1][1].append((length, n))
        held += n
    return out


def configurations(sizes: np.ndarray, counts: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray]:
    """The linear program over configurations of few sizes, by column generation: patterns (columns), how often each.

    The columns come from a knapsack over at most capacity // smallest sizes; the basis is kept as its inverse.
    Should it not come within SLACK of its optimum in forty rounds for each size, it says so; what it has is a
    valid packing all the same, and best fit takes the rest.
    """
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    inverse, use = np.diag(1 / np.diag(basis)), counts / np.diag(basis)
    for _ in range(40 * k):
        prices = inverse.sum(0)
        pattern, worth = _knapsack(sizes, prices, capacity)
        if worth <= 1 + SLACK:
            break
        step = inverse @ pattern
        ratio = np.where(step > 1e-9, use / np.where(step > 1e-9, step, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        use -= ratio[out] * step
        use[out] = ratio[out]
        basis[:, out] = pattern
        inverse[out] /= step[out]
        others = step.copy()
        others[out] = 0
        inverse -= np.outer(others, inverse[out])
    else:
        warnings.warn(f"the configurations are not within {SLACK} of their optimum after {40 * k} rounds", stacklevel=2)
    return basis.astype(np.int64), np.maximum(use, 0)


def _knapsack(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[np.ndarray, float]:
    """The dearest pattern that fits, by dynamic programming over the free capacity, an item more in each round."""
    value, picks = np.zeros(capacity + 1), []
    offers = [(j, int(s), p) for j, (s, p) in enumerate(zip(sizes, prices, strict=True)) if p > 0]
    while True:
        best, pick = value.copy(), np.full(capacity + 1, -1)
        for j, s, p in offers:
            with_one = value[: capacity + 1 - s] + p
            better = with_one > best[s:] + 1e-12
            np.copyto(best[s:], with_one, where=better)
            pick[s:][better] = j
        if (pick < 0).all():
            break
        picks.append(pick)
        value = best
    pattern, free = np.zeros(len(sizes)), capacity
    for pick in reversed(picks):
        if (j := pick[free]) >= 0:
            pattern[j] += 1
            free -= sizes[j]
    return pattern, float(pattern @ prices)


def plan(histogram: np.ndarray, capacity: int, groups: int = GROUPS) -> list[Run]:
    """Sequences for histogram[length] pieces of each length up to capacity, as runs of sequences alike."""
    left = histogram.astype(np.int64).copy()
    free: dict[int, list[list]] = defaultdict(list)  # runs by the capacity that is left in each of their sequences

    def add(n: int, slots: tuple[tuple[int, int], ...]) -> None:
        free[capacity - sum(a * b for a, b in slots)].append([n, slots])

    grouped = linear_groups(left, capacity // SMALL_PART + 1, groups)
    if grouped:
        sizes = np.array([s for s, _ in grouped])
        patterns, use = configurations(sizes, np.array([sum(n for _, n in cells) for _, cells in grouped], float), capacity)
        streams = [[list(c) for c in cells] for _, cells in grouped]
        for column, times in zip(patterns.T, np.floor(use + 1e-7).astype(np.int64).tolist(), strict=True):
            for n, slots in _substitute(column, times, streams, left):  # actual lengths for the rounded ones
                add(n, slots)
    for length in range(capacity, 0, -1):  # what the configurations leave over, and the small ones: best fit
        n = int(left[length])
        while n:
            room = next((r for r in range(length, capacity) if free.get(r)), None)
            each = (capacity if room is None else room) // length
            have, slots = (-(-n // each), ()) if room is None else free[room].pop()
            full = min(have, n // each)
            if full:
                add(full, (*slots, (length, each)))
                n -= full * each
                have -= full
            elif have:
                add(1, (*slots, (length, n)))
                n, have = 0, have - 1
            if have and room is not None:
                free[room].append([have, slots])
    return [(n, slots) for room in sorted(free) for n, slots in free[room]]


def _substitute(column: np.ndarray, times: int, streams: list[list[list[int]]], left: np.ndarray) -> Iterator[Run]:
    """`times` sequences of a pattern, with the next actual lengths of each group, as runs."""
    slots = [j for j in np.flatnonzero(column) for _ in range(int(column[j]))]
    while times:
        cells = [next((c for c in streams[j] if c[1]), None) for j in slots]
        need: dict[int, int] = defaultdict(int)
        for c in cells:
            if c is not None:
                need[c[0]] += 1
        n = min([times, *(next(c[1] for c in cells if c is not None and c[0] == length) // k for length, k in need.items())]) if need else times
        if n:
            take = need
        else:  # a cell has fewer than the sequence takes of it: this sequence mixes the cell with the next
            n, take = 1, defaultdict(int)
            for j in slots:
                if (c := next((c for c in streams[j] if c[1] - take[c[0]] > 0), None)) is not None:
                    take[c[0]] += 1
        for stream in (streams[j] for j in set(slots)):
            for c in stream:
                c[1] -= n * take.get(c[0], 0)
        for length, k in take.items():
            left[length] -= n * k
        times -= n
        if take:
            yield n, tuple(sorted(take.items(), reverse=True))


class Places:
    """Where the r-th piece of a length goes."""

    def __init__(self, runs: list[Run]):
        rows, given, base = [], defaultdict(int), 0
        for n, slots in runs:
            offset = 0
            for length, k in slots:
                rows.append((length << 44 | given[length], base, offset, k, length, given[length]))
                given[length] += n * k
                offset += length * k
            base += n
        self.sequences = base
        self.key, self.base, self.offset, self.each, self.length, self.first = np.array(sorted(rows), np.int64).reshape(-1, 6).T

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        i = np.searchsorted(self.key, length << 44 | rank, "right") - 1
        k = rank - self.first[i]
        return self.base[i] + k // self.each[i], self.offset[i] + k % self.each[i] * self.length[i]


def cut(docs: DataFrame, tokenizer: str, end_id: int, capacity: int, id_col: str, text_col: str) -> DataFrame:
    """Staged pieces: doc_id, piece, start, length, ids_crc32, with _rank among those of its length in partition _part."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = library_encoder(tokenizer)
        seen, part_id = np.zeros(capacity + 1, np.int64), TaskContext.get().partitionId()
        for batch in batches:
            for part, texts in chunks(batch):
                rows: list[tuple[int, int, int, int, int]] = []
                flat, edges = encoder.encode(texts)
                flat = np.insert(flat, edges[1:], end_id).astype("<u4")
                for i, lo in enumerate((edges[:-1] + np.arange(len(edges) - 1)).tolist()):
                    n = int(edges[i + 1] - edges[i]) + 1
                    edge = [0, *range((n - 1) % capacity + 1, n + 1, capacity)]
                    rows += [(i, k, a, b - a, zlib.crc32(flat[lo + a : lo + b])) for k, (a, b) in enumerate(zip(edge, edge[1:], strict=False))]
                which, piece, start, length, crc = np.array(rows, np.int64).reshape(-1, 5).T
                order = np.argsort(length, kind="stable")
                by = length[order]
                rank = np.empty(len(by), np.int64)
                rank[order] = np.arange(len(by)) - np.searchsorted(by, by) + seen[by]
                seen += np.bincount(length, minlength=capacity + 1)
                yield pa.RecordBatch.from_arrays(
                    [part.column("id").take(pa.array(which)), *map(pa.array, (piece.astype(np.int32), start, length, crc, np.full(len(by), part_id, np.int32), rank))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "_part", "_rank"],
                )

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return staged(source.mapInArrow(tidied(run), f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, _part int, _rank long"), "pieces")


def pack_documents(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = 2048, id_col: str = "doc_id", text_col: str = "text", groups: int = GROUPS) -> DataFrame:
    """Pack all documents: doc_id, piece, start, length, ids_crc32, sequence_id, offset, a row for each piece.

    Texts are encoded once; a document of more than `capacity` ids is cut, its first piece being the
    shorter one. Ranks among the pieces of one length are ranks in their partition plus the numbers in the
    partitions before it, so that no length, however common, meets in one task.

    A null or empty text has end_id only; a null id is kept; repeated rows are packed each; a very long text is
    encoded whole, then cut; pieces of one length are interchangeable, so which of them goes where may differ; an
    empty table gives no rows; other columns are never read, whatever their names.
    """
    pieces = cut(docs, tokenizer, end_id, capacity, id_col, text_col)
    counts = staged(pieces.groupBy("_part", "length").agg(F.count("*").alias("n")), "piece_counts")
    histogram = np.zeros(capacity + 1, np.int64)
    for length, n in counts.groupBy("length").agg(F.sum("n")).collect():  # at most `capacity` rows
        histogram[length] = n
    places = Places(plan(histogram, capacity, groups))
    w = Window.partitionBy("length").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    before = counts.select("_part", "length", F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            length, rank, more = (batch.column(c).to_numpy() for c in ("length", "_rank", "_before"))
            sequence, offset = places.find(length, rank + more)
            keep = ["doc_id", "piece", "start", "length", "ids_crc32"]
            yield pa.RecordBatch.from_arrays([*map(batch.column, keep), pa.array(sequence), pa.array(offset)], [*keep, "sequence_id", "offset"])

    kind = pieces.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long"
    return pieces.join(before.hint("merge"), ["_part", "length"]).mapInArrow(tidied(run), schema)

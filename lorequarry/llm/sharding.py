"""Operator 3: consistent-hash ring with virtual nodes and bounded loads.

Keys stand on a ring by their hash. Each virtual node owns the arc that ends at it. A shard takes keys up
to its bound; the keys beyond it continue clockwise to the next arcs whose shards have room. How many keys
an arc passes on depends on the numbers of keys of the arcs only, a few thousand numbers, so the driver
settles that; which keys they are follows from each key's rank in its arc.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mix, staged, tidied

#: Virtual nodes of each shard.
VIRTUAL_NODES = 128


class Ring:
    """Positions of the virtual nodes of shards 0 to n - 1. A shard's nodes are the same for every n."""

    def __init__(self, shards: int, virtual_nodes: int = VIRTUAL_NODES):
        shard = np.repeat(np.arange(shards), virtual_nodes)
        node = np.tile(np.arange(virtual_nodes), shards)
        at = mix(mix(shard.astype(np.uint64) + np.uint64(1)) ^ node.astype(np.uint64)).astype(np.int64)  # signed, as xxhash64
        order = np.argsort(at, kind="stable")
        self.at, self.owner, self.shards = at[order], shard[order], shards

    def arc(self, position: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.at, position) % len(self.at)

    def settle(self, counts: np.ndarray, bounds: np.ndarray) -> list[tuple[int, int, int, int]]:
        """(arc, first rank, number, shard): who takes which keys of each arc, all of them.

        First every shard takes the first keys of its own arcs, in ring order, up to its bound. Then the
        others of each arc, in ring order, go clockwise to the shards that have room.
        """
        room = bounds.astype(np.int64).copy()
        taken, rest = [], []
        for a, s in enumerate(self.owner.tolist()):
            n = min(int(counts[a]), int(room[s]))
            room[s] -= n
            if n:
                taken.append((a, 0, n, s))
            if n < counts[a]:
                rest.append((a, n))
        for a, first in rest:
            b = a
            while first < counts[a]:
                b = (b + 1) % len(self.owner)
                s = int(self.owner[b])
                if n := min(int(counts[a]) - first, int(room[s])):
                    room[s] -= n
                    taken.append((a, first, n, s))
                    first += n
        return taken


def bounds_of(total: int, shards: int, headroom: float) -> np.ndarray:
    """Bounded loads: the mean plus headroom; with none, shares that differ by one at most."""
    if headroom > 0:
        return np.full(shards, -int(-total * (1 + headroom) // shards))
    return np.array([total // shards + (s < total % shards) for s in range(shards)])


def assign_shards(docs: DataFrame, shards: int = 8, virtual_nodes: int = VIRTUAL_NODES, headroom: float = 0.0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A shard for every row: id_col, size, text_crc32, law, shard, slot, grown_shard.

    size: UTF-8 bytes of the text plus 1. law: `rows`, as with headroom 0 the counts of the shards differ by
    one at most. slot: gapless from 0 in each shard. grown_shard: null, as loads and not only keys decide.
    With headroom h a shard holds at most (1 + h) times the mean, and fewer keys move when a shard is added.

    Only (key, size, crc) moves, once, by ring position; ties are spread, so a repeated key is no hot task.
    The driver holds a number for each arc and partition. A null text has size 1 and crc 0; a null key
    stands at the hash of null; repeated rows get a place each; a very long text is only measured, where it is
    read; an empty table gives no rows; other columns are never read, whatever their names. What reaches the
    driver besides is Spark's own sample of keys for the ranges, a hundred for each partition.
    """
    ring = Ring(shards, virtual_nodes)
    text = F.coalesce(docs[text_col], F.lit(""))
    keys = docs.select(docs[id_col].alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text).alias("text_crc32"))
    keys = staged(keys.withColumn("_at", F.xxhash64("doc_id")).withColumn("_tie", F.monotonically_increasing_id()), "ring_keys")
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = ["_at", "doc_id", "text_crc32", "_tie"]

    def rank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, part_id = np.zeros(len(ring.owner), np.int64), TaskContext.get().partitionId()
        for batch in batches:
            arc = ring.arc(batch.column("_at").to_numpy())
            by_arc = np.argsort(arc, kind="stable")
            by = arc[by_arc]
            ranks = np.empty(len(arc), np.int64)
            ranks[by_arc] = np.arange(len(by)) - np.searchsorted(by, by) + seen[by]
            seen += np.bincount(arc, minlength=len(seen))
            yield pa.RecordBatch.from_arrays([*map(batch.column, own), pa.array(np.full(len(by), part_id, np.int32)), pa.array(arc.astype(np.int32)), pa.array(ranks)], [*own, "_part", "_arc", "_rank"])

    own = ["doc_id", "size", "text_crc32"]
    kind = keys.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, size long, text_crc32 long"
    placed = staged(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidied(rank), schema + ", _part int, _arc int, _rank long"), "ring_order")
    # Each partition has a stretch of the ring: about as many rows as partitions and arcs together.
    found = placed.groupBy("_part", "_arc").agg(F.count("*").alias("n")).orderBy("_part").collect()
    counts, before = np.zeros(len(ring.owner), np.int64), {}
    for part, arc, n in found:
        before[part, arc] = int(counts[arc])
        counts[arc] += n
    filled = [0] * shards
    table = []
    for arc, first, n, shard in ring.settle(counts, bounds_of(int(counts.sum()), shards, headroom)):
        table.append((arc << 44 | first, first, shard, filled[shard]))
        filled[shard] += n
    key, first, shard_of, base = np.array(sorted(table), np.int64).reshape(-1, 4).T

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part, arc, ranks = (batch.column(c).to_numpy() for c in ("_part", "_arc", "_rank"))
            pairs, which = np.unique(part.astype(np.int64) << 32 | arc, return_inverse=True)
            ranks = ranks + np.array([before[x >> 32, x & 0xFFFFFFFF] for x in pairs.tolist()], np.int64)[which]
            i = np.searchsorted(key, arc.astype(np.int64) << 44 | ranks, "right") - 1
            n = len(ranks)
            yield pa.RecordBatch.from_arrays(
                [*map(batch.column, own), pa.array([law] * n, pa.string()), pa.array(shard_of[i].astype(np.int32)), pa.array(base[i] + ranks - first[i]), pa.nulls(n, pa.int32())],
                [*own, "law", "shard", "slot", "grown_shard"],
            )

    law = "rows"
    return placed.mapInArrow(tidied(deal), schema + ", law string, shard int, slot long, grown_shard int").withColumnRenamed("doc_id", id_col)

"""Operator 13: the trie of all conversation prefixes, from a Cartesian tree over sorted conversations.

Conversations stand sorted by their turns; L[i] is the number of turns that the i-th shares with the one
before. The nodes of the Cartesian tree of L, equal ones merged, are the intervals of conversations between
the nearest smaller values on both sides of a place: the nodes of the trie where paths part or end. All
nearest smaller values are found in parallel: a block of the order finds its own with a stack, what reaches
beyond the block goes by the blocks' minima to the block that has it, and there to the place in that block's
chain of minima. Nodes between two of these have one child each and the same members; they are the depths
from the parent's to the node's own.

The sums of an interval are differences of running sums. With W the words of a conversation's first turns,
the tokens saved below a node at depth d are the sum of W(L[i]) - W(d - 1) over the members but the first.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import attach_groups, small, staged, tidied

#: Conversations in a block of the order.
BLOCK_ROWS = 100_000
#: Characters of a turn's digest in the key that conversations are sorted by.
WIDTH = 32
#: What no ids hash to.
EMPTY = hashlib.sha256(b"").hexdigest()


def _counted(rows: DataFrame, order: list[str], group: str, add: str, parts: int, name: str) -> DataFrame:
    """Staged rows with `_i`, their place in the group from 0, and `_before`, the sum of `add` over the places before.

    order starts with the group. Places are counted in ranges of the total order, so a large group is many
    tasks; what a group has in the ranges before is a row for each group and range.
    """
    own = rows.columns

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, n, total = TaskContext.get().partitionId(), None, 0, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            key, x = batch.column(group).to_numpy(), batch.column(add).to_numpy()
            starts = np.flatnonzero(np.concatenate([[key[0] != last], key[1:] != key[:-1]]))
            first = np.zeros(len(key), np.int64)
            first[starts] = starts
            first = np.maximum.accumulate(first)
            sums = np.concatenate([[0], np.cumsum(x)])
            place, before = np.arange(len(key)) - first, sums[:-1] - sums[first]
            carried = slice(0, int(starts[0]) if len(starts) else len(key))
            place[carried] += n
            before[carried] += total
            last, n, total = key[-1], int(place[-1]) + 1, int(before[-1] + x[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(len(key), part, np.int32)), pa.array(place), pa.array(before)], [*own, "_part", "_i", "_before"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    placed = staged(rows.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidied(count), f"{schema}, _part int, _i long, _before long"), name)
    # Groups that go on in further ranges: at most one for each range.
    sizes = placed.groupBy(group).agg(F.min("_part").alias("lo"), F.max("_part").alias("hi")).filter("lo < hi").select(group)
    split = placed.join(F.broadcast(sizes), group).groupBy(group, "_part").agg((F.max("_i") + 1).alias("n"), F.max(F.col("_before") + F.col(add)).alias("t"))
    split = staged(split, name + "_split")
    later = split.alias("a").join(split.alias("b"), (F.col(f"a.{group}") == F.col(f"b.{group}")) & (F.col("b._part") < F.col("a._part")))
    later = later.groupBy(f"a.{group}", "a._part").agg(F.sum("b.n").alias("_n"), F.sum("b.t").alias("_t"))
    found = placed.join(F.broadcast(later), [group, "_part"], "left")
    return found.select(*own, (F.col("_i") + F.coalesce("_n", F.lit(0))).alias("_i"), (F.col("_before") + F.coalesce("_t", F.lit(0))).alias("_before"))


def rebuilt_turns(turns: DataFrame, parts: int, heads: int, family: int) -> tuple[DataFrame, DataFrame]:
    """The conversations (conv_id, len) and their rebuilt turns (conv_id, d from 1, digest, words, before).

    Conversation c begins with the first h turns of conversation c - c % family in place of its own first h,
    where h is the crc32 of its decimal id modulo heads (1: nothing is replaced).
    before: words of the turns in front. Turns stand by turn (null first); rows of one turn by role, then by the digest of their text.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.substring(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(" "), role, text), 256), 1, WIDTH)
    n_words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    rows = turns.filter("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), "turn", role.alias("role"), digest.alias("digest"), n_words.cast("long").alias("words"))
    own = _counted(staged(rows, "hashed_turns"), ["conv_id", "turn", "role", "digest"], "conv_id", "words", parts, "turns").withColumnRenamed("_i", "i").withColumnRenamed("_before", "before")
    own = staged(own.select("conv_id", "i", "digest", "words", "before"), "own_turns")

    # A row for each conversation, with its first turns, fewer than `heads`.
    first = F.array_sort(F.collect_list(F.when(F.col("i") < heads - 1, F.struct("i", "digest", "words", "before"))))
    convs = staged(own.groupBy("conv_id").agg(F.count("*").alias("n"), first.alias("first")), "conversations")
    h = (F.crc32(F.col("conv_id").cast("string")) % heads).cast("int")
    bases = convs.filter(F.pmod("conv_id", F.lit(family)) == 0).select(F.col("conv_id").alias("base"), F.col("first").alias("given"))
    convs = convs.withColumn("base", F.col("conv_id") - F.pmod("conv_id", F.lit(family))).join(small(bases), "base", "left")
    head = F.slice(F.coalesce("given", F.array().cast("array<struct<i:bigint,digest:string,words:bigint,before:bigint>>")), 1, F.col("h"))
    convs = convs.withColumn("h", h).withColumn("head", head)
    dropped = F.aggregate(F.slice("first", 1, F.col("h")), F.lit(0).cast("long"), lambda a, x: a + x["words"])
    given = F.aggregate("head", F.lit(0).cast("long"), lambda a, x: a + x["words"])
    convs = convs.select("conv_id", "n", "h", "head", F.size("head").alias("k"), (given - dropped).alias("shift"))
    convs = staged(convs.withColumn("len", F.col("k") + F.greatest(F.col("n") - F.col("h"), F.lit(0))), "rebuilt")

    given = convs.select("conv_id", F.inline("head")).select("conv_id", (F.col("i") + 1).alias("d"), "digest", "words", "before")
    total = convs.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
    rest = attach_groups(own, convs.select("conv_id", "n", "h", "k", "shift"), ["conv_id"], "n", total).filter("i >= h")
    rest = rest.select("conv_id", (F.col("i") - F.col("h") + F.col("k") + 1).alias("d"), "digest", "words", (F.col("before") + F.col("shift")).alias("before"))
    return convs.select("conv_id", "len"), staged(given.unionByName(rest), "rebuilt_turns")


def _keys(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """conv_id, len, key (digests of the first turns, end to end), words (of these turns).

    A key ends where no other conversation has the same turns: that is asked at depths 2, 4, 8 and so on, by
    the number of the turns with their places and a sum of hashes of them, which is equal for equal turns (a
    chance collision makes a key longer only).
    """
    level = F.length(F.bin(F.col("d") - 1))
    mark = F.conv(F.substring("digest", 1, 15), 16, 10).cast("long")
    sums = turns.groupBy("conv_id", level.alias("level")).agg(F.sum(F.xxhash64("d", mark).cast("decimal(38,0)")).alias("s"), F.max("d").alias("d"))
    levels = F.sort_array(F.collect_list(F.struct("level", "s", "d")))
    whole = sums.groupBy("conv_id").agg(levels.alias("v"))  # a number of levels that is the logarithm of the turns
    upto = F.transform(F.sequence(F.lit(1), F.size("v")), lambda i: F.struct(F.element_at("v", i)["d"].alias("d"), F.aggregate(F.slice("v", 1, i), F.lit(0).cast("decimal(38,0)"), lambda a, x: (a + x["s"]).cast("decimal(38,0)")).alias("s")))
    prefixes = whole.select("conv_id", F.inline(upto))
    alone = prefixes.groupBy("d", "s").agg(F.count("*").alias("same"), F.min("conv_id").alias("conv_id")).filter("same = 1")
    needed = alone.groupBy("conv_id").agg(F.min("d").alias("needed"))
    convs = convs.join(needed, "conv_id", "left").withColumn("needed", F.coalesce("needed", "len"))
    few = attach_groups(turns, staged(convs, "key_lengths"), ["conv_id"], "len", max(1, turns.count())).filter("d <= needed")
    parts = few.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("d", "digest", "words"))).alias("v"))
    keyed = convs.join(parts, "conv_id", "left")
    empty = F.array().cast("array<bigint>")
    return keyed.select("conv_id", "len", F.coalesce(F.array_join(F.col("v.digest"), ""), F.lit("")).alias("key"), F.coalesce(F.col("v.words"), empty).alias("words"))


def _shared(a: str, b: str) -> int:
    """Turns that two keys share."""
    lo, hi = 0, min(len(a), len(b)) // WIDTH
    while lo < hi:
        mid = (lo + hi + 1) // 2
        lo, hi = (mid, hi) if a[: mid * WIDTH] == b[: mid * WIDTH] else (lo, mid - 1)
    return lo


def _order(keys: DataFrame, parts: int) -> DataFrame:
    """Staged blocks of the sorted conversations: part, row, conv_id, len, L, wl (words of the L shared turns), next_L.

    The first row of a block gets its L from the last key of the block before; that is a row or two for each block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, row, last = TaskContext.get().partitionId(), 0, None
        held: list[tuple] = []
        for batch in batches:
            for conv, n, key, words in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "len", "key", "words")), strict=True):
                shared = _shared(last, key) if last is not None else None
                if held:
                    held[-1] = (*held[-1][:-2], shared, None)
                held.append((part, row, conv, n, shared, sum(words[:shared]) if shared is not None else None, key if row == 0 else None, words if row == 0 else None, None, None))
                row, last = row + 1, key
            if len(held) > 5000:
                yield to_batch(held[:-1])
                held = held[-1:]
        if held:
            held[-1] = (*held[-1][:-1], last)
            yield to_batch(held)

    names = ["part", "row", "conv_id", "len", "L", "wl", "first_key", "first_words", "next_L", "last_key"]
    kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.int64()), pa.int64(), pa.string()]

    def to_batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    schema = "part int, row long, conv_id long, len long, L long, wl long, first_key string, first_words array<long>, next_L long, last_key string"
    order = ["key", "conv_id"]
    placed = staged(keys.repartitionByRange(parts, *order).sortWithinPartitions(*order).mapInArrow(tidied(run), schema), "order")

    def join_ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            for part, key, words, end in zip(*(batch.column(c).to_pylist() for c in ("part", "first_key", "first_words", "last_key")), strict=True):
                if key is not None:
                    shared = _shared(last, key) if last is not None else -1
                    yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "own_L": pa.array([shared], pa.int64()), "own_wl": pa.array([sum(words[: max(0, shared)])], pa.int64())})
                last = end if end is not None else last

    ends = placed.filter("first_key is not null or last_key is not null").select("part", "row", "first_key", "first_words", "last_key")
    ends = ends.coalesce(1).sortWithinPartitions("part", "row").mapInArrow(join_ends, "part int, own_L long, own_wl long")
    ends = staged(ends.withColumn("after", F.lead("own_L", 1, -1).over(Window.orderBy("part"))), "block_ends")  # a row for each block
    found = placed.join(F.broadcast(ends), "part")
    return staged(found.select("part", "row", "conv_id", "len", F.coalesce("L", "own_L").alias("L"), F.coalesce("wl", "own_wl").alias("wl"), F.coalesce("next_L", "after").alias("next_L")), "blocks")


class Blocks:
    """What the driver knows of each block of the order: a few numbers."""

    def __init__(self, blocks: DataFrame):
        leaf = F.sum((F.col("next_L") < F.col("len")).cast("long"))
        rows = blocks.groupBy("part").agg(F.count("*"), F.min("L"), F.min("conv_id"), F.sum("wl"), leaf).orderBy("part").collect()
        self.part = np.array([r[0] for r in rows], np.int64)
        self.n, self.least, self.conv, self.words, self.leaves = (np.array([r[k] for r in rows], np.int64) for k in range(1, 6))
        self.total = int(self.n.sum())

    def start(self, k: int) -> tuple[int, int, int]:
        """Conversations, words and leaves before the k-th block."""
        return int(self.n[:k].sum()), int(self.words[:k].sum()), int(self.leaves[:k].sum())


def nearest_smaller(values: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each place the nearest smaller value before it (-1: none) and behind it (len: none), and the first place of its node."""
    n = len(values)
    left, right, first = np.full(n, -1, np.int64), np.full(n, n, np.int64), np.arange(n)
    stack: list[int] = []
    for i, v in enumerate(values):
        while stack and values[stack[-1]] > v:
            right[first[stack.pop()]] = i
        if stack and values[stack[-1]] == v:  # the same node
            j, stack[-1] = stack[-1], i
            left[i], first[i] = left[j], first[j]
        else:
            left[i] = stack[-1] if stack else -1
            stack.append(i)
    return left, right[first], first


def _least(values: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """Minima of values[lo:hi], of none of them empty, by a sparse table."""
    level = np.frexp((hi - lo).astype(float))[1] - 1
    out, table = np.empty(len(lo), values.dtype), values
    for k in range(int(level.max(initial=-1)) + 1):
        at = np.flatnonzero(level == k)
        out[at] = np.minimum(table[lo[at]], table[hi[at] - (1 << k)])
        table = np.minimum(table[: -(1 << k)], table[1 << k :]) if len(table) > 1 << k else table
    return out


def _running(block: pd.DataFrame, start: tuple[int, int, int]) -> tuple[int, np.ndarray, np.ndarray]:
    """The block's first place, and sums of words and leaves before each place and behind the last."""
    leaf = (block["next_L"] < block["len"]).to_numpy(np.int64)
    return start[0], start[1] + np.concatenate([[0], np.cumsum(block["wl"])]), start[2] + np.concatenate([[0], np.cumsum(leaf)])


NODE = "l long, v long, cnt long, r long, l_v long, r_v long, l_words long, r_words long, l_leaves long, r_leaves long, conv_id long"


def _nodes(blocks: DataFrame, known: Blocks) -> tuple[DataFrame, DataFrame]:
    """The nodes where paths part or end, and for each conversation the place of the nearest smaller value before it.

    Nodes: NODE; l is the first member, r the place behind the last, v the depth, cnt the places with L = v
    among the members but the first; l_v and r_v are L at l and r.
    """
    index = {int(p): k for k, p in enumerate(known.part)}

    def local(block: pd.DataFrame) -> tuple:
        block = block.sort_values("row")
        k = index[int(block["part"].iloc[0])]
        at, words, leaves = _running(block, known.start(k))
        L = block["L"].to_numpy(np.int64)
        return block, k, at, words, leaves, L, *nearest_smaller(L.tolist())

    def parts_of(block: pd.DataFrame) -> pd.DataFrame:
        block, k, at, words, leaves, L, left, right, first = local(block)
        conv, n = block["conv_id"].to_numpy(np.int64), len(L)
        rep = np.flatnonzero((first == np.arange(n)) & (L >= 0))
        lo, hi = left[rep], right[rep]
        here = _least(conv, np.maximum(lo, 0), hi)
        v = L[rep]
        l_part, r_part = np.full(len(rep), -1, np.int64), np.full(len(rep), -1, np.int64)
        for i in np.flatnonzero(lo < 0).tolist():  # by the blocks' minima; the first L of all is -1, so there is one
            b = int(np.flatnonzero(known.least[:k] < v[i])[-1])
            l_part[i] = known.part[b]
            here[i] = min(here[i], known.conv[b + 1 : k].min(initial=here[i]))
        for i in np.flatnonzero(hi == n).tolist():
            later = np.flatnonzero(known.least[k + 1 :] < v[i])
            b = k + 1 + int(later[0]) if len(later) else len(known.n)
            r_part[i] = known.part[b] if len(later) else -2
            here[i] = min(here[i], known.conv[k + 1 : b].min(initial=here[i]))
        whole = known.start(len(known.n))
        end = r_part == -2
        r = pd.DataFrame({
            "part": known.part[k], "l": at + lo, "v": v, "cnt": np.bincount(first, minlength=n)[rep], "r": np.where(end, whole[0], at + hi), "l_v": L[lo], "r_v": np.where(end, -1, L[np.minimum(hi, n - 1)]),
            "l_words": words[lo + 1], "r_words": np.where(end, whole[1], words[hi]), "l_leaves": leaves[lo], "r_leaves": np.where(end, whole[2], leaves[hi]), "conv_id": here, "l_part": l_part, "r_part": np.where(end, -1, r_part),
        })
        size, after = block["len"].to_numpy(np.int64), block["next_L"].to_numpy(np.int64)
        one = np.flatnonzero(size > np.maximum(L, after))  # a conversation that nothing else goes on to the end of
        single = pd.DataFrame({
            "part": known.part[k], "l": at + one, "v": size[one], "cnt": 0, "r": at + one + 1, "l_v": L[one], "r_v": after[one], "l_words": words[one + 1], "r_words": words[one + 1],
            "l_leaves": leaves[one], "r_leaves": leaves[one + 1], "conv_id": conv[one], "l_part": -1, "r_part": -1,
        })
        return pd.concat([r, single])

    def chains_of(block: pd.DataFrame) -> pd.DataFrame:
        block, k, at, words, leaves, L, *_ = local(block)
        conv = block["conv_id"].to_numpy(np.int64)
        ahead, behind = np.minimum.accumulate(L), np.minimum.accumulate(L[::-1])[::-1]
        falls = np.flatnonzero(np.concatenate([[True], L[1:] < ahead[:-1]]))
        rises = np.flatnonzero(np.concatenate([L[:-1] < behind[1:], [True]]))
        before, after = np.minimum.accumulate(conv), np.minimum.accumulate(conv[::-1])[::-1]
        big = np.iinfo(np.int64).max
        entering = [{"v": int(L[p]), "at": at + int(p), "words": int(words[p]), "leaves": int(leaves[p]), "conv": int(before[p - 1]) if p else big} for p in falls.tolist()]
        leaving = [{"v": int(L[p]), "at": at + int(p), "words": int(words[p + 1]), "leaves": int(leaves[p]), "conv": int(after[p])} for p in rises.tolist()]
        return pd.DataFrame({"chain_part": [known.part[k]], "falls": [entering], "rises": [leaving]})

    def places_of(block: pd.DataFrame) -> pd.DataFrame:
        block, k, at, _, _, L, left, *_ = local(block)
        return pd.DataFrame({"part": known.part[k], "i": at + np.arange(len(L)), "conv_id": block["conv_id"], "len": block["len"], "L": L, "p": np.where(left < 0, -1, at + left)})

    by_block = blocks.groupBy("part")
    link = "array<struct<v: bigint, at: bigint, words: bigint, leaves: bigint, conv: bigint>>"
    parts = staged(by_block.applyInPandas(parts_of, "part long, " + NODE + ", l_part long, r_part long"), "node_parts")
    chains = staged(by_block.applyInPandas(chains_of, f"chain_part long, falls {link}, rises {link}"), "chains")
    places = staged(by_block.applyInPandas(places_of, "part long, i long, conv_id long, len long, L long, p long"), "places")

    chains = small(chains)
    opened = parts.filter("l_part >= 0").join(chains.select(F.col("chain_part").alias("l_part"), "rises"), "l_part")
    opened = opened.withColumn("e", F.element_at(F.filter("rises", lambda x: x["v"] < F.col("v")), -1))
    opened = opened.withColumns({"l": F.col("e.at"), "l_v": F.col("e.v"), "l_words": F.col("e.words"), "l_leaves": F.col("e.leaves"), "conv_id": F.least("conv_id", "e.conv")}).select(parts.columns)
    opened = staged(opened, "open_nodes")
    parts = parts.filter("l_part < 0").unionByName(opened)
    closed = parts.filter("r_part >= 0").join(chains.select(F.col("chain_part").alias("r_part"), "falls"), "r_part")
    closed = closed.withColumn("e", F.element_at(F.filter("falls", lambda x: x["v"] < F.col("v")), 1))
    closed = closed.withColumns({"r": F.col("e.at"), "r_v": F.col("e.v"), "r_words": F.col("e.words"), "r_leaves": F.col("e.leaves"), "conv_id": F.least("conv_id", "e.conv")}).select(parts.columns)
    parts = parts.filter("r_part < 0").unionByName(closed)
    same = ["r", "l_v", "r_v", "l_words", "r_words", "l_leaves", "r_leaves"]  # equal in all blocks that a node reaches into
    nodes = parts.groupBy("l", "v").agg(F.sum("cnt").alias("cnt"), *(F.max(c).alias(c) for c in same), F.min("conv_id").alias("conv_id"))
    far = opened.select("part", F.col("v").alias("L"), F.col("l").alias("q"))
    places = places.filter("p >= 0 or L < 0").unionByName(places.filter("p < 0 and L >= 0").join(far, ["part", "L"]).withColumn("p", F.col("q")).select(places.columns))
    return nodes, staged(places.drop("part"), "left_places")


def _ends(places: DataFrame) -> DataFrame:
    """l, v, n_ends, ends_sha256: the conversations that end at a node, as a hash of their ascending ids.

    A hash is one after another by its nature: the ids of a node pass through a task in sorted order, and
    only the state of the hash is held.
    """
    ends = places.select(F.when(F.col("L") == F.col("len"), F.col("p")).otherwise(F.col("i")).alias("l"), F.col("len").alias("v"), "conv_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, digest, n = None, None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            l, v, conv = (batch.column(c).to_numpy() for c in ("l", "v", "conv_id"))
            edges = np.concatenate([[0], np.flatnonzero((l[1:] != l[:-1]) | (v[1:] != v[:-1])) + 1, [len(l)]]).tolist()
            out = []
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                ids = ",".join(map(str, conv[a:b].tolist()))
                if key == (l[a], v[a]):
                    digest.update(b"," + ids.encode())
                    n += b - a
                else:
                    if key is not None:
                        out.append((*key, n, digest.hexdigest()))
                    key, digest, n = (l[a], v[a]), hashlib.sha256(ids.encode()), b - a
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out, strict=True)], ["l", "v", "n_ends", "sha"])
        if key is not None:
            yield pa.RecordBatch.from_arrays([pa.array([c]) for c in (*key, n, digest.hexdigest())], ["l", "v", "n_ends", "sha"])

    return ends.repartition("l", "v").sortWithinPartitions("l", "v", "conv_id").mapInArrow(tidied(run), "l long, v long, n_ends long, sha string")


def _depths(nodes: DataFrame) -> DataFrame:
    """The nodes with a row for each depth from the one behind the parent's to their own."""
    own = nodes.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            upper, v = batch.column("upper").to_numpy(), batch.column("v").to_numpy()
            ends = np.cumsum(v - upper)
            for lo in range(0, int(ends[-1]) if len(ends) else 0, 10_000):
                out = np.arange(lo, min(lo + 10_000, int(ends[-1])))
                row = np.searchsorted(ends, out, "right")
                d = v[row] - (ends[row] - 1 - out)
                yield pa.RecordBatch.from_arrays([*(c.take(pa.array(row)) for c in batch.columns), pa.array(d)], [*own, "d"])

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in nodes.schema)
    return nodes.mapInArrow(tidied(run), schema + ", d long")


def prefix_trie(conversations: DataFrame, heads: int = 1, family: int = 20) -> DataFrame:
    """All distinct beginnings of the conversations (conv_id, turn, role, text), a row for each: NODES.

    conv_id: the smallest member; depth; parent_conv_id: the parent's conv_id (root: null); n_convs; n_children;
    n_leaves: nodes without children below, itself included; saved_tokens: over the node and all below it, the words of the
    last text times the members but one; ends_sha256: SHA-256 of the ascending, comma-joined ids of the
    members that end here. heads and family rebuild conversations (see rebuilt_turns).

    A conversation may hold a third of all rows: places are counted in ranges of the order, and its key ends
    where no other conversation is like it. A key has 32 characters for each turn that it shares with another.
    Copies stand side by side in the order, by id, over as many blocks as they take.

    A null role or text is empty; a null turn comes first, and equal turns by role, then by a digest of the text;
    repeated rows are turns of their own; rows without a conv_id belong to no conversation and are left out; texts
    are hashed where they are read, however long; an empty table gives no rows; other columns are never read.
    """
    spark = conversations.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    convs, turns = rebuilt_turns(conversations.select("conv_id", "turn", "role", "text"), parts, heads, family)
    n = convs.count()
    nodes_schema = "conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string"
    if not n:
        return spark.createDataFrame([], nodes_schema)
    blocks = _order(_keys(convs, turns), max(parts, -(-n // BLOCK_ROWS)))
    known = Blocks(blocks)
    nodes, places = _nodes(blocks, known)
    nodes = staged(nodes, "trie_nodes")
    if not nodes.filter("v = 0").limit(1).count():
        total = known.start(len(known.n))
        root = [(0, 0, 0, total[0], -1, -1, 0, total[1], 0, total[2], int(known.conv.min()))]
        nodes = nodes.unionByName(spark.createDataFrame(root, NODE))

    upper = F.greatest("l_v", "r_v")
    nodes = nodes.withColumn("upper", F.when(F.col("v") == 0, -1).otherwise(F.greatest(upper, F.lit(0))).cast("long"))
    starts = places.select(F.col("i").alias("l"), F.col("conv_id").alias("path"), "p")
    nodes = nodes.join(starts, "l").join(_ends(places), ["l", "v"], "left")
    parent = F.when(F.col("l_v") == F.col("upper"), F.col("p")).otherwise(F.col("l"))
    nodes = staged(nodes.withColumn("parent", parent), "placed_nodes")
    parents = nodes.select(F.col("l").alias("parent"), F.col("v").alias("upper"), F.col("conv_id").alias("above"), (F.col("cnt") + 1).alias("kids"))
    nodes = attach_groups(nodes, parents, ["parent", "upper"], "kids", nodes.count(), how="left")
    nodes = nodes.select(
        "path", "conv_id", "upper", "v", "above", (F.col("r") - F.col("l")).alias("n_convs"), (F.col("r_words") - F.col("l_words")).alias("words"),
        (F.col("r_leaves") - F.col("l_leaves")).alias("n_leaves"), (F.col("cnt") + 1 - F.coalesce("n_ends", F.lit(0))).alias("kids"), F.coalesce("sha", F.lit(EMPTY)).alias("sha"),
    )
    nodes = staged(nodes, "whole_nodes")
    alone = _depths(nodes.filter("n_convs = 1")).withColumn("before", F.lit(0).cast("long"))  # nothing is saved there
    shared = _depths(nodes.filter("n_convs > 1")).join(turns.select(F.col("conv_id").alias("path"), "d", "before"), ["path", "d"], "left")
    at_end = F.col("d") == F.col("v")
    return alone.unionByName(shared.select(alone.columns)).select(
        "conv_id", F.col("d").alias("depth"), F.when(F.col("d") == F.col("upper") + 1, F.col("above")).otherwise(F.col("conv_id")).alias("parent_conv_id"),
        "n_convs", F.when(at_end, F.col("kids")).otherwise(1).cast("long").alias("n_children"), "n_leaves",
        (F.col("words") - (F.col("n_convs") - 1) * F.coalesce("before", F.lit(0))).alias("saved_tokens"), F.when(at_end, F.col("sha")).otherwise(EMPTY).alias("ends_sha256"),
    )

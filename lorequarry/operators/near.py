"""Pairs and nearest rows by set or vector similarity.

Rows are compared in tiles: a block's rows are cut into parts of bounded bytes, a tile is two parts, and a
task multiplies the matrices of a tile. A block of any size is so many tasks, none of which holds more than
two parts; what leaves a task are pairs that reach the threshold, or the best few of each query. Sets that must be
half alike or more meet by their rarest items instead, where those are rare enough.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import attach_groups, small, staged

#: Rows of a part, and items of all its sets, at most.
PART_ROWS, PART_ITEMS = 1000, 500_000
#: A block with most rows is cut into as many parts of that size, a smaller one into fewer, then parts grow up to so many times as large, as each row goes to all parts.
PARTS, GROWTH = 8, 8
#: Rows of a part that meet another part at a time.
STEP = 1000
#: Columns of a matrix that are multiplied at a time; beyond these an item of fewer than a CELLS-th of all pairs is counted pair by pair instead, so many at a time.
COLUMNS, CELLS, AT_ONCE = 4096, 256, 4_000_000
#: Rows whose items are counted to order items by how rare they are, and the counts that are kept; results don't depend on the order.
ORDER_ROWS, ORDER_ITEMS = 20_000, 500_000
#: How many of their rare items two sets must share to be compared, and one more for so many items that they must share.
SHARED, MORE = 3, 32
#: Rows of a part that meet by rare items, and rare items of all its sets; parts are cut as those of tiles are.
RARE_ROWS, RARE_ITEMS = 10_000, 1_500_000
#: Pairs that a task looks at in a step.
PAIRS = 2_000_000
#: Items of the left side of a tile that are looked up at a time.
STEP_ITEMS = 1_000_000
#: Rows beyond which rare items are counted on a sixteenth of all items, to choose between ways that give the same result.
COUNT_ROWS = 50_000
#: Candidates a row up to which their sets are sent to be compared, and the least rows that are worth it.
CANDIDATES, LEAST_ROWS = 20, 2000


def hashed(items: Column) -> Column:
    """A set of strings as sorted 64-bit hashes; two of its strings collide once in 2**64."""
    return F.array_sort(F.array_distinct(F.transform(items, lambda x: F.xxhash64(x))))


def character_pairs(rows: DataFrame, content: str) -> DataFrame:
    """rows with items, the distinct pairs of neighbouring characters of a text in lower case without white space, as numbers. No rows move."""
    dense = rows.withColumn("_dense", F.regexp_replace(F.lower(content), r"\s+", ""))
    names = rows.columns

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = []
            for t in batch.column("_dense").to_pylist():
                points = np.frombuffer((t or "").encode("utf-32-le"), np.uint32).astype(np.int64)
                own.append(np.unique(points[:-1] << 21 | points[1:]))
            yield pa.RecordBatch.from_arrays([*map(batch.column, names), pa.array(own, pa.list_(pa.int64()))], [*names, "items"])

    return dense.mapInArrow(pairs, T.StructType([*rows.schema.fields, T.StructField("items", T.ArrayType(T.LongType()))]))


#: What stands in an empty set where empty sets are alike.
NOTHING = -1


def or_nothing(items: Column) -> Column:
    """A set of numbers, or one that only other empty sets share an item with."""
    return F.when(F.size(items) > 0, items).otherwise(F.array(F.lit(NOTHING).cast("long")))


def weighted(rows: DataFrame, block: list[str], attributes: dict[str, float], least: float) -> DataFrame:
    """Pairs (a, b) of a block whose Jaccards of several set columns, weighted, may add up to `least`, each pair once.

    rows: staged, block columns, id, and a column of sorted numbers for each attribute. If every Jaccard were below
    least / (sum of weights), so would be the sum: candidates are the pairs that reach it in one attribute.
    The caller scores them. Empty sets are like nothing; make them alike by or_nothing.
    """
    bound = least / sum(attributes.values())
    found = None
    for name in attributes:
        sets = rows.select(*block, "id", F.col(name).alias("items")).filter(F.size("items") > 0)
        pairs = similar(staged(sets, "attribute"), block, bound).select("a", "b")
        found = pairs if found is None else found.union(pairs)
    return found.distinct()


def classes(rows: DataFrame, ident: str, block: list[str], items: Column) -> DataFrame:
    """One staged row for each distinct set in a block: block columns, id (the smallest), copies, items. Empty sets are left out."""
    return set_classes(rows.select(*block, F.col(ident).alias("id"), hashed(items).alias("items")), block)


def set_classes(sets: DataFrame, block: list[str]) -> DataFrame:
    """The same of sets that are sorted numbers (block columns, id, items)."""
    sets = sets.filter(F.size("items") > 0)
    return staged(sets.groupBy(*block, "items").agg(F.min("id").alias("id"), F.count("*").alias("copies")), "set_classes")


def _parts(rows: DataFrame, block: list[str], level: Column, part_rows: int | None = None, part_items: int | None = None) -> DataFrame:
    """Staged (block columns, level, n, parts): into how many parts the rows of a block and level are cut."""
    sized = rows.select(*block, level.alias("level"), F.size("items").alias("size"))
    counted = sized.groupBy(*block, "level").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    least = F.greatest(F.col("n") / (part_rows or PART_ROWS), F.col("size") / (part_items or PART_ITEMS))
    many = F.least(F.lit(float(PARTS)), F.col("n") * (PARTS * PARTS / max(1, rows.count())))  # a small block is one task of many anyway
    parts = F.ceil(F.greatest(F.least(least, many), least / GROWTH))
    return staged(counted.select(*block, "level", "n", parts.cast("int").alias("parts")), "parts")


def _own_part() -> Column:
    return F.pmod(F.xxhash64("id", F.lit(7)), "parts").cast("int")


def similar(rows: DataFrame, block: list[str], threshold: float, measure: str = "jaccard", carried: list[str] | None = None) -> DataFrame:
    """Pairs (a, b, score) of a block with a score of at least the threshold, a before b. Exact.

    carried: further columns of the rows that pairs get of both ends (x_a, x_b), so that pairs, which may be many, needn't move.

    rows: a staged table of the block columns, id, items (array of long) and for cosine weights (array of
    double, of a unit vector). By Jaccard, sizes must be within the threshold of each other, so rows are
    laid in levels of size and meet their own level and the next; by cosine all rows of a block meet.
    """
    if measure == "jaccard" and threshold >= 0.5:
        met = _by_rare_items(rows, block, threshold, carried or [])
        if met is not None:
            return met
    level = F.floor(F.log(F.size("items").cast("double")) / -math.log(threshold) + 1e-9).cast("int") if measure == "jaccard" else F.lit(0)
    counts = _parts(rows, block, level)
    above = counts.select(*block, (F.col("level") - 1).alias("level"), F.col("parts").alias("above"))
    below = counts.select(*block, (F.col("level") + 1).alias("level"), F.col("parts").alias("below"))
    known = staged(counts.join(above, [*block, "level"], "left").join(below, [*block, "level"], "left").na.fill(0, ["above", "below"]), "levels")
    placed = attach_groups(rows.withColumn("level", level), known, [*block, "level"], "n", rows.count()).withColumn("part", _own_part())
    spots = lambda n, make: F.transform(F.filter(F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1), lambda k: k < n), make)
    spot = lambda lv, lo, up, hi: F.struct(lv.alias("level"), lo.alias("lo"), up.alias("up"), hi.alias("hi"))
    me, mine = F.col("part"), F.col("level")
    tiles = F.concat(
        spots(F.col("parts"), lambda k: spot(mine, F.least(me, k), F.lit(0), F.greatest(me, k))),
        spots(F.col("above"), lambda k: spot(mine, me, F.lit(1), k)),
        spots(F.col("below"), lambda k: spot(mine - 1, k, F.lit(1), me)),
    )
    more = carried or []
    kept = ["id", "items", *(["weights"] if measure == "cosine" else []), *more]
    dealt = placed.select(*block, *kept, F.struct("level", "part").alias("home"), F.explode(tiles).alias("tile"))
    side = F.when((F.col("home.level") == F.col("tile.level")) & (F.col("home.part") == F.col("tile.lo")), 0).otherwise(1)
    kind = dict(rows.dtypes)["id"]

    def compare(table: pa.Table) -> pa.Table:
        sides, tile = table.column("side").to_numpy(), table.column("tile")[0].as_py()
        left = table.filter(pa.array(sides == 0))
        same = tile["up"] == 0 and tile["lo"] == tile["hi"]
        right = left if same else table.filter(pa.array(sides == 1))
        found = []
        for at in range(0, max(1, left.num_rows), STEP):
            some, others = left.slice(at, STEP), right.slice(at) if same else right
            a, b, scores = _above(some, others, same, threshold, measure)
            one, two = some.column("id").take(pa.array(a)), others.column("id").take(pa.array(b))
            ends = {f"{c}_{end}": own.column(c).take(pa.array(at)) for own, at, end in ((some, a, "a"), (others, b, "b")) for c in more}
            found.append(pa.table({"a": one.cast(id_type(table)), "b": two.cast(id_type(table)), "score": pa.array(scores), **ends}))
        return pa.concat_tables(found)

    both = "".join(f", {c}_{end} {dict(rows.dtypes)[c]}" for end in "ab" for c in more)
    found = dealt.withColumn("side", side).groupBy(*block, "tile").applyInArrow(compare, f"a {kind}, b {kind}, score double{both}")
    return _ordered(found, more)


def _ordered(pairs: DataFrame, carried: list[str]) -> DataFrame:
    """The same pairs with the smaller id as a."""
    turned = lambda one, two: F.when(F.col("a") <= F.col("b"), F.col(one)).otherwise(F.col(two))
    ends = [turned(f"{c}_{x}", f"{c}_{y}").alias(f"{c}_{x}") for x, y in ("ab", "ba") for c in carried]
    return pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "score", *ends)


def _rare_items(rows: DataFrame, block: list[str], threshold: float, total: int) -> DataFrame:
    """The rarest items of each set, as many as have to hold the common ones that are asked for: block columns, id, n (size), items (rarest first, as 32-bit hashes).

    Items are ordered by their counts among ORDER_ROWS rows, then by value. Two items of one hash make candidates and no pair.
    """
    some = rows.filter(F.pmod(F.xxhash64("id", F.lit(11)), F.lit(1 << 20)) < (1 << 20) * min(1.0, ORDER_ROWS / max(1, total)))
    counted = some.select(F.explode("items").alias("i")).groupBy("i").agg(F.count("*").alias("c")).filter("c > 1").orderBy(F.desc("c"), "i").limit(ORDER_ITEMS).toArrow()
    values, counts = (counted.column(c).to_numpy() for c in "ic")
    order = np.argsort(values)
    table = rows.sparkSession.sparkContext.broadcast((values[order], counts[order]))
    kept = [*block, "id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, often = table.value
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                n = pc.list_value_length(part.column("items")).to_numpy()
                row, item = np.repeat(np.arange(len(n)), n), pc.list_flatten(part.column("items")).to_numpy()
                place = np.minimum(np.searchsorted(known, item), max(0, len(known) - 1))
                count = np.where(known[place] == item, often[place], 0) if len(known) else np.zeros(len(item), np.int64)
                sort = np.lexsort((item, count, row))
                k = np.arange(len(item)) - np.repeat(np.cumsum(n) - n, n) + 1
                least = np.ceil(threshold * n - 1e-6)
                own = k <= (n - least + _asked(least))[row]
                short = ((item[sort][own].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).view(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(np.bincount(row[own], minlength=len(n)))].astype(np.int32)), pa.array(short))
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in kept), pa.array(n.astype(np.int32)), lists], [*kept, "n", "items"])

    fields = [*(rows.schema[c] for c in kept), T.StructField("n", T.IntegerType()), T.StructField("items", T.ArrayType(T.IntegerType()))]
    found = rows.select(*kept, "items").mapInArrow(run, T.StructType(fields))
    for c in block:  # as in an equality join, nothing stands in a block that is null
        found = found.filter(F.col(c).isNotNull())
    return found


def _asked(shared: np.ndarray) -> np.ndarray:
    """How many of the first common items are looked for where sets must share so many."""
    return np.minimum(SHARED + shared // MORE, shared)


def by_group(batches: Iterator[pa.RecordBatch], settle: Callable[[pa.Table], Iterator[pa.RecordBatch]]) -> Iterator[pa.RecordBatch]:
    """What settle gives of rows that come by g; it gets tables of one or more whole groups, which may go on in the next batch."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        g = batch.column("g").to_numpy()
        if not len(g):
            continue
        last = 0
        if g[0] != g[-1]:
            last = len(g) - int(np.argmax(g[::-1] != g[-1]))
            yield from settle(pa.Table.from_batches([*held, batch.slice(0, last)]))
            held = []
        elif held and held[-1].column("g")[0].as_py() != g[0]:
            yield from settle(pa.Table.from_batches(held))
            held = []
        held.append(batch.slice(last))
    if held:
        yield from settle(pa.Table.from_batches(held))


def _tiles(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """The candidates of each tile (g) of a table whose rows come by tile."""
    g = table.column("g").to_numpy()
    starts = np.flatnonzero(np.r_[True, g[1:] != g[:-1]])
    for start, end in zip(starts, np.r_[starts[1:], len(g)], strict=True):
        yield from _candidates(table.slice(start, end - start), threshold)


def _candidates(table: pa.Table, threshold: float) -> Iterator[pa.RecordBatch]:
    """a, b of the rows of a tile whose first shared items are as many as are asked for: rows of side 0 with each other, else those of 1 with those of 2."""
    side = table.column("side").to_numpy()
    same = side[0] == 0
    left = table if same else table.filter(pa.array(side == 1))
    right = left if same else table.filter(pa.array(side == 2))
    if not left.num_rows or not right.num_rows:
        return
    n2, ids2 = right.column("n").to_numpy().astype(np.int64), right.column("id").combine_chunks()
    r2, c2 = _flat(right, "items")
    r2 = r2.astype(np.int32)
    behind2 = (n2[r2] - _places(r2)).astype(np.int32)
    by = np.argsort(c2, kind="stable").astype(np.int32)
    c2, r2, behind2 = c2[by], r2[by], behind2[by]
    del by
    until_row, first = np.cumsum(_sizes(left)), 0
    while first < left.num_rows:  # what is made of the left is bounded, too
        last = max(first + 1, int(np.searchsorted(until_row, (until_row[first - 1] if first else 0) + STEP_ITEMS, side="right")))
        yield from _shared_enough(left.slice(first, last - first), first if same else -left.num_rows, (n2, ids2, r2, c2, behind2), threshold)
        first = last


def _places(row: np.ndarray) -> np.ndarray:
    """The place, from 1, of each item among those of its row."""
    starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]])
    return np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)])) + 1


def _shared_enough(left: pa.Table, offset: int, right: tuple, threshold: float) -> Iterator[pa.RecordBatch]:
    """The candidates of some rows with those of the right behind them: row i meets row j if i + offset < j."""
    n2, ids2, r2, c2, behind2 = right
    part, width = threshold / (1 + threshold), len(n2)
    n1, ids1 = left.column("n").to_numpy().astype(np.int64), left.column("id").combine_chunks()
    r1, c1 = _flat(left, "items")
    behind1 = n1[r1] - _places(r1)
    low = np.searchsorted(c2, c1)
    number = np.searchsorted(c2, c1, side="right") - low
    until = np.cumsum(number)
    until_row = until[np.searchsorted(r1, np.arange(left.num_rows), side="right") - 1]  # no set is empty
    first = 0
    while first < left.num_rows:
        before = int(until_row[first - 1]) if first else 0
        last = max(first + 1, int(np.searchsorted(until_row, before + PAIRS, side="right")))
        start, stop = np.searchsorted(r1, (first, last))
        codes, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        while start < stop:  # several steps only where a single row meets so many
            end = min(stop, max(start + 1, int(np.searchsorted(until, (until[start - 1] if start else 0) + PAIRS, side="right"))))
            own = number[start:end]
            x = np.repeat(np.arange(start, end), own)
            y = np.arange(len(x)) - np.repeat(np.cumsum(own) - own, own) + low[x]
            i, j = r1[x], r2[y]
            hit = i + offset < j
            x, y, i, j = x[hit], y[hit], i[hit], j[hit]
            shared = np.ceil((n1[i] + n2[j]) * part - 1e-6).astype(np.int64)
            hit = (np.minimum(behind1[x], behind2[y]) + _asked(shared) >= shared) & (np.minimum(n1[i], n2[j]) >= shared)
            found, c = np.unique(i[hit] * width + j[hit], return_counts=True)
            if len(codes):
                found, at = np.unique(np.r_[codes, found], return_inverse=True)
                c = np.bincount(at, np.r_[counts, c]).astype(np.int64)
            codes, counts, start = found, c, end
        i, j = codes // width, codes % width
        hit = counts >= _asked(np.ceil((n1[i] + n2[j]) * part - 1e-6).astype(np.int64))
        if hit.any():
            yield pa.RecordBatch.from_arrays([ids1.take(pa.array(i[hit])), ids2.take(pa.array(j[hit]))], ["a", "b"])
        first = last


def _by_rare_items(rows: DataFrame, block: list[str], threshold: float, carried: list[str]) -> DataFrame | None:
    """The pairs of similar by Jaccard, from sets that share some of their rarest items; None where tiles are less work. Exact.

    Sets of n and m items with a Jaccard of t share at least w = t / (1 + t) * (n + m). The j-th item that they share, in one order
    of all items, has at least w - j shared ones behind it in both, so the first few (_asked) of them stand where their number and
    what is behind make w. The rare items of two parts of a block meet in a task, which counts what pairs share; only candidates leave
    it. Tiles of all items are taken where rare items bring more pairs together than blocks have, or too many candidates are left.
    """
    total = rows.count()
    if total < LEAST_ROWS:
        return None
    few = staged(_rare_items(rows, block, threshold, total), "rare_items")
    square = lambda of, *by: of.groupBy(*by).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n").cast("double") * F.col("n")), F.lit(0.0))).first()[0]
    each, share = few.select(*block, F.explode("items").alias("i")), 1 if total <= COUNT_ROWS else 16
    if share * square(each.filter(F.col("i").bitwiseAND(share - 1) == 0), *block, "i") > square(rows, *block):
        return None
    known = _parts(few, block, F.lit(0), RARE_ROWS, RARE_ITEMS).select(*block, F.col("n").alias("rows"), "parts")
    placed = attach_groups(few, known, block, "rows", total) if block else few.crossJoin(F.broadcast(known))
    placed = placed.withColumn("part", _own_part()).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    tile = F.xxhash64(*block, F.least("part", "other"), F.greatest("part", "other")).alias("g")
    side = F.when(F.col("part") == F.col("other"), 0).when(F.col("part") < F.col("other"), 1).otherwise(2).alias("side")
    kind = dict(rows.dtypes)["id"]
    met = placed.select(tile, side, "n", "id", "items").repartition("g").sortWithinPartitions("g")
    close = staged(met.mapInArrow(lambda batches: by_group(batches, lambda table: _tiles(table, threshold)), f"a {kind}, b {kind}"), "candidates")
    if close.count() > CANDIDATES * total:
        return None
    side = lambda end: rows.select(F.col("id").alias(end), F.col("items").alias(f"{end}_items"), *(F.col(c).alias(f"{c}_{end}") for c in carried))
    both = F.size(F.array_intersect("a_items", "b_items"))
    score = F.round(both / (F.size("a_items") + F.size("b_items") - both), 9)
    ends = [f"{c}_{end}" for end in "ab" for c in carried]
    found = side("a").join(small(close), "a").join(side("b"), "b").select("a", "b", score.alias("score"), *ends).filter(F.col("score") >= round(threshold, 9))
    return _ordered(found, carried)


def id_type(table: pa.Table) -> pa.DataType:
    return table.schema.field("id").type


def _sizes(table: pa.Table) -> np.ndarray:
    return pc.list_value_length(table.column("items")).to_numpy()


def _flat(table: pa.Table, name: str) -> tuple[np.ndarray, np.ndarray]:
    """The row and the value of each element of a list column."""
    return np.repeat(np.arange(table.num_rows), _sizes(table)), pc.list_flatten(table.column(name)).to_numpy()


def _products(left: pa.Table, right: pa.Table, weighted: bool) -> np.ndarray:
    """For each row of the left and of the right: the number of common items, or the dot product."""
    (r1, c1), (r2, c2) = _flat(left, "items"), _flat(right, "items")
    w1 = _flat(left, "weights")[1] if weighted else np.ones(len(c1), np.float32)
    w2 = _flat(right, "weights")[1] if weighted else np.ones(len(c2), np.float32)
    shared = np.intersect1d(c1, c2)
    out = np.zeros((left.num_rows, right.num_rows), w1.dtype)
    if not len(shared):
        return out
    sides = []
    for r, c, w in ((r1, c1, w1), (r2, c2, w2)):
        at = np.minimum(np.searchsorted(shared, c), len(shared) - 1)
        hit = shared[at] == c
        sides.append((r[hit], at[hit], w[hit], np.bincount(at[hit], minlength=len(shared))))
    often = (sides[0][3] * sides[1][3] * CELLS >= out.size) | (len(shared) <= COLUMNS)
    place = np.cumsum(often) - 1
    for k in range(0, int(often.sum()), COLUMNS):
        halves = []
        for (r, at, w, _), n in zip(sides, out.shape, strict=True):
            own = often[at] & (place[at] >= k) & (place[at] < k + COLUMNS)
            m = np.zeros((n, min(COLUMNS, int(often.sum()) - k)), w1.dtype)
            m[r[own], place[at[own]] - k] = w[own]
            halves.append(m)
        out += halves[0] @ halves[1].T
    (r1, c1, w1), (r2, c2, w2) = ((r[own], at[own], w[own]) for r, at, w, _ in sides for own in [~often[at]])
    by = np.argsort(c2, kind="stable")
    r2, w2 = r2[by], w2[by]
    number = sides[1][3] * ~often
    first = (np.cumsum(number) - number)[c1]  # where the rows of an item begin on the right
    number = number[c1]
    until = np.cumsum(number)
    k, flat = 0, out.reshape(-1)
    while k < len(c1):
        end = max(k + 1, int(np.searchsorted(until, (until[k - 1] if k else 0) + AT_ONCE, side="right")))
        n = number[k:end]
        at = np.arange(int(n.sum())) + np.repeat(first[k:end] - (np.cumsum(n) - n), n)
        low = int(r1[k]) * out.shape[1]
        cell = np.repeat(r1[k:end] * out.shape[1], n) + r2[at] - low
        added = np.bincount(cell, np.repeat(w1[k:end], n) * w2[at] if weighted else None)
        flat[low : low + len(added)] += added.astype(out.dtype)
        k = end
    return out


def _scores(left: pa.Table, right: pa.Table, measure: str) -> np.ndarray:
    both = _products(left, right, measure == "cosine")
    if measure == "jaccard":
        both = both.astype(float)
        return both / np.maximum(_sizes(left)[:, None] + _sizes(right)[None, :] - both, 1)
    return both


def _above(left: pa.Table, right: pa.Table, same: bool, threshold: float, measure: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    if not left.num_rows or not right.num_rows:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    scores = np.round(_scores(left, right, measure), 9)
    hit = scores >= round(threshold, 9)
    if same:
        hit = np.triu(hit, 1)
    a, b = np.nonzero(hit)
    return a, b, scores[a, b]


def nearest(queries: DataFrame, rows: DataFrame, block: list[str], k: int, measure: str = "jaccard", least: float = -math.inf) -> DataFrame:
    """The k best rows of each query in its block: query_id, row_id, score, rank. A row isn't its own neighbour; ties go to the smaller id.

    Both are staged tables of the block columns, id, items (and weights). Each part of the queries meets each
    part of the block's rows; a task gives the k best of its own, which are ranked together at the end.
    """
    q, r = _parts(queries, block, F.lit(0)), _parts(rows, block, F.lit(0))
    kept = ["id", "items", *(["weights"] if measure == "cosine" else [])]

    def dealt(side: DataFrame, own: DataFrame, other: DataFrame, number: int) -> DataFrame:
        named = other.select(*block, F.col("parts").alias("others"))
        known = staged(own.join(named, block) if block else own.crossJoin(F.broadcast(named)), "meeting")  # without a block both have one row
        placed = attach_groups(side, known, block, "n", side.count()) if block else side.crossJoin(F.broadcast(known))
        placed = placed.withColumn("part", _own_part()).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("others") - 1)))
        mine, theirs = ("part", "other") if number == 0 else ("other", "part")
        return placed.select(*block, *kept, F.struct(F.col(mine).alias("q"), F.col(theirs).alias("r")).alias("tile"), F.lit(number).alias("side"))

    kind = dict(rows.dtypes)["id"]

    def compare(table: pa.Table) -> pa.Table:
        sides = table.column("side").to_numpy()
        left, right = table.filter(pa.array(sides == 0)), table.filter(pa.array(sides == 1))
        out: list[tuple] = []
        ids = np.array(right.column("id").to_pylist(), object)
        by_id = np.argsort(ids, kind="stable")
        ids, right = ids[by_id], right.take(pa.array(by_id))
        for at in range(0, left.num_rows if right.num_rows else 0, STEP):
            some = left.slice(at, STEP)
            scores = np.round(_scores(some, right, measure), 6)
            for own, name in zip(scores, some.column("id").to_pylist(), strict=True):
                best = np.flatnonzero(own >= np.partition(own, -(k + 1))[-(k + 1)]) if len(own) > k + 1 else np.arange(len(own))
                order = best[np.argsort(-own[best], kind="stable")][: k + 1]
                out += [(name, ids[j], float(own[j])) for j in order.tolist() if ids[j] != name and own[j] >= least][:k]
        columns = list(zip(*out, strict=True)) if out else [[], [], []]
        return pa.table({"query_id": pa.array(columns[0], id_type(table)), "row_id": pa.array(columns[1], id_type(table)), "score": pa.array(columns[2], pa.float64())})

    both = dealt(queries, q, r, 0).unionByName(dealt(rows, r, q, 1))
    found = both.groupBy(*block, "tile").applyInArrow(compare, f"query_id {kind}, row_id {kind}, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "row_id"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def weighted_terms(rows: DataFrame, ident: str, slot: str, weight: str) -> DataFrame:
    """Sparse vectors (ident, slot, weight) as one staged row each: id, items, weights."""
    packed = rows.groupBy(F.col(ident).alias("id")).agg(F.array_sort(F.collect_list(F.struct(F.col(slot).cast("long").alias("s"), F.col(weight).cast("double").alias("w")))).alias("v"))
    return staged(packed.select("id", F.transform("v", lambda x: x["s"]).alias("items"), F.transform("v", lambda x: x["w"]).alias("weights")), "vectors")


def dense_vectors(rows: DataFrame, ident: str, vector: Column, *block: str) -> DataFrame:
    """Dense unit vectors as staged rows: block columns, id, items (the places), weights."""
    places = F.transform(F.sequence(F.lit(0), F.size(vector) - 1), lambda i: i.cast("long"))
    return staged(rows.select(*block, F.col(ident).alias("id"), places.alias("items"), F.transform(vector, lambda x: x.cast("double")).alias("weights")), "vectors")

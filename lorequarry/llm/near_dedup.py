"""Operator 7: near-duplicates by one-permutation MinHash with optimal densification and star-shaped candidates.

Documents with the same set of shingles are one class. A class has one signature of BINS bins, each with
the least hash that falls in it; an empty bin takes the value of the first full bin on a pseudo-random walk
that all documents share. ROWS bins make a bucket key. In a bucket only edges to its smallest class are
candidates, which are confirmed on the full sets. Where that leaves a bucket with more than one component,
the classes outside its largest component are compared with all others of the bucket, so that no link
between two texts of a bucket is lost, whatever its size. In buckets of up to LARGE classes the pairs whose
sketches, a bit for each bin, are near enough are confirmed like the star's: within 5.5 standard deviations
of what sets at the threshold show, which one pair in twenty million exceeds, far fewer than the one in a
million that no bucket holds. In larger buckets, which mostly share a passage that is common or are a family
of copies with many changes, common shingles are counted in blocks and only links leave a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, chunks, keep_by_key, mix, span_hashes, staged, tidied, utf8, words
from .quality_rules import combine

WORDS = 5
#: Two sets are linked if 100 times their intersection is at least this part of their union.
PERCENT = 75
#: Bins of a signature, and bins in a bucket key. A pair of similarity 0.75 misses all 51 keys once in a million.
BINS, ROWS = 256, 5
#: Standard deviations that a pair's sketches may stand off; beyond it less than one pair in ten million is lost.
DEVIATIONS = 5.5
#: Pairs that the copy of a set is compared with in a task.
PAIRS_PER_COPY = 500
#: Classes of a bucket beyond which its open classes are compared in blocks.
LARGE = 64
#: Shingles of the queries of a block, as a task holds their index; a single larger set is a block of its own.
BLOCK_SHINGLES = 1_000_000
#: Classes that a task compares a block with.
MEMBERS = 2000
#: Common shingles, and pairs of a class and a query, that are counted at a time.
STEP = 400_000
#: Longs of a sketch.
SKETCH = ["s0", "s1", "s2", "s3"]

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def shingle_hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, hash) of the distinct shingles of each document, in order of documents.

    A document of fewer words has its whole sequence as one shingle, one without words none.
    """
    n = len(at) - 1
    data = _LOWER[data]
    starts, ends, first = words(data, at)
    size = np.diff(first)
    h = span_hashes(data, starts, ends)
    doc_of = np.repeat(np.arange(n), size)
    found_doc, found_hash = [], []
    if len(h) >= WORDS:
        window = np.flatnonzero(doc_of[WORDS - 1 :] == doc_of[: len(h) - WORDS + 1])
        found_doc.append(doc_of[window])
        found_hash.append(combine([h[window + k] for k in range(WORDS)]))
    for short in range(1, WORDS):
        docs = np.flatnonzero(size == short)
        found_doc.append(docs)
        found_hash.append(mix(combine([h[first[docs] + k] for k in range(short)]) + np.uint64(short)))
    doc, value = np.concatenate(found_doc), np.concatenate(found_hash)
    order = np.argsort(mix(value ^ mix(doc.astype(np.uint64))), kind="stable")
    doc, value = doc[order], value[order]
    new = np.ones(len(doc), bool)
    new[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
    doc, value = doc[new], value[new]
    order = np.argsort(doc, kind="stable")
    return doc[order], value[order]


def signatures(doc: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """One-permutation signatures (n, BINS) of the documents' shingle hashes; rows without shingles are all ones."""
    full = np.uint64(2**64 - 1)
    out = np.full((n, BINS), full, np.uint64)
    spread = mix(value ^ np.uint64(0x2545F4914F6CDD1D))
    np.minimum.at(out.reshape(-1), doc * BINS + (spread >> np.uint64(56)).astype(np.int64), spread)
    has = out != full
    alone = has.sum(1) == 1
    out[alone] = out[alone].min(1)[:, None]
    row, column = np.nonzero(~has & (has.sum(1) > 1)[:, None])
    step = 0
    while len(row):  # optimal densification: each empty bin walks on its own until it meets a full one
        step += 1
        target = (mix(column.astype(np.uint64) + np.uint64(BINS * step)) >> np.uint64(56)).astype(np.int64)
        hit = has[row, target]
        out[row[hit], column[hit]] = out[row[hit], target[hit]]
        row, column = row[~hit], column[~hit]
    return out


def band_keys(signature: np.ndarray) -> np.ndarray:
    bands = BINS // ROWS
    parts = signature[:, : bands * ROWS].reshape(-1, bands, ROWS)
    key = combine([np.arange(bands, dtype=np.uint64)[None, :] * np.uint64(0xD6E8FEB86659FD93), *(parts[:, :, r] for r in range(ROWS))])
    return key.astype(np.int64)


def sign(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n_shingles, the digest of the set, its sketch, and the bucket keys (none without shingles)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                n = len(texts)
                doc, value = shingle_hashes(*utf8(texts))
                size = np.bincount(doc, minlength=n)
                ends = np.concatenate([[0], np.cumsum(size)])
                sums = []
                for salt in (0x9E6C63D0876A9A47, 0xC2B2AE3D27D4EB4F):
                    total = np.concatenate([[np.uint64(0)], np.cumsum(mix(value ^ np.uint64(salt)), dtype=np.uint64)])
                    sums.append((total[ends[1:]] - total[ends[:-1]]).astype(np.int64))
                has = size > 0
                signature = signatures(doc, value, n)
                keys = band_keys(signature[has])
                sketch = np.packbits((signature & np.uint64(1)).astype(np.uint8), axis=1).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(has)]) * (BINS // ROWS)
                bands = pa.ListArray.from_arrays(pa.array(offsets.astype(np.int32)), pa.array(keys.reshape(-1)))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(size.astype(np.int64)), *map(pa.array, sums), *(pa.array(np.ascontiguousarray(sketch[:, k])) for k in range(4)), bands], ["doc_id", "n_shingles", "d1", "d2", *SKETCH, "bands"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(tidied(run), f"doc_id {kind}, n_shingles long, d1 long, d2 long, " + ", ".join(f"{c} long" for c in SKETCH) + ", bands array<long>")


def shingle_sets(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """doc_id and the array of its distinct shingle hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                doc, value = shingle_hashes(*utf8(texts))
                offsets = np.searchsorted(doc, np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.ListArray.from_arrays(pa.array(offsets), pa.array(value.astype(np.int64)))], ["doc_id", "shingles"])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    return source.mapInArrow(tidied(run), f"doc_id {kind}, shingles array<long>")


def likely(a: str, b: str) -> Column:
    """Whether the classes a and b may be linked, by their sizes and sketches."""
    x, y = F.col(f"{a}.n_shingles"), F.col(f"{b}.n_shingles")
    least, most = F.least(x, y), F.greatest(x, y)
    differ = sum((F.bit_count(F.col(f"{a}.{c}").bitwiseXOR(F.col(f"{b}.{c}"))) for c in SKETCH[1:]), F.bit_count(F.col(f"{a}.s0").bitwiseXOR(F.col(f"{b}.s0"))))
    away = 1 - PERCENT / 100
    spread = F.sqrt((BINS / 2) ** 2 * away * (1 - away) / F.least(least / 2, F.lit(float(BINS))) + BINS * away / 4)
    return (100 * least >= PERCENT * most) & (differ <= BINS * away / 2 + DEVIATIONS * spread)


def mixed(rows: DataFrame, total: int) -> DataFrame:
    """The rows of buckets with more than one label, with `major`, the bucket's commonest label.

    rows: a staged table of `total` rows with bucket, label and size. Hot buckets stay where they are.
    """
    by_label = rows.groupBy("bucket", "label").agg(F.count("*").alias("n"), F.max("size").alias("size"))
    buckets = by_label.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("major"), F.count("*").alias("labels"), F.max("size").alias("size"))
    return attach_groups(rows.drop("size"), staged(buckets, "bucket_labels"), ["bucket"], "size", total).filter("labels > 1").drop("labels")


def open_pairs(found: DataFrame) -> DataFrame:
    """Likely pairs (a, b) of the mixed rows of a bucket that differ in label. One of them isn't of the bucket's commonest label."""
    few, every = found.filter("label <> major").alias("m"), found.alias("o")
    once = (F.col("o.label") == F.col("o.major")) | (F.col("m.rep") < F.col("o.rep"))
    met = few.join(every, (F.col("m.bucket") == F.col("o.bucket")) & (F.col("m.label") != F.col("o.label")) & once & likely("m", "o"))
    return met.select(F.least("m.rep", "o.rep").alias("a"), F.greatest("m.rep", "o.rep").alias("b"))


def block_links(rows: DataFrame, sets: DataFrame) -> DataFrame:
    """Links (a, b) between classes of different labels that share a bucket, by counting common shingles in blocks.

    rows: the staged mixed rows, all classes of the buckets; sets: doc_id, shingles. The queries are the
    classes outside their bucket's commonest label, in blocks of about BLOCK_SHINGLES. A class goes to the
    blocks that have a query of one of its buckets, spread over tasks of MEMBERS, each with a copy of the
    block; a bucket's classes meet its blocks in parts of MEMBERS, so no bucket is one task. A task holds one
    block, streams the classes past it and emits one link for each query and label, never the pairs.
    """
    spark = rows.sparkSession
    queries = staged(rows.filter("label <> major").groupBy("rep").agg(F.min("major").alias("major"), F.max("n_shingles").alias("n_shingles")), "queries")
    per_major = staged(queries.groupBy("major").agg(F.count("*").alias("n"), F.sum("n_shingles").alias("shingles")), "query_counts")
    of_major = attach_groups(queries.drop("n_shingles"), per_major, ["major"], "n", queries.count())
    block = F.xxhash64("major", F.pmod(F.xxhash64("rep"), F.ceil(F.col("shingles") / BLOCK_SHINGLES)))
    blocks = staged(of_major.select("rep", block.alias("block")), "query_blocks")
    parts = F.ceil(F.col("size") / MEMBERS)
    met = rows.select("bucket", "rep", "size").join(blocks, "rep").select("bucket", "block", parts.alias("parts")).distinct()
    at = met.select("bucket", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part"))
    dealt = rows.select("bucket", "rep", F.pmod(F.xxhash64("rep"), parts).alias("part"))
    members = staged(dealt.join(at, ["bucket", "part"]).select("rep", "block").distinct(), "block_members")
    sizes = staged(members.groupBy("block").agg(F.count("*").alias("n")).withColumn("tasks", F.ceil(F.col("n") / MEMBERS)), "block_sizes")
    spread = attach_groups(members, sizes, ["block"], "n", members.count()).select("rep", "block", F.pmod(F.xxhash64("rep"), "tasks").alias("task"), F.lit(1).alias("kind"))
    copies = blocks.join(sizes, "block").select("rep", "block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("tasks") - 1)).alias("task"), F.lit(0).alias("kind"))
    labelled = rows.select("rep", "label").distinct()
    full = spread.unionByName(copies).join(labelled, "rep").join(sets.withColumnRenamed("doc_id", "rep"), "rep")
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    whole = full.repartition(tasks, "block", "task").sortWithinPartitions("block", "task", "kind", "rep")
    kind = dict(rows.dtypes)["rep"]
    return whole.select("block", "task", "kind", "rep", "label", "shingles").mapInArrow(tidied(_count_blocks), f"a {kind}, b {kind}")


def _count_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    key, held, index, done = None, [], None, set()
    for batch in batches:
        block, task, kind = (batch.column(c).to_numpy() for c in ("block", "task", "kind"))
        cuts = np.flatnonzero((block[1:] != block[:-1]) | (task[1:] != task[:-1]) | (kind[1:] != kind[:-1])) + 1
        for lo, hi in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows], strict=True):
            if hi == lo:
                continue
            if key != (block[lo], task[lo]):
                key, held, index, done = (block[lo], task[lo]), [], None, set()
            part = batch.slice(lo, hi - lo)
            lists = part.column("shingles")
            own = (np.array(part.column("rep").to_pylist(), object), np.array(part.column("label").to_pylist(), object), np.diff(lists.offsets.to_numpy()), lists.flatten().to_numpy())
            if kind[lo] == 0:
                held.append(own)
                continue
            if index is None:
                ids, labels, size, flat = (np.concatenate(x) for x in zip(*held, strict=True))
                owner = np.repeat(np.arange(len(ids)), size)
                order = np.argsort(flat, kind="stable")
                index = (ids, labels, size, flat[order], owner[order])
            yield _links_of(own, index, done, part.schema.field("rep").type)


def _links_of(members: tuple, index: tuple, done: set, id_kind: pa.DataType) -> pa.RecordBatch:
    """The new links between members and the queries of the index."""
    ids, labels, size, flat, owner = index
    rep, label, n, shingles = members
    first, last = np.searchsorted(flat, shingles, "left"), np.searchsorted(flat, shingles, "right")
    ends = np.concatenate([[0], np.cumsum(n)])
    work = np.concatenate([[0], np.cumsum(last - first)])[ends]
    a, b, lo = [], [], 0
    while lo < len(rep):
        hi = max(lo + 1, int(np.searchsorted(work, work[lo] + STEP, "right")) - 1)
        hi = min(hi, lo + max(1, STEP // len(ids)))
        f, m = first[ends[lo] : ends[hi]], (last - first)[ends[lo] : ends[hi]]
        member = np.repeat(np.repeat(np.arange(hi - lo), n[lo:hi]), m)
        at = np.arange(m.sum()) + np.repeat(f - (np.cumsum(m) - m), m)
        both = np.bincount(member * len(ids) + owner[at], minlength=(hi - lo) * len(ids)).reshape(hi - lo, len(ids))
        near = 100 * both >= PERCENT * (n[lo:hi, None] + size[None, :] - both)
        for i, q in zip(*(x.tolist() for x in np.nonzero(near)), strict=True):
            if label[lo + i] != labels[q] and (q, label[lo + i]) not in done:
                done.add((q, label[lo + i]))
                a.append(ids[q])
                b.append(rep[lo + i])
        lo = hi
    return pa.RecordBatch.from_pydict({"a": pa.array(a, id_kind), "b": pa.array(b, id_kind)})


class Linker:
    """Confirms pairs on the full sets of the documents; texts are read again only for classes in a pair."""

    def __init__(self, docs: DataFrame, id_col: str, text_col: str):
        self.docs, self.id_col, self.text_col = docs, id_col, text_col

    def sets(self, ids: DataFrame) -> DataFrame:
        """The staged sets (doc_id, shingles) of the documents with these ids (one column)."""
        named = ids.select(F.col(ids.columns[0]).alias(self.id_col)).distinct()
        return staged(shingle_sets(keep_by_key(self.docs, named, [self.id_col]), self.id_col, self.text_col), "sets")

    def confirm(self, pairs: DataFrame) -> DataFrame:
        """The staged pairs (a, b) whose sets reach the threshold."""
        spark = pairs.sparkSession
        total = pairs.count()
        if not total:
            return spark.createDataFrame([], pairs.schema)
        sets = self.sets(pairs.select("a").union(pairs.select("b")))
        counts = staged(pairs.groupBy("a").agg(F.count("*").alias("n")).withColumn("copies", F.ceil(F.col("n") / PAIRS_PER_COPY)), "pair_counts")
        dealt = attach_groups(pairs, counts, ["a"], "n", total).withColumn("copy", F.pmod(F.xxhash64("b"), "copies"))
        left = sets.join(counts, sets["doc_id"] == counts["a"]).select("a", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)).alias("copy"), F.col("shingles").alias("x"))
        right = sets.select(F.col("doc_id").alias("b"), F.col("shingles").alias("y"))
        both = F.size(F.array_intersect("x", "y"))
        near = 100 * both >= PERCENT * (F.size("x") + F.size("y") - both)
        found = dealt.select("a", "b", "copy").join(right, "b").join(left, ["a", "copy"]).filter(near)
        return staged(found.select("a", "b").distinct(), "links")


def components(links: DataFrame) -> DataFrame:
    """(node, label) of the nodes in links (a, b): label is the smallest node reachable.

    Each round every node takes its smallest neighbour, twice over, and the graph is contracted to what is
    left between different labels. A star is done in one round; a chain takes the logarithm of its length.
    """
    edges = links.select("a", "b").filter("a <> b")
    labels = None
    while edges.limit(1).count():
        ends = edges.union(edges.select("b", "a"))
        parent = staged(ends.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("near")).select("node", F.least("node", "near").alias("parent")), "parents")
        up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("label"))
        step = staged(parent.join(up, "parent").select("node", "label"), "steps")
        if labels is None:
            labels = step
        else:
            onward = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = staged(labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label")), "labels")
        first = edges.join(step.select(F.col("node").alias("a"), F.col("label").alias("x")), "a")
        moved = first.join(step.select(F.col("node").alias("b"), F.col("label").alias("y")), "b")
        edges = staged(moved.filter("x <> y").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(), "edges")
    if labels is None:
        return links.select(F.col("a").alias("node"), F.col("a").alias("label"))
    return labels


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Components of near-duplicates: id_col, n_shingles, component_id (the smallest id reachable), kept.

    A document's set is its distinct 5-word shingles, ASCII letters in lower case; with fewer words the
    whole sequence; without words it is empty and linked with nothing.

    Texts are read once for the signatures and again for classes with candidates, and never move. Copies
    are one class, so they add no candidates. Groups that hold a thousandth of the rows are broadcast.

    A null text is empty; a row with a null id is linked with nothing, has a null component and is kept;
    rows that share an id are one node and share their fate; an empty table gives no rows; other columns
    are never read, whatever their names. Very long texts are signed whole. Of a component the smallest id
    stays; texts of one set are a class, so a tie between them can't change a result.
    """
    signed = staged(sign(docs, id_col, text_col), "signatures")
    total = signed.count()
    node = F.col("n_shingles").cast("boolean") & F.col("doc_id").isNotNull()
    digest = ["d1", "d2"]
    own = [*digest, "n_shingles", *SKETCH]
    classes = staged(signed.filter(node).groupBy(*own).agg(F.min("doc_id").alias("rep"), F.count("*").alias("n_docs"), F.first("bands").alias("bands")), "classes")
    members = classes.select(F.explode("bands").alias("bucket"), "rep")
    counted = members.groupBy("bucket").agg(F.min("rep").alias("centre"), F.count("*").alias("size"))
    shared = staged(counted.filter("size > 1"), "buckets")
    met = staged(attach_groups(members, shared, ["bucket"], "size", classes.count()), "met")
    grouped = staged(met.join(classes.select("rep", "n_shingles", *SKETCH), "rep"), "members")
    centres = classes.select(F.col("rep").alias("centre"), "n_shingles", *SKETCH)
    hubs = staged(centres.join(shared.select("centre").distinct(), "centre", "left_semi"), "hubs")
    star = grouped.filter("rep <> centre").select("centre", "rep", "n_shingles", *SKETCH).distinct().alias("m").join(hubs.alias("c"), F.col("m.centre") == F.col("c.centre")).filter(likely("m", "c"))
    linker = Linker(docs.select(id_col, text_col), id_col, text_col)
    links = linker.confirm(staged(star.select(F.col("c.centre").alias("a"), F.col("m.rep").alias("b")), "star"))
    # Buckets that still hold more than one component: the classes outside the largest against all others.
    labels = components(links)
    known = grouped.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep")).drop("centre")
    known = staged(known, "labelled")
    opened = staged(mixed(known, known.count()), "open")
    large = opened.filter(F.col("size") > LARGE)
    near = linker.confirm(staged(open_pairs(opened.filter(F.col("size") <= LARGE)).distinct(), "completing"))
    by_block = staged(block_links(large, linker.sets(large.select("rep"))), "block_links")
    more = near.union(by_block.select(F.least("a", "b"), F.greatest("a", "b"))).distinct()
    if more.limit(1).count():
        labels = components(links.union(more))
    settled = staged(classes.select(*digest, "n_docs", "rep").join(labels.withColumnRenamed("node", "rep"), "rep", "left").select(*digest, "n_docs", F.coalesce("label", "rep").alias("component_id")), "settled")
    placed = attach_groups(signed.filter(node).select("doc_id", "n_shingles", *digest), settled, digest, "n_docs", total)
    alone = signed.filter(~node).select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    answer = placed.select("doc_id", "n_shingles", "component_id").unionByName(alone)
    return answer.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))).withColumnRenamed("doc_id", id_col)

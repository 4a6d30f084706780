"""Centroids, statistics of clusters, and vectors of terms."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text
from ..staging import fits, staged
from . import graphs, near


#: Grams that a task gathers before it hands them on.
FLUSH = 200_000


def cluster_stats(clusters: DataFrame) -> DataFrame:
    """Clusters, members, singletons, the largest and the mean size."""
    sizes = clusters.groupBy("leader").agg(F.count("*").alias("n"))
    return sizes.agg(F.count("*").alias("clusters"), F.sum("n").alias("members"), F.count_if(F.col("n") == 1).alias("singletons"), F.max("n").alias("largest"), F.round(F.avg("n"), 6).alias("mean_size"))


def assigned(rows: DataFrame, centroids: DataFrame, threshold: float) -> DataFrame:
    """The nearest centroid (centroid, vector) of each row (staged: id, items, weights) of unit vectors, null below the threshold.

    Rows and centroids meet in tiles; a tie goes to the smaller centroid.
    """
    apart = 1 << 40  # ids of centroids are none of the rows'
    named = near.dense_vectors(centroids.withColumn("centroid", F.col("centroid").cast("long") + apart), "centroid", F.col("vector"))
    return near.nearest(rows, named, [], 1, "cosine").select(F.col("query_id").alias("id"), F.when(F.col("score") >= threshold, F.col("row_id") - apart).alias("centroid"), "score")


def centroids(rows: DataFrame, label: str, vector: str) -> DataFrame:
    """Mean vector of each label, as an array."""
    parts = rows.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("m"))
    packed = parts.groupBy(label).agg(F.array_sort(F.collect_list(F.struct("i", "m"))).alias("p"))  # one entry for each dimension
    return packed.select(F.col(label).alias("centroid"), F.transform("p", lambda s: s["m"]).alias("vector"))


def _grams(text: str) -> Counter:
    """The pairs and triples of neighbouring characters."""
    pairs = list(map(str.__add__, text, text[1:]))
    found = Counter(pairs)
    found.update(map(str.__add__, pairs, text[2:]))
    return found


def hashed_terms(docs: DataFrame, ident: str, content: str, dimensions: int = 2048) -> DataFrame:
    """Sparse tf-idf vectors (ident, slot, weight) of hashed character pairs and triples, of length 1.

    Texts are read twice: once for the number of texts that each gram stands in, of which a task sends one row a gram, and
    once to make each text's whole vector where it is read, if the table of grams may be broadcast. Else grams are joined with it.
    """
    kind = dict(docs.dtypes)[ident]
    dense = docs.select(F.col(ident).alias("_id"), F.regexp_replace(F.lower(content), r"\s+", "").alias("_dense"))

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()

        def made() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["term", "n"])

        for batch in batches:
            for t in batch.column("_dense").to_pylist():
                found.update(_grams(t or "").keys())
                if len(found) >= FLUSH:
                    yield made()
                    found.clear()
        yield made()

    n = docs.agg(F.count("*").alias("n"))
    df = dense.mapInArrow(held, "term string, n long").groupBy("term").agg(F.sum("n").alias("df")).crossJoin(F.broadcast(n))  # one row of totals
    terms = staged(df.select("term", F.pmod(text.fnv1a(F.col("term")), F.lit(dimensions)).cast("long").alias("slot"), text.idf(F.col("n"), F.col("df")).alias("idf")), "gram_weights")
    if not fits(terms):
        return _joined_terms(dense, terms, ident, kind)
    table = docs.sparkSession.sparkContext.broadcast(terms.toArrow())

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = table.value
        place = {t: i for i, t in enumerate(known.column("term").to_pylist())}
        slot, idf = known.column("slot").to_numpy(), known.column("idf").to_numpy()
        for batch in batches:
            rows, slots, weights = [], [], []
            for row, t in enumerate(batch.column("_dense").to_pylist()):
                found = _grams(t or "")
                if found:
                    at = np.fromiter(map(place.__getitem__, found), np.int64, len(found))
                    w = np.bincount(slot[at], np.fromiter(found.values(), np.float64, len(found)) * idf[at], minlength=dimensions)
                    used = np.flatnonzero(w)
                    rows.append(np.full(len(used), row))
                    slots.append(used)
                    weights.append(w[used] / np.sqrt((w[used] ** 2).sum()))
                if rows and (sum(map(len, rows)) >= FLUSH or row == batch.num_rows - 1):
                    own = batch.column("_id").take(pa.array(np.concatenate(rows)))
                    yield pa.RecordBatch.from_arrays([own, pa.array(np.concatenate(slots)), pa.array(np.concatenate(weights))], [ident, "slot", "weight"])
                    rows, slots, weights = [], [], []
            if rows:
                own = batch.column("_id").take(pa.array(np.concatenate(rows)))
                yield pa.RecordBatch.from_arrays([own, pa.array(np.concatenate(slots)), pa.array(np.concatenate(weights))], [ident, "slot", "weight"])

    return dense.mapInArrow(weigh, f"`{ident}` {kind}, slot long, weight double")


def _joined_terms(dense: DataFrame, terms: DataFrame, ident: str, kind: str) -> DataFrame:
    """The same by a join of all grams, where the table of grams is large."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, grams, counts = [], [], []
            for row, t in enumerate(batch.column("_dense").to_pylist()):
                found = _grams(t or "")
                rows += [row] * len(found)
                grams += found.keys()
                counts += found.values()
                if len(rows) >= FLUSH or row == batch.num_rows - 1:
                    own = batch.column("_id").take(pa.array(rows, pa.int64()))
                    yield pa.RecordBatch.from_arrays([own, pa.array(grams, pa.string()), pa.array(counts, pa.int64())], [ident, "term", "tf"])
                    rows, grams, counts = [], [], []

    counted = dense.mapInArrow(count, f"`{ident}` {kind}, term string, tf long")
    slots = counted.join(terms, "term").groupBy(ident, "slot").agg(F.sum(F.col("tf") * F.col("idf")).alias("w"))
    length = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(ident)))  # the slots of one text
    return slots.select(ident, "slot", (F.col("w") / length).alias("weight"))


def cluster_batch(rows: DataFrame, known: DataFrame, threshold: float, first: int = 0) -> tuple[DataFrame, DataFrame]:
    """Assign a batch of unit vectors (staged: id, items, weights) to known centroids, and cluster the others among themselves.

    known: centroid (long), vector. Gives id, centroid for every row, and the centroids with the new ones. A row that is no
    centroid's leads, in the order of ids, the free ones like it; its vector is a new centroid, numbered from `first` by id.
    """
    near_known = staged(assigned(rows, known, threshold).select("id", "centroid"), "assigned") if known.limit(1).count() else None
    fit = rows.select("id").limit(0).withColumn("centroid", F.lit(None).cast("long")) if near_known is None else near_known.filter("centroid is not null")
    free = staged(rows.join(fit.select("id"), "id", "left_anti"), "free_rows")
    pairs = staged(near.similar(free, [], threshold, "cosine").select("a", "b"), "free_pairs")
    led = staged(graphs.leader_clusters(free.select("id"), pairs, []), "free_leaders")
    leaders = staged(numbered(led.filter("id = leader").select(F.col("id").alias("leader")), "leader", first), "new_centroids")
    new = leaders.join(free.select(F.col("id").alias("leader"), F.col("weights").alias("vector")), "leader").select("centroid", "vector")
    found = led.join(leaders, "leader").select("id", "centroid")
    return fit.unionByName(found), known.select(F.col("centroid").cast("long").alias("centroid"), F.col("vector").cast("array<double>").alias("vector")).unionByName(new)


def numbered(rows: DataFrame, ident: str, first: int = 0) -> DataFrame:
    """rows with centroid, their place in the order of ids from `first` on: a place in a range, and the ranges before."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = staged(rows.repartitionByRange(parts, ident).withColumn("_part", F.spark_partition_id()), "id_ranges")
    sums = placed.groupBy("_part").agg(F.count("*").alias("n"))
    before = sums.select("_part", F.coalesce(F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("b"))  # a row for each range
    place = F.row_number().over(Window.partitionBy("_part").orderBy(ident))
    return placed.join(F.broadcast(before), "_part").select(*rows.columns, (F.col("b") + place - 1 + first).cast("long").alias("centroid"))


def block_vectors(rows: DataFrame, block: str, ident: str, words: Column, topics: Column) -> DataFrame:
    """Staged unit vectors of tf times ln(N / df) within each block: block, id, items, weights; a word in all rows of a block weighs nothing.

    Topics (an array of counts) stand in with a weight too small to matter, so that rows that share one are candidates.
    """
    each = rows.select(block, F.col(ident).alias("id"), F.explode(words).alias("term")).groupBy(block, "id", "term").agg(F.count("*").alias("tf"))
    df = each.groupBy(block, "term").agg(F.count("*").alias("df"))
    n = rows.groupBy(block).agg(F.count("*").alias("n"))
    weighed = each.join(df, [block, "term"]).join(n, block).select(block, "id", F.xxhash64("term").alias("slot"), (F.col("tf") * text.idf(F.col("n"), F.col("df"), "plain")).alias("w")).filter("w > 0")
    norm = F.sqrt(F.sum(F.col("w") * F.col("w")).over(Window.partitionBy(block, "id")))
    shared = rows.select(block, F.col(ident).alias("id"), F.posexplode(topics).alias("slot", "n")).filter("n > 0").select(block, "id", F.col("slot").cast("long").alias("slot"), F.lit(1e-6).alias("w"))
    both = weighed.select(block, "id", "slot", (F.col("w") / norm).alias("w")).unionByName(shared)
    packed = both.groupBy(block, "id").agg(F.array_sort(F.collect_list(F.struct("slot", "w"))).alias("v"))
    return staged(packed.select(block, "id", F.transform("v", lambda x: x["slot"]).alias("items"), F.transform("v", lambda x: x["w"]).alias("weights")), "vectors")

"""A vector index: rows in lists around centroids, searched exactly by bounds on distance or approximately by the nearest lists.

Vectors have unit length, so the cosine follows from the distance. The centroids are fitted on a bounded
sample; every row is in the index, in the list of its nearest centroid. A row of list l stands at most
radius[l] from the centroid, so a list can hold a row within r of a query only if the query stands within
r + radius[l] of its centroid. A query first looks through its own list; the k-th best found there bounds r.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import staged
from . import near

#: Rows that the centroids are fitted on at most (those of smallest hash), lists at most, and steps of the fit.
SAMPLE_ROWS, MAX_LISTS, STEPS = 20_000, 1024, 12
#: Rows that are held against all centroids at a time, and numbers of queries that leave a task at a time.
STEP, AT_ONCE = 1000, 250_000
#: What rounding may add to a distance.
SLACK = 1e-5


def _matrix(column: pa.Array) -> np.ndarray:
    """The vectors of a list column without nulls as rows of unit length (a zero vector stays)."""
    flat = pc.list_flatten(column).to_numpy(zero_copy_only=False).astype(np.float64)
    x = flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def _distances(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (centroids * centroids).sum(1)[None] - 2 * x @ centroids.T, 0))


def fit_centroids(x: np.ndarray, lists: int) -> np.ndarray:
    """k-means by Lloyd's steps from rows far apart (each next one is the farthest from those chosen)."""
    chosen, least = [0], np.full(len(x), np.inf)
    while len(chosen) < min(lists, len(x)):
        least = np.minimum(least, ((x - x[chosen[-1]]) ** 2).sum(1))
        if least.max() <= 0:
            break
        chosen.append(int(least.argmax()))
    centroids = x[chosen].copy()
    for _ in range(STEPS):
        own = _distances(x, centroids).argmin(1)
        size = np.bincount(own, minlength=len(centroids))
        sums = np.zeros_like(centroids)
        np.add.at(sums, own, x)
        centroids[size > 0] = sums[size > 0] / size[size > 0, None]
    return centroids


class VectorIndex:
    """rows (staged): list, id, items, weights, the vectors as near.nearest takes them; centroids and radius of each list."""

    def __init__(self, table: DataFrame, ident: str, vector: str, lists: int | None = None):
        """Index every row of the table (ident, vector). lists: the root of the number of rows, if not given.

        Rows without a vector are left out; vectors must have one length.
        """
        source = table.select(F.col(ident).alias("id"), F.col(vector).cast("array<double>").alias("v")).filter("v is not null and size(v) > 0")
        n = source.count()
        share = min(1.0, 1.2 * SAMPLE_ROWS / max(1, n))
        some = source.filter(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS).select("v").toArrow()
        sample = _matrix(some.column("v").combine_chunks())
        count = min(MAX_LISTS, lists or max(1, math.isqrt(n)))
        self.centroids = fit_centroids(sample, count) if len(sample) else np.zeros((1, 1))
        placed = staged(self._placed(source), "vector_lists")
        found = placed.groupBy("list").agg(F.max("away").alias("r")).collect()  # a row for each list
        self.radius = np.full(len(self.centroids), -np.inf)
        for r in found:
            self.radius[r["list"]] = r["r"]
        self.rows = placed.drop("away")

    def _placed(self, source: DataFrame) -> DataFrame:
        """list, away (distance from its centroid), id, items, weights of (id, v)."""
        centroids, kind = self.centroids, source.schema["id"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
                x = _matrix(batch.column("v"))
                d = _distances(x, centroids) if len(x) else np.zeros((0, 1))
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * x.shape[1])
                places = np.tile(np.arange(x.shape[1]), len(x))
                columns = [pa.array(d.argmin(1).astype(np.int32)), pa.array(d.min(1)), batch.column("id"), pa.ListArray.from_arrays(ends, pa.array(places)), pa.ListArray.from_arrays(ends, pa.array(x.ravel()))]
                yield pa.RecordBatch.from_arrays(columns, ["list", "away", "id", "items", "weights"])

        schema = T.StructType([T.StructField("list", T.IntegerType()), T.StructField("away", T.DoubleType()), kind, T.StructField("items", T.ArrayType(T.LongType())), T.StructField("weights", T.ArrayType(T.DoubleType()))])
        return source.mapInArrow(run, schema)

    def _probed(self, queries: DataFrame, probes: int | None) -> DataFrame:
        """queries (id, items, weights and r, the distance to look within, null: any) with a row for each list that they must look through."""
        centroids, radius = self.centroids, self.radius
        names = ["id", "items", "weights"]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in (b.slice(at, STEP) for b in batches for at in range(0, b.num_rows, STEP)):
                x = _matrix(batch.column("weights"))
                d = _distances(x, centroids) if len(x) else np.zeros((0, len(centroids)))
                if probes is None:
                    r = pc.fill_null(batch.column("r"), np.inf).to_numpy(zero_copy_only=False)
                    hit = d <= r[:, None] + radius[None] + SLACK
                else:
                    hit = np.zeros(d.shape, bool)
                    np.put_along_axis(hit, np.argsort(np.where(radius >= 0, d, np.inf), axis=1)[:, :probes], True, 1)
                    hit &= radius[None] >= 0
                row, to = np.nonzero(hit)
                most = max(1, AT_ONCE // x.shape[1])
                for k in range(0, len(row), most):
                    take = pa.array(row[k : k + most])
                    yield pa.RecordBatch.from_arrays([pa.array(to[k : k + most].astype(np.int32)), *(batch.column(c).take(take) for c in names)], ["list", *names])

        schema = T.StructType([T.StructField("list", T.IntegerType()), *(queries.schema[c] for c in names)])
        return queries.mapInArrow(run, schema)

    def nearest(self, queries: DataFrame, k: int, least: float = -math.inf, probes: int | None = None) -> DataFrame:
        """The k rows of largest cosine for each query: query_id, row_id, score, rank, at least `least`; ties go to the smaller id.

        queries: id, items, weights, such as some of self.rows. A row isn't its own neighbour. Exact without
        probes; with probes only the nearest lists are looked through. Rows stand in one list each and queries
        go to the lists that they need; a list with many rows is compared in tiles (see near.nearest).
        """
        asked = staged(queries.select("id", "items", "weights"), "asked")
        if probes is None:
            own = staged(self._probed(asked.withColumn("r", F.lit(None).cast("double")), 1), "own_lists")
            first = near.nearest(own, self.rows, ["list"], k, "cosine").filter(F.col("rank") == k)
            bound = F.sqrt(F.greatest(2 - 2 * (F.greatest(F.col("score"), F.lit(least)) - 1e-6), F.lit(0.0)))
            known = asked.join(first.select(F.col("query_id").alias("id"), bound.alias("r")), "id", "left")
            if least > -math.inf:
                known = known.withColumn("r", F.coalesce("r", F.lit(math.sqrt(max(0.0, 2 - 2 * (least - 1e-6))))))
        else:
            known = asked.withColumn("r", F.lit(None).cast("double"))
        return near.nearest(staged(self._probed(known, probes), "probed"), self.rows, ["list"], k, "cosine", least)

"""Operator 5: ordinal cumulative-link regression on graded ratings, with hashed-text weights.

A text is the set of its hashed runs of letters and digits and of its runs of other signs, and one bucket
for each measure of its shape, in slots that no hash has. All grades share one weight for each feature; ordered thresholds part the grades:
P(grade <= k) = logistic(threshold[k] - weights of the text). The fit uses a bounded sample of rated rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, chunks, span_hashes, tidied, utf8

BITS = 18
#: Measures of a text's shape, and buckets of each; their slots follow those of the hashes.
SHAPES, BUCKETS = 4, 11
SLOTS = (1 << BITS) + SHAPES * BUCKETS
#: Rated rows that the model is fitted on at most, those with the smallest hash of their id.
TRAIN_ROWS = 8000
#: A feature is used if it stands in so many of them, and its share differs between grades by so many deviations.
MIN_ROWS, MIN_DEVIATIONS = 5, 4.0
DECAY, STEPS = 1e-4, 300
#: A document is kept if the probability of the top grade is at least this.
MIN_TAIL = 0.5

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_KIND = np.full(256, 2, np.uint8)  # 0 white space, 1 letters, digits and beyond ASCII, 2 other signs
_KIND[[c for c in range(256) if c >= 128 or chr(c).isalnum()]] = 1
_KIND[SPACE] = 0
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True


def features(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(document, feature) of the distinct features of each document."""
    n = len(at) - 1
    kind = _KIND[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[at] = True
    change = np.concatenate([kind[1:] != kind[:-1], [True]]) if len(data) else np.zeros(0, bool)
    starts = np.flatnonzero((kind > 0) & (edge[:-1] | np.concatenate([[True], change[:-1]])[: len(data)]))
    ends = np.flatnonzero((kind > 0) & (edge[1:] | change)) + 1
    doc = np.searchsorted(at, starts, "right") - 1
    hashed = (span_hashes(_LOWER[data], starts, ends) >> np.uint64(64 - BITS)).astype(np.int64)
    key = np.unique(doc << BITS | hashed)
    tokens, distinct = np.bincount(doc, minlength=n), np.bincount(key >> BITS, minlength=n)

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[at[1:]] - total[at[:-1]]

    some = np.maximum(tokens, 1)
    shapes = [
        within(_UPPER[data]) / np.maximum(within(kind == 1), 1),
        distinct / some,
        np.bincount(doc[kind[starts] == 2], minlength=n) / some,
        np.log2(tokens + 1) / 20,
    ]
    docs, found = [key >> BITS], [key & (1 << BITS) - 1]
    for k, shape in enumerate(shapes):
        docs.append(np.arange(n))
        found.append((1 << BITS) + BUCKETS * k + np.minimum(shape * 10, BUCKETS - 1).astype(np.int64))
    return np.concatenate(docs), np.concatenate(found)


def logistic(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Ordinal:
    """Shared weights and ordered thresholds."""

    def __init__(self, weights: np.ndarray, thresholds: np.ndarray):
        self.weights, self.thresholds = weights, thresholds

    def tails(self, doc: np.ndarray, feature: np.ndarray, n: int) -> np.ndarray:
        """P(grade > k) of n documents, a column for each threshold."""
        score = np.bincount(doc, self.weights[feature], minlength=n)
        return 1 - logistic(self.thresholds - score[:, None])


def informative(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray) -> np.ndarray:
    """The features whose share differs between two neighbouring grades, or between a grade and those above."""
    used = np.zeros(SLOTS, bool)
    levels = np.unique(grade)
    for k in range(len(levels) - 1):
        low = grade == levels[k]
        for high in (grade == levels[k + 1], grade > levels[k]):
            a = np.bincount(feature[low[doc]], minlength=SLOTS)
            b = np.bincount(feature[high[doc]], minlength=SLOTS)
            share = (a + b + 1) / (low.sum() + high.sum() + 2)
            spread = np.sqrt(share * (1 - share) * (1 / low.sum() + 1 / high.sum()))
            used |= (a + b >= MIN_ROWS) & (np.abs(a / low.sum() - b / high.sum()) >= MIN_DEVIATIONS * spread)
    return used


def fit(doc: np.ndarray, feature: np.ndarray, grade: np.ndarray, grades: int) -> Ordinal:
    """Maximum likelihood with weight decay, by full-batch gradient steps with momentum (Adam)."""
    n, weights = len(grade), np.zeros(SLOTS)
    thresholds = np.linspace(-1.0, 1.0, grades - 1) if grades > 2 else np.zeros(1)
    if not n:
        return Ordinal(weights, np.full(grades - 1, -30.0))  # nothing is known: all get the top grade
    used = np.flatnonzero(informative(doc, feature, grade))
    place = np.full(SLOTS, -1)
    place[used] = np.arange(len(used))
    doc, feature = doc[place[feature] >= 0], place[feature[place[feature] >= 0]]
    point = np.concatenate([np.zeros(len(used)), thresholds])
    mean, square = np.zeros_like(point), np.zeros_like(point)
    m = len(used)
    above, below = grade < grades - 1, grade > 0
    for step in range(1, STEPS + 1):
        score = np.bincount(doc, point[feature], minlength=n)
        t = point[m:]
        upper = np.where(above, logistic(t[np.minimum(grade, grades - 2)] - score), 1.0)
        lower = np.where(below, logistic(t[np.maximum(grade - 1, 0)] - score), 0.0)
        p = np.maximum(upper - lower, 1e-12)
        up, low = np.where(above, upper * (1 - upper), 0) / p, np.where(below, lower * (1 - lower), 0) / p
        by_threshold = np.bincount(np.maximum(grade - 1, 0), low, minlength=grades - 1)[: grades - 1] - np.bincount(np.minimum(grade, grades - 2), up, minlength=grades - 1)[: grades - 1]
        slope = np.concatenate([np.bincount(feature, (up - low)[doc], minlength=m) / n + DECAY * point[:m], by_threshold / n])
        mean, square = 0.9 * mean + 0.1 * slope, 0.99 * square + 0.01 * slope**2
        rate = 0.1 if step <= 2 * STEPS // 3 else 0.02
        point = point - rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-8)
        point[m:] = np.maximum.accumulate(point[m:])
    weights[used] = point[:m]
    return Ordinal(weights, point[m:])


def extract(docs: DataFrame, keep: str) -> DataFrame:
    """`keep` (a column and its type) and the features of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                doc, feature = features(*utf8(texts))
                order = np.argsort(doc, kind="stable")
                offsets = np.searchsorted(doc[order], np.arange(len(texts) + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(name), pa.ListArray.from_arrays(pa.array(offsets), pa.array(feature[order].astype(np.int32)))], [name, "features"])

    name = keep.split()[0]
    return docs.select(name, "text").mapInArrow(tidied(run), f"{keep}, features array<int>")


def train(docs: DataFrame, ratings: DataFrame, grades: int, id_col: str, text_col: str) -> Ordinal:
    """Fit on TRAIN_ROWS rated documents; ratings has id_col and grade (0 to grades - 1), the lowest counts of several."""
    rated = ratings.filter("grade is not null").groupBy(id_col).agg(F.min("grade").alias("grade"))
    share = 1.2 * TRAIN_ROWS / max(1, rated.count())
    some = rated.filter(F.pmod(F.xxhash64(id_col), F.lit(1 << 20)) < share * (1 << 20)).orderBy(F.xxhash64(id_col), id_col).limit(TRAIN_ROWS)
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text")).join(F.broadcast(some.withColumnRenamed(id_col, "id")), "id")
    one = rows.groupBy("id").agg(F.min("grade").cast("int").alias("grade"), F.min(F.struct(F.xxhash64("text"), "text")).alias("t"))  # of repeated ids one text
    one = one.orderBy(F.xxhash64("id"), "id").select("grade", F.col("t.text").alias("text"))
    table = extract(one, "grade int").toArrow().combine_chunks()
    size = np.array([len(f) for f in table.column("features")], np.int64)
    flat = np.concatenate([c.values.to_numpy()[c.offsets[0].as_py() : c.offsets[-1].as_py()] for c in table.column("features").chunks] or [np.zeros(0, np.int64)])
    return fit(np.repeat(np.arange(len(size)), size), flat.astype(np.int64), table.column("grade").to_numpy().astype(np.int64), grades)


def classify(docs: DataFrame, ratings: DataFrame, grades: int = 3, id_col: str = "doc_id", text_col: str = "text", min_tail: float = MIN_TAIL, key_col: str | None = None) -> DataFrame:
    """Grade every whole text: id_col (or key_col, where given), expected_grade, tail_1 .. (P(grade >= k)), kept.

    kept: the probability of the top grade is at least min_tail. The sample that the model is fitted on
    is bounded by TRAIN_ROWS; weights for SLOTS features go to the executors. No rows move.

    A null or empty text has shape features only; a null id gets a grade but no rating; repeated rows get
    the same grade, and of texts with one rated id the one of smallest hash is fitted on; a very long text is graded whole; a tail that equals min_tail keeps its document; of several
    ratings of an id the lowest counts; without ratings every document is kept; an empty table gives no rows;
    other columns are never read, whatever their names.
    """
    model = train(docs, ratings, grades, id_col, text_col)
    tails = [f"tail_{k}" for k in range(1, grades)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                tail = model.tails(*features(*utf8(texts)), len(texts))
                columns = [pa.array(tail.sum(1)), *(pa.array(np.ascontiguousarray(tail[:, k])) for k in range(grades - 1)), pa.array(tail[:, -1] >= min_tail)]
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), *columns], ["doc_id", "expected_grade", *tails, "kept"])

    key = key_col or id_col
    kind = docs.schema[key].dataType.simpleString()
    schema = f"doc_id {kind}, expected_grade double, " + ", ".join(f"{t} double" for t in tails) + ", kept boolean"
    return docs.select(docs[key].alias("doc_id"), docs[text_col].alias("text")).mapInArrow(tidied(run), schema).withColumnRenamed("doc_id", key)


def ratings_of(labels: DataFrame) -> DataFrame:
    """Grades from the labels of quality and toxicity: 0 poor, 1 toxic, 2 good."""
    grade = F.when(F.col("quality").isNull(), None).when(F.col("quality") == 0, 0).when(F.col("toxic") == 1, 1).otherwise(2)
    return labels.select("doc_id", grade.alias("grade"))

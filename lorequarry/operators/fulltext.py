"""A stored text index: postings by term with positions and impacts, in blocks that search can leave unread.

A posting's impact is what its term adds to a text's BM25 score. The postings of a term are cut by levels of
impact and then into blocks of bounded size, so a term that stands in most texts is many blocks. Tables of an
index, under one folder: `blocks` (in folders by bucket, sorted by term), `levels` (what is in each term's
levels, the largest impact first of all) and `texts` (the words of each text).
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text
from ..staging import HOT_PARTS, scratch, small, staged

#: Postings of a block, about; levels of impact; folders of blocks.
BLOCK, LEVELS, BUCKETS = 1000, 24, 32
#: Words whose postings leave a task at a time.
PLACES = 100_000
K1, B = 1.2, 0.75


def _bucket(term: Column) -> Column:
    """Terms of one first character share a bucket, so that those of one prefix do."""
    return F.pmod(F.xxhash64(F.substring(term, 1, 1)), F.lit(BUCKETS)).cast("int")


def _words(query: str) -> Column:
    return text.words(F.lit(query))


class TextIndex:
    """An index in a folder: build() writes it, open() finds it again."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.texts, self.stats = (spark.read.parquet(f"{folder}/{t}") for t in ("texts", "stats"))
        kind = self.texts.schema["id"].dataType.simpleString()
        schemas = {"blocks": f"term string, level int, part int, postings array<struct<id: {kind}, impact: double, at: array<int>>>, bucket int", "levels": "term string, level int, n long, top double, bucket int"}
        self.blocks, self.levels = (spark.read.schema(schema).parquet(f"{folder}/{name}") for name, schema in schemas.items())

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> TextIndex:
        return cls(spark, folder)

    @classmethod
    def build(cls, rows: DataFrame, ident: str, content: str, folder: str | None = None) -> TextIndex:
        """Index all rows of (ident, content); a null text has no words. ident must tell rows apart."""
        spark = rows.sparkSession
        folder = folder or f"{scratch(spark)}/text-index-{uuid.uuid4().hex[:12]}"
        save = lambda df, name, *by: df.write.option("compression", "zstd").partitionBy(*by).parquet(f"{folder}/{name}")
        save(rows.select(F.col(ident).alias("id"), F.coalesce(text.words(F.col(content)), F.array().cast("array<string>")).alias("words")), "texts")
        texts = spark.read.parquet(f"{folder}/texts")
        save(texts.agg(F.count("*").alias("n"), F.coalesce(F.avg(F.size("words")), F.lit(0.0)).alias("mean")), "stats")
        n, mean = spark.read.parquet(f"{folder}/stats").first()

        # A text's postings are made where it is read, and move once, to their block. Levels follow from the share alone.
        share = cls._impact(F.size("at"), F.col("len"), F.lit(0), n, mean)[1]
        level = F.least(F.lit(LEVELS - 1), F.floor((1 - share / (K1 + 1)) * LEVELS)).cast("int")  # 0 has the largest
        found = staged(cls._postings(texts).select("id", "term", "at", share.alias("share"), level.alias("level")), "postings")
        counted = staged(found.groupBy("term", "level").agg(F.count("*").alias("n"), F.max("share").alias("top")), "level_counts")
        df = counted.groupBy("term").agg(F.sum("n").alias("df"))
        weight = cls._impact(F.lit(1), F.lit(1), F.col("df"), n, mean)[0]
        sizes = counted.join(df, "term").select("term", "level", "n", (weight * F.col("top")).alias("top"), weight.alias("weight"), F.ceil(F.col("n") / BLOCK).cast("int").alias("parts"))
        sizes = staged(sizes, "level_sizes")
        key, limit = ["term", "level"], max(2, found.count() // HOT_PARTS)
        known = sizes.select(*key, "n", "weight", "parts")
        hot, cold = known.filter(F.col("n") >= limit), known.filter(F.col("n") < limit)  # as in attach_groups, where both sides would move again
        sides = (found.join(F.broadcast(hot), key), found.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key))
        part = F.pmod(F.xxhash64("id"), F.col("parts")).cast("int")
        posting = F.struct("id", (F.col("weight") * F.col("share")).alias("impact"), "at")
        blocks = reduce(DataFrame.unionByName, (side.groupBy(*key, part.alias("part")).agg(F.collect_list(posting).alias("postings")) for side in sides))
        save(blocks.withColumn("bucket", _bucket(F.col("term"))).sortWithinPartitions("bucket", "term", "level", "part"), "blocks", "bucket")
        save(sizes.select(_bucket(F.col("term")).alias("bucket"), "term", "level", "n", "top").repartitionByRange("bucket", "term").sortWithinPartitions("bucket", "term"), "levels", "bucket")
        return cls(spark, folder)

    @staticmethod
    def _postings(texts: DataFrame) -> DataFrame:
        """id, len, term, at (the places of the term) of texts (id, words). No rows move."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                rows, sizes, terms, places, held = [], [], [], [], 0
                for i, words in enumerate(batch.column("words")):
                    words, own = words.as_py(), {}
                    for at, w in enumerate(words):
                        own.setdefault(w, []).append(at)
                    rows += [i] * len(own)
                    sizes += [len(words)] * len(own)
                    terms += own.keys()
                    places += own.values()
                    held += len(words)
                    if held >= PLACES or i == batch.num_rows - 1:
                        columns = [batch.column("id").take(pa.array(rows, pa.int64())), pa.array(sizes, pa.int32()), pa.array(terms, pa.string()), pa.array(places, pa.list_(pa.int32()))]
                        yield pa.RecordBatch.from_arrays(columns, ["id", "len", "term", "at"])
                        rows, sizes, terms, places, held = [], [], [], [], 0

        fields = [texts.schema["id"], T.StructField("len", T.IntegerType()), T.StructField("term", T.StringType()), T.StructField("at", T.ArrayType(T.IntegerType()))]
        return texts.select("id", "words").mapInArrow(run, T.StructType(fields))

    @staticmethod
    def _impact(tf: Column, length: Column, df: Column, n: int, mean: float) -> tuple[Column, Column]:
        """The idf of a term and the share of it that a posting gets."""
        return F.log((n - df + 0.5) / (df + 0.5) + 1), tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / max(mean, 1e-9)))

    def _within(self, table: DataFrame, terms: list[str], prefix: str | None = None) -> DataFrame:
        """The rows of a table for some terms, or for all that begin with a prefix; only their buckets are read."""
        firsts = sorted({t[:1] for t in (terms if prefix is None else [prefix])})
        buckets = [r[0] for r in self.spark.createDataFrame([(f,) for f in firsts], "f string").select(_bucket(F.col("f"))).collect()] if firsts else []
        return table.filter(F.col("bucket").isin(buckets) & (F.col("term").isin(terms) if prefix is None else F.col("term").startswith(prefix)))

    def _split(self, query: str) -> list[str]:
        return self.spark.range(1).select(_words(query)).first()[0]

    def top(self, query: str, k: int) -> DataFrame:
        """id, score of the k best texts by BM25 of the query's words (any of them); ties go to the smaller id.

        First the levels of largest impact are read until they hold k postings; their texts' whole scores give
        the least score that counts. Levels whose best posting can't reach it, even if its text had the most
        of every other word, stay unread.
        """
        terms = sorted(set(self._split(query)))
        levels = self._within(self.levels, terms).select("term", "level", "n", "top").collect()  # LEVELS rows a word at most
        most = {t: max((r["top"] for r in levels if r["term"] == t), default=0.0) for t in terms}
        first, held = [], 0
        for r in sorted(levels, key=lambda r: -r["top"]):
            if held >= k:
                break
            first.append((r["term"], r["level"]))
            held += r["n"]
        least = self._scored(terms, first).orderBy(F.desc("score")).limit(k).agg(F.count("*").alias("n"), F.min("score").alias("s")).first()
        bound = least["s"] - 1e-6 if least["n"] == k else -1.0
        needed = [(r["term"], r["level"]) for r in levels if r["top"] + sum(m for t, m in most.items() if t != r["term"]) >= bound]
        return self._scored(terms, needed).orderBy(F.desc("score"), "id").limit(k)

    def _scored(self, terms: list[str], levels: list[tuple[str, int]]) -> DataFrame:
        """Whole scores of the texts that stand in some levels of the terms."""
        chosen = reduce(lambda a, b: a | b, ((F.col("term") == t) & F.col("level").isin([lv for u, lv in levels if u == t]) for t in sorted({t for t, _ in levels})), F.lit(False))
        ids = self._within(self.blocks, sorted({t for t, _ in levels})).filter(chosen).select(F.explode("postings.id").alias("id")).distinct()
        known = self._within(self.levels, terms).groupBy("term").agg(F.sum("n").alias("df"))
        n, mean = self.stats.first()
        hits = F.explode(F.filter("words", lambda w: w.isin(terms)))
        held = self.texts.join(small(staged(ids, "candidates")), "id", "left_semi").select("id", F.size("words").alias("len"), hits.alias("term"))
        counted = held.groupBy("id", "len", "term").agg(F.count("*").alias("tf")).join(F.broadcast(known), "term")  # a row for each word of the query
        weight, share = self._impact(F.col("tf"), F.col("len"), F.col("df"), n, mean)
        return counted.groupBy("id").agg(F.round(F.sum(weight * share), 6).alias("score"))

    def match(self, *clauses: str) -> DataFrame:
        """id, score of the texts that every clause holds for: a word, words in this order ("a b"), or a beginning ("ab*").

        score: the impacts of all terms that clauses are about, each clause for itself. A clause without words
        holds for no text. Only the buckets of the clauses' terms are read.
        """
        found = []
        for i, clause in enumerate(clauses):
            prefix = clause.strip()[:-1].lower() if clause.strip().endswith("*") else None
            words = [] if prefix is not None else self._split(clause)
            if prefix is not None:
                held = self._within(self.blocks, [], prefix) if prefix else self.blocks.limit(0)
                one = held.select(F.inline("postings")).groupBy("id").agg(F.sum("impact").alias("score"))
            elif len(words) == 1:
                one = self._within(self.blocks, words).select(F.inline("postings")).select("id", F.col("impact").alias("score"))
            else:
                places = F.create_map(*(x for w in sorted(set(words)) for x in (F.lit(w), F.array(*(F.lit(j) for j, v in enumerate(words) if v == w))))) if words else None
                held = self._within(self.blocks, sorted(set(words))).select("term", F.inline("postings"))
                starts = held.select("id", "term", "impact", F.explode("at").alias("p")).select("id", "term", "impact", "p", F.explode(places[F.col("term")]).alias("j")) if words else None
                one = self.blocks.limit(0).select(F.inline("postings")).select("id", F.col("impact").alias("score"))
                if words:
                    runs = starts.groupBy("id", (F.col("p") - F.col("j")).alias("start")).agg(F.count("*").alias("n"), F.collect_set(F.struct("term", "impact")).alias("t")).filter(F.col("n") == len(words))
                    one = runs.groupBy("id").agg(F.aggregate(F.first("t"), F.lit(0.0), lambda a, x: a + x["impact"]).alias("score"))
            found.append(one.select("id", "score", F.lit(i).alias("clause")))
        every = reduce(DataFrame.unionByName, found)
        return every.groupBy("id").agg(F.round(F.sum("score"), 6).alias("score"), F.countDistinct("clause").alias("n")).filter(F.col("n") == len(clauses)).drop("n")

"""The corpus pipeline: quality rules, quality classifier, exact dedup, MinHash near-dedup, packing.

Each stage reads the Parquet table that its predecessor wrote and works on all of it. Part of the subpackage
lorequarry.llm, and absent with it.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorequarry.llm import exact_dedup, near_dedup, packing, quality_classifier, quality_rules
from lorequarry.llm.common import bound_batches, drop_by_key, drop_staged, staged, staged_tables


#: The column that tells rows apart, as an id may be null or repeated.
KEY = "__lq_key"


def _keyed(docs: DataFrame) -> DataFrame:
    """docs with KEY, half a SHA-256 of id, source and text: rows of one key get one verdict."""
    own = (F.coalesce(F.concat(F.length(c), F.lit(" "), c), F.lit("-")) for c in (docs["doc_id"].cast("string"), docs["source"].cast("string")))
    digest = F.sha2(F.concat(*own, F.coalesce(docs["text"], F.lit(""))), 256)
    return docs.withColumn(KEY, F.unhex(F.substring(digest, 1, 32)))


def _without(docs: DataFrame, verdict: DataFrame, name: str, key: str = KEY) -> DataFrame:
    """The documents that the verdict keeps, with all their columns but KEY. Rows that share a key share the worst verdict."""
    gone = staged(verdict.filter(~F.col("kept")).select(key).distinct(), name)
    return drop_by_key(docs, gone, key).drop(KEY)


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what the base rule or the verdict on its host rejects."""
    bound_batches(spark)
    keyed = _keyed(docs)
    return _without(keyed, quality_rules.host_rules(keyed, id_col=KEY, host_col="source"), "rejected_rules")


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop what is unlikely to get the top grade."""
    ratings = quality_classifier.ratings_of(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    keyed = _keyed(docs)
    return _without(keyed, quality_classifier.classify(keyed, ratings, key_col=KEY), "rejected_grades")


def exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one of equal texts."""
    return exact_dedup.keep_distinct(docs)


def near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the first document of each component of near-duplicates.

    Where ids are repeated, a node is an id and a text, in the order of the ids.
    """
    if not docs.filter("doc_id is not null").groupBy("doc_id").count().filter("count > 1").limit(1).count():
        return _without(docs, near_dedup.near_dedup(docs), "near_copies", "doc_id")
    place = F.lpad(F.hex(F.col("doc_id").cast("long").bitwiseXOR(F.lit(-(1 << 63)))), 16, "0")
    keyed = _keyed(docs).withColumn(KEY, F.concat(place, F.hex(KEY)))
    return _without(keyed, near_dedup.near_dedup(keyed, id_col=KEY), "near_copies")


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of at most 2048 tokens."""
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=0, capacity=2048)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", rules),
    ("quality_classifier", classifier),
    ("exact_dedup", exact),
    ("near_dedup", near),
    ("best_fit_packing", pack),
]

# A classifier, MinHash and a tokenizer have no SQL; tests/llm holds the pipeline against a brute-force version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply all stages to the documents, each on what the one before has written. What a stage staged goes with it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        before = staged_tables()
        docs = staged(stage(spark, docs, sf_dir), name)
        drop_staged(spark, before)
    return docs

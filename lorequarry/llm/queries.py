"""The queries opN_<name>: each applies its operator to the whole table with production parameters."""

from __future__ import annotations

import string
from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import bpe, exact_dedup, language_id, license_scan, near_dedup, packing, prefix_trie, quality_classifier, quality_rules, sharding, spelling, token_counts, token_output
from .common import bound_batches

Query = Callable[[SparkSession, str], DataFrame]


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe.encode_documents(documents(spark, sf_dir), path)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(documents(spark, sf_dir))


def op3_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), shards=8)


def op4_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.host_rules(documents(spark, sf_dir), host_col="source")


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_classifier.classify(documents(spark, sf_dir), quality_classifier.ratings_of(labels))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(documents(spark, sf_dir), digest_all=True)


def op7_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_dedup(documents(spark, sf_dir))


def op8_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return token_output.read_tokens(*token_output.write_tokens(documents(spark, sf_dir), path, end_id=2))


def op9_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(documents(spark, sf_dir))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_50k.json")
    return packing.pack_documents(documents(spark, sf_dir), path, end_id=0, capacity=2048)


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir), min_length=6, min_count=5, ratio=5, drop_one_in=199)


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"), heads=4, family=20)


QUERIES: dict[str, Query] = {
    "op1_byte_bpe": op1_byte_bpe,
    "op2_language": op2_language,
    "op3_sharding": op3_sharding,
    "op4_host_rules": op4_host_rules,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_near_dedup": op7_near_dedup,
    "op8_token_output": op8_token_output,
    "op9_license_scan": op9_license_scan,
    "op10_packing": op10_packing,
    "op11_spelling": op11_spelling,
    "op12_token_counts": op12_token_counts,
    "op13_prefix_trie": op13_prefix_trie,
}

def _license_sql() -> str:
    phrases = ", ".join(f"('{label}', {words.split()!r})" for words, label in license_scan.PHRASES.items())
    listed = lambda text: sorted(set(text.split()))
    templates = ", ".join(f"({k}, '{label}', {license_scan.span_of(words)}, {listed(words)!r}, {listed(must)!r})" for k, (label, words, must) in enumerate(license_scan.TEMPLATES))
    letters = f"translate(%s, '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
    words = r"list_filter(string_split_regex(" + letters + r", '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"
    return f"""
        WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
        w AS (SELECT doc_id, {words % "text"} AS words FROM t),
        i AS (SELECT doc_id, words, unnest(range(1, len(words) + 1)) AS i FROM w),
        places AS (
            SELECT doc_id, label, i - 1 AS start
            FROM i, (VALUES {phrases}) AS p(label, phrase)
            WHERE words[i] = phrase[1] AND words[i : i + len(phrase) - 1] = phrase),
        base AS (
            SELECT doc_id, count(*) AS n_base, min(start) AS first_word, max(start) AS last_word,
                   list(DISTINCT label) AS own FROM places GROUP BY doc_id),
        m(k, label, span, words, must) AS (VALUES {templates}),
        blocks AS (
            SELECT doc_id, span, unnest(list_transform(range(0, greatest(len(words), 1), span), lambda s: list_distinct(words[s + 1 : s + 2 * span]))) AS held
            FROM w, (SELECT DISTINCT span FROM m)),
        found AS (
            SELECT doc_id, label, len(list_intersect(held, words)) / len(words) AS part
            FROM blocks JOIN m USING (span)
            WHERE len(list_intersect(held, words)) >= ceil({license_scan.THRESHOLD} * len(words) - 1e-9) AND len(list_intersect(held, must)) = len(must)),
        more AS (SELECT doc_id, list(DISTINCT label) AS more, max(part) AS best FROM found GROUP BY doc_id)
        SELECT w.doc_id, CAST(len(w.words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
               array_to_string(list_sort(coalesce(own, [])), ',') AS base_labels,
               array_to_string(list_sort(list_distinct(list_concat(coalesce(own, []), coalesce(more, [])))), ',') AS labels,
               CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0)::DOUBLE END AS score
        FROM w LEFT JOIN base USING (doc_id) LEFT JOIN more USING (doc_id)"""


ORACLE_SQL: dict[str, str] = {
    "op6_exact_dedup": r"""
        WITH t AS (
            SELECT doc_id, length(coalesce(text, '')) AS n,
                   sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256
            FROM documents)
        SELECT doc_id,
               first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) AS keep_id,
               count(*) OVER (PARTITION BY text_sha256) AS group_size,
               row_number() OVER (PARTITION BY text_sha256 ORDER BY n DESC, doc_id) = 1 AS kept,
               text_sha256
        FROM t""",
    "op9_license_scan": _license_sql(),
}

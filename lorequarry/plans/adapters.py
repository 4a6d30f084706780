"""The entities of the engine over the star-schema test tables, and the same as SQL common table expressions.

The mapping is ours: conversations are messages, events are feedback on rules, parts are rules, documents
with labels are memories, benchmark passages are a dictionary.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The time at which ages are measured; queries never ask the clock.
NOW = "2025-01-01 00:00:00"
#: A dictionary that the invented prose of the test tables hits.
SIGNALS = [("the", "correction", 0.8), ("and", "preference", 0.6), ("tion", "performance", 0.5), ("ent", "security", 0.7), ("que", "correction", 0.4), ("der", "anti-pattern", 0.9)]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def now():
    return F.lit(NOW).cast("timestamp")


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session_id"), (F.col("turn") + 1).alias("line_number"), "role", F.col("text").alias("content"))


MESSAGES = "messages AS (SELECT conv_id AS session_id, turn + 1 AS line_number, role, text AS content FROM conversations)"


def feedback(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = (
        F.when(F.col("event_type") == "click", "used").when(F.col("event_type") == "view", "ignored").when(F.col("event_type") == "error", "corrected")
        .when((F.col("event_type") == "purchase") & (F.col("value") >= 100), "validated").when(F.col("event_type") == "purchase", "accepted").otherwise("other")
    )
    rating = F.when(F.col("event_type").isin("click", "purchase"), 1 + F.least(F.lit(4), F.floor(F.col("value") / 30)))
    return table(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("rule_id"), F.col("ts").cast("timestamp").alias("ts"), kind.alias("feedback_type"), rating.cast("long").alias("rating"), "value")


FEEDBACK = """feedback AS (
    SELECT event_id, user_id AS rule_id, ts, value,
           CASE WHEN event_type = 'click' THEN 'used' WHEN event_type = 'view' THEN 'ignored'
                WHEN event_type = 'error' THEN 'corrected'
                WHEN event_type = 'purchase' AND value >= 100 THEN 'validated'
                WHEN event_type = 'purchase' THEN 'accepted' ELSE 'other' END AS feedback_type,
           CASE WHEN event_type IN ('click', 'purchase') THEN CAST(1 + least(4, floor(value / 30)) AS BIGINT) END AS rating
    FROM events)"""


#: Texts of rules by a remainder of the size, around the name of the part; the invented prose has no such sentences.
RULE_TEXTS = [
    "Always use {}.", "Never use {}; it is slow.", "Prefer {} instead of guessing, see src/parts.ts.", "Maybe avoid {}.", "总是使用{}。", "不要使用{}，尽量检查接口。",
    "- use `{}` in the component\n- 1. check the database query\nExample: validate all props.", "You are an AI: {} sometimes might help with everything, and it could be anything you like.",
]


def rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.col("p_size")
    priority = F.when(p >= 40, "critical").when(p >= 25, "high").when(p >= 10, "medium").otherwise("low")
    status = F.when(F.col("p_partkey") % 11 == 0, "deprecated").otherwise("active")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("rule_id"), F.lower("p_type").alias("kind"), priority.alias("priority"), (p / 50).alias("confidence"),
        F.split("p_name", " ").alias("keywords"), F.col("p_brand").alias("tech"), F.col("p_type").alias("functional"),
        F.concat(F.lit("size-"), F.floor(p / 10).cast("string")).alias("business"), F.col("p_name").alias("description"), status.alias("status"),
        F.when(F.col("p_partkey") % 3 == 0, "global").when(F.col("p_partkey") % 3 == 1, "organization").otherwise("project").alias("scope"),
        F.concat(F.lit("/srv/p"), (F.col("p_partkey") % 7).cast("string")).alias("project_path"),
        F.replace(F.element_at(F.array(*map(F.lit, RULE_TEXTS)), (p % 8 + 1).cast("int")), F.lit("{}"), F.col("p_name")).alias("content"),
    )


RULES = """rules AS (
    SELECT p_partkey AS rule_id, lower(p_type) AS kind,
           CASE WHEN p_size >= 40 THEN 'critical' WHEN p_size >= 25 THEN 'high' WHEN p_size >= 10 THEN 'medium' ELSE 'low' END AS priority,
           p_size / 50.0::DOUBLE AS confidence, string_split(p_name, ' ') AS keywords, p_brand AS tech, p_type AS functional,
           'size-' || CAST(p_size // 10 AS VARCHAR) AS business, p_name AS description,
           CASE WHEN p_partkey % 11 = 0 THEN 'deprecated' ELSE 'active' END AS status,
           CASE WHEN p_partkey % 3 = 0 THEN 'global' WHEN p_partkey % 3 = 1 THEN 'organization' ELSE 'project' END AS scope,
           '/srv/p' || CAST(p_partkey % 7 AS VARCHAR) AS project_path,
           replace((""" + repr(RULE_TEXTS).replace("\\n", "' || chr(10) || '") + """)[p_size % 8 + 1], '{}', p_name) AS content
    FROM part)"""
PRIORITY_RANK = "CASE priority WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 ELSE 3 END"


def memories(spark: SparkSession, sf_dir: str, made: dict[str, Column] | None = None) -> DataFrame:
    """made: more columns, of the documents' own; they are made before labels are joined, so texts that nothing else reads don't move."""
    docs, labels = table(spark, sf_dir, "documents").withColumns(made or {}), table(spark, sf_dir, "labels")
    d = F.col("doc_id")
    return docs.join(labels, "doc_id", "left").select(
        d.alias("memory_id"), F.col("text").alias("content"), F.col("source").alias("project"),
        F.when(F.col("lang") == "en", "procedural").when(F.col("lang") == "fr", "semantic").otherwise("episodic").alias("kind"),
        F.when(d % 4 == 0, "fact").when(d % 4 == 1, "preference").otherwise("experience").alias("info_class"),
        F.when(d % 13 == 0, "archived").when(d % 7 == 0, "superseded").otherwise("active").alias("status"),
        F.when(d % 17 == 0, "deprecated").when(d % 5 == 0, "promoted").when(F.col("quality") == 1, "validated").otherwise("observed").alias("state"),
        F.least(F.lit(1.0), F.col("n_chars") / 5000).alias("confidence"), ((d % 10) / 10).alias("importance"), (1 + d % 5).cast("double").alias("strength"),
        (F.coalesce("quality", F.lit(0)) * (d % 4)).alias("validations"), F.coalesce("toxic", F.lit(0)).alias("contradictions"), (1 + d % 3).alias("sessions"), (d % 4).alias("recalls"),
        F.when(F.col("quality") == 1, "success").when(F.col("quality") == 0, "failed").otherwise("unknown").alias("outcome"),
        (F.lit("2024-01-01").cast("timestamp") + F.make_dt_interval((d % 365).cast("int"))).alias("created_at"), F.when(d % 3 == 0, (d % 400).cast("int")).alias("ttl_days"),
        *(made or {}),
    )


MEMORIES = """memories AS (
    SELECT doc_id AS memory_id, text AS content, source AS project,
           CASE lang WHEN 'en' THEN 'procedural' WHEN 'fr' THEN 'semantic' ELSE 'episodic' END AS kind,
           CASE doc_id % 4 WHEN 0 THEN 'fact' WHEN 1 THEN 'preference' ELSE 'experience' END AS info_class,
           CASE WHEN doc_id % 13 = 0 THEN 'archived' WHEN doc_id % 7 = 0 THEN 'superseded' ELSE 'active' END AS status,
           CASE WHEN doc_id % 17 = 0 THEN 'deprecated' WHEN doc_id % 5 = 0 THEN 'promoted' WHEN quality = 1 THEN 'validated' ELSE 'observed' END AS state,
           least(1.0, n_chars / 5000.0)::DOUBLE AS confidence, (doc_id % 10) / 10.0::DOUBLE AS importance, (1 + doc_id % 5)::DOUBLE AS strength,
           coalesce(quality, 0) * (doc_id % 4) AS validations, coalesce(toxic, 0) AS contradictions, 1 + doc_id % 3 AS sessions, doc_id % 4 AS recalls,
           CASE quality WHEN 1 THEN 'success' WHEN 0 THEN 'failed' ELSE 'unknown' END AS outcome,
           TIMESTAMP '2024-01-01' + to_days(CAST(doc_id % 365 AS INTEGER)) AS created_at,
           CASE WHEN doc_id % 3 = 0 THEN CAST(doc_id % 400 AS INTEGER) END AS ttl_days
    FROM documents LEFT JOIN labels USING (doc_id))"""


def links(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders link rules and memories; most of a rule's memories exist, some don't."""
    return table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("rule_id"), F.floor(F.col("o_orderkey") / 10).cast("long").alias("memory_id"))


LINKS = "links AS (SELECT o_custkey AS rule_id, o_orderkey // 10 AS memory_id FROM orders)"


def signals(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(i, *s) for i, s in enumerate(SIGNALS)], "signal_id long, text string, pattern_type string, confidence double")


SIGNALS_SQL = "signals(signal_id, text, pattern_type, confidence) AS (VALUES " + ", ".join(f"({i}::BIGINT, '{t}', '{k}', {c}::DOUBLE)" for i, (t, k, c) in enumerate(SIGNALS)) + ")"
WORDS = r"list_filter(regexp_split_to_array(lower({}), '[^\p{{L}}\p{{N}}_+#.\-]+'), lambda x: x <> '')"


def words_sql(column: str) -> str:
    return WORDS.format(column)

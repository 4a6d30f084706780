"""Queries: usage statistics, health, audits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import joins, mining, stats
from . import adapters as a

QUERIES, ORACLE_SQL = {}, {}
COUNTS = ", ".join(["count(feedback_type) AS feedbacks", *(f"count(*) FILTER (feedback_type = '{k}') AS n_{k}" for k in stats.COUNTED), "round(avg(rating), 6) AS mean_rating"])
ZERO = ", ".join(f"coalesce({c}, 0) AS {c}" for c in ("feedbacks", *(f"n_{k}" for k in stats.COUNTED)))


def _usage(key):
    QUERIES[f"usage_by_{key}"] = lambda s, d: stats.usage_by(a.rules(s, d), a.feedback(s, d), key)
    ORACLE_SQL[f"usage_by_{key}"] = f"""
    WITH {a.RULES}, {a.FEEDBACK}, o AS (SELECT {key}, count(*) AS rules, round(avg(confidence), 6) AS mean_confidence FROM rules GROUP BY {key}),
    g AS (SELECT {key}, {COUNTS} FROM feedback JOIN rules USING (rule_id) GROUP BY {key})
    SELECT {key}, rules, mean_confidence, {ZERO}, mean_rating FROM o LEFT JOIN g USING ({key})"""


_usage("kind")
_usage("priority")

QUERIES["usage_by_axis"] = lambda s, d: stats.usage_by_axis(a.rules(s, d), a.feedback(s, d))
_N = ", ".join(f"count(*) FILTER (feedback_type = '{k}') AS n_{k}" for k in stats.COUNTED)
ORACLE_SQL["usage_by_axis"] = f"""
    WITH {a.RULES}, {a.FEEDBACK}, i AS (SELECT rule_id, 'tech' AS dimension, tech AS value FROM rules UNION ALL
        SELECT rule_id, 'functional', functional FROM rules UNION ALL SELECT rule_id, 'business', business FROM rules)
    SELECT i.dimension, i.value, {_N} FROM i JOIN feedback USING (rule_id) GROUP BY i.dimension, i.value"""

QUERIES["usage_overview"] = lambda s, d: stats.overview(a.rules(s, d), a.feedback(s, d))
ORACLE_SQL["usage_overview"] = f"""
    WITH {a.RULES}, {a.FEEDBACK} SELECT (SELECT count(*) FROM rules) AS rules, count(DISTINCT rule_id) AS rules_with_feedback, count(*) AS feedbacks,
        round(avg(rating), 6) AS mean_rating, CAST(min(ts) AS DATE) AS first_day, CAST(max(ts) AS DATE) AS last_day FROM feedback"""

QUERIES["usage_daily"] = lambda s, d: stats.by_day(a.feedback(s, d))
ORACLE_SQL["usage_daily"] = f"WITH {a.FEEDBACK} SELECT CAST(ts AS DATE) AS day, {COUNTS} FROM feedback GROUP BY 1"
QUERIES["usage_weekly"] = lambda s, d: stats.by_week(a.feedback(s, d))
ORACLE_SQL["usage_weekly"] = f"WITH {a.FEEDBACK} SELECT isoyear(ts) || '-W' || lpad(CAST(week(ts) AS VARCHAR), 2, '0') AS week, {COUNTS} FROM feedback GROUP BY 1"
QUERIES["feedback_rollup"] = lambda s, d: stats.feedback_rollup(a.feedback(s, d))
ORACLE_SQL["feedback_rollup"] = f"WITH {a.FEEDBACK} SELECT rule_id, {COUNTS} FROM feedback GROUP BY ROLLUP (rule_id)"

QUERIES["top_rules"] = lambda s, d: stats.top_rules(a.feedback(s, d), 20)
ORACLE_SQL["top_rules"] = f"WITH {a.FEEDBACK} SELECT rule_id, count(*) AS uses FROM feedback WHERE feedback_type IN ('used', 'accepted', 'validated') GROUP BY rule_id ORDER BY uses DESC, rule_id LIMIT 20"

QUERIES["problem_rules"] = lambda s, d: stats.problem_rules(a.feedback(s, d).filter("feedback_type <> 'other'"), 5)
ORACLE_SQL["problem_rules"] = f"""
    WITH {a.FEEDBACK}, r AS (SELECT rule_id, count(*) AS n, count(*) FILTER (feedback_type = 'ignored') AS i, count(*) FILTER (feedback_type = 'corrected') AS c,
        count(*) FILTER (feedback_type IN ('accepted', 'validated')) AS x FROM feedback WHERE feedback_type <> 'other' GROUP BY rule_id HAVING count(*) >= 5),
    q AS (SELECT rule_id, n, round(i / n::DOUBLE, 6) AS ignored_rate, round(c / n::DOUBLE, 6) AS corrected_rate, round(x / n::DOUBLE, 6) AS accepted_rate FROM r),
    p AS (SELECT *, CASE WHEN ignored_rate >= 0.5 THEN 'ignored' WHEN corrected_rate >= 0.3 THEN 'corrected' WHEN accepted_rate < 0.1 THEN 'unaccepted' END AS problem FROM q)
    SELECT * FROM p WHERE problem IS NOT NULL"""

QUERIES["scene_matrix"] = lambda s, d: stats.scene_matrix(a.rules(s, d))
ORACLE_SQL["scene_matrix"] = f"WITH {a.RULES} SELECT coalesce(tech, '*') AS tech, coalesce(functional, '*') AS functional, coalesce(business, '*') AS business, count(DISTINCT rule_id) AS rules FROM rules GROUP BY 1, 2, 3"
QUERIES["scene_axes"] = lambda s, d: stats.scene_axes(a.rules(s, d))
ORACLE_SQL["scene_axes"] = f"WITH {a.RULES} SELECT tech, functional, business, count(*) AS rules FROM rules GROUP BY GROUPING SETS ((tech), (functional), (business))"

QUERIES["knowledge_health"] = lambda s, d: stats.memory_health(a.memories(s, d))
ORACLE_SQL["knowledge_health"] = f"""
    WITH {a.MEMORIES} SELECT count(*) AS memories, count(*) FILTER (status = 'active') AS active, count(*) FILTER (kind = 'procedural') AS procedural,
        count(*) FILTER (contradictions > 0) AS contradicted, count(*) FILTER (state = 'promoted') AS promoted,
        round(count(*) FILTER (contradictions > 0) / count(*)::DOUBLE, 4) AS conflict_rate,
        round(count(*) FILTER (status <> 'active') / count(*)::DOUBLE, 4) AS deletion_rate, round(count(*) FILTER (recalls > 0) / count(*)::DOUBLE, 4) AS hit_rate FROM memories"""
QUERIES["memory_metrics"] = lambda s, d: stats.memory_by_class(a.memories(s, d))
ORACLE_SQL["memory_metrics"] = f"WITH {a.MEMORIES} SELECT kind, state, count(*) AS memories, round(avg(confidence), 6) AS mean_confidence FROM memories GROUP BY ROLLUP (kind, state)"

QUERIES["quality_alerts"] = lambda s, d: stats.quality_alerts(
    a.table(s, d, "documents").join(a.table(s, d, "labels"), "doc_id").groupBy("source").agg(F.round(1 - F.avg("quality"), 6).alias("rejection_rate")), "source", "rejection_rate", 0.1, 0.2
)
ORACLE_SQL["quality_alerts"] = """
    WITH r AS (SELECT source, round(1 - avg(quality), 6) AS rejection_rate FROM documents JOIN labels USING (doc_id) GROUP BY source)
    SELECT source, rejection_rate, CASE WHEN rejection_rate >= 0.2 THEN 'critical' ELSE 'warning' END AS level FROM r WHERE rejection_rate >= 0.1"""

def _occurrences(s, d):
    e = a.table(s, d, "events")
    kind = F.when(F.col("event_type") == "error", "repeated-correction").when(F.col("event_type") == "view", "preference").when(F.col("event_type") == "click", "performance").otherwise("security")
    return e.select(
        kind.alias("kind"), (F.col("user_id") % 40).cast("string").alias("description"), (F.col("event_id") % 50).alias("session_id"), F.col("ts").cast("timestamp").alias("ts"),
        F.when(F.col("value") >= 30, "explicit_correction").when(F.col("value") >= 10, "accept").otherwise("none").alias("action"), (F.col("value") >= 100).alias("validated"), (F.col("user_id") % 40 % 5 == 0).alias("keyword"),
    )


QUERIES["confidence_score"] = lambda s, d: mining.patterns(_occurrences(s, d)).select("kind", "description", "n", "sessions", "confidence")
ORACLE_SQL["confidence_score"] = """
    WITH o AS (SELECT CASE event_type WHEN 'error' THEN 'repeated-correction' WHEN 'view' THEN 'preference' WHEN 'click' THEN 'performance' ELSE 'security' END AS kind,
        CAST(user_id % 40 AS VARCHAR) AS description, event_id % 50 AS session_id, ts, value, user_id % 40 % 5 = 0 AS keyword FROM events),
    g AS (SELECT kind, description, count(*) AS n, count(DISTINCT session_id) AS sessions, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS span,
        count(*) FILTER (value >= 30 OR kind = 'preference' AND value >= 10) AS valid, count(*) FILTER (value >= 100) AS validated, bool_or(keyword) AS keyword FROM o GROUP BY kind, description),
    b AS (SELECT *, least(1.0, least(1.0, n / 10.0::DOUBLE) + CASE WHEN sessions = 1 AND n >= 3 THEN 0.1 ELSE 0 END) * 0.3 + least(1.0, span / 90) * 0.1 + valid / n::DOUBLE * 0.4 + CASE WHEN validated > 0 THEN 0.2::DOUBLE ELSE 0 END AS base FROM g)
    SELECT kind, description, n, sessions, round(least(1.0, CASE n WHEN 1 THEN least(base, 0.6) WHEN 2 THEN least(base, 0.75) ELSE base END
        + CASE WHEN sessions >= 3 THEN 0.15 WHEN sessions = 2 THEN 0.08 ELSE 0 END + CASE WHEN keyword THEN 0.2 ELSE 0 END), 6) AS confidence FROM b"""

QUERIES["orphan_typing"] = lambda s, d: joins.typed_references(
    a.table(s, d, "orders").groupBy(F.col("o_custkey").alias("rule_id")).agg(F.collect_set("o_orderkey").alias("sources")),
    a.table(s, d, "documents").select((F.col("doc_id") * 3).alias("memory_id")),
)
ORACLE_SQL["orphan_typing"] = """
    WITH r AS (SELECT DISTINCT o_custkey AS rule_id, o_orderkey AS memory_id FROM orders),
    c AS (SELECT rule_id, count(*) AS n_refs, count(doc_id) AS n_known FROM r LEFT JOIN documents ON memory_id = doc_id * 3 GROUP BY rule_id)
    SELECT *, CASE WHEN n_refs = 0 THEN 'no_references' WHEN n_known = 0 THEN 'fully_orphaned' WHEN n_known < n_refs THEN 'partially_orphaned' ELSE 'normal' END AS reference_state FROM c"""

QUERIES["unanalyzed_anti"] = lambda s, d: a.table(s, d, "documents").select("doc_id", "source").join(a.table(s, d, "labels"), "doc_id", "left_anti")
ORACLE_SQL["unanalyzed_anti"] = "SELECT doc_id, source FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)"

"""Usage statistics, health, audits and quality metrics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Kinds of feedback that are counted on their own.
COUNTED = ("used", "ignored", "corrected", "accepted", "validated")


def share(part: Column, whole: Column) -> Column:
    """part / whole, 0 for nothing."""
    return F.when(whole > 0, part / whole).otherwise(0.0)


def feedback_counts() -> list[Column]:
    kinds = [F.count_if(F.col("feedback_type") == k).alias(f"n_{k}") for k in COUNTED]
    return [F.count("feedback_type").alias("feedbacks"), *kinds, F.round(F.avg("rating"), 6).alias("mean_rating")]


def usage_by(rules: DataFrame, feedback: DataFrame, key: str) -> DataFrame:
    """Per value of a rule column: rules, mean confidence, and feedback by kind. Feedback on unknown rules is skipped."""
    own = rules.groupBy(key).agg(F.count("*").alias("rules"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))
    given = feedback.join(rules.select("rule_id", key), "rule_id").groupBy(key).agg(*feedback_counts())
    return own.join(given, key, "left").na.fill(0, ["feedbacks", *(f"n_{k}" for k in COUNTED)])


def usage_by_axis(rules: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per dimension and value of the scenes: feedback by kind, in one pass over the feedback."""
    axes = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("tech", "functional", "business"))))
    index = rules.select("rule_id", axes.alias("s")).select("rule_id", "s.*")
    per_rule = feedback.groupBy("rule_id").agg(*(F.count_if(F.col("feedback_type") == k).alias(f"n_{k}") for k in COUNTED))
    return index.join(per_rule, "rule_id").groupBy("dimension", "value").agg(*(F.sum(f"n_{k}").alias(f"n_{k}") for k in COUNTED))


def overview(rules: DataFrame, feedback: DataFrame) -> DataFrame:
    a = rules.agg(F.count("*").alias("rules"))
    b = feedback.agg(F.countDistinct("rule_id").alias("rules_with_feedback"), F.count("*").alias("feedbacks"), F.round(F.avg("rating"), 6).alias("mean_rating"), F.min("ts").cast("date").alias("first_day"), F.max("ts").cast("date").alias("last_day"))
    return a.crossJoin(b)  # one row each


def by_day(feedback: DataFrame) -> DataFrame:
    return feedback.groupBy(F.to_date("ts").alias("day")).agg(*feedback_counts())


def by_week(feedback: DataFrame) -> DataFrame:
    """ISO weeks, named by the year of their Thursday."""
    week = F.concat(F.extract(F.lit("YEAROFWEEK"), "ts").cast("string"), F.lit("-W"), F.lpad(F.weekofyear("ts").cast("string"), 2, "0"))
    return feedback.groupBy(week.alias("week")).agg(*feedback_counts())


def feedback_rollup(feedback: DataFrame) -> DataFrame:
    """Per rule and in total (rule_id null)."""
    return feedback.rollup("rule_id").agg(*feedback_counts())


def top_rules(feedback: DataFrame, limit: int) -> DataFrame:
    return feedback.filter("feedback_type IN ('used', 'accepted', 'validated')").groupBy("rule_id").agg(F.count("*").alias("uses")).orderBy(F.desc("uses"), "rule_id").limit(limit)


def problem_rules(feedback: DataFrame, least: int) -> DataFrame:
    """Rules with enough feedback that are often ignored (.5) or corrected (.3), or hardly accepted (.1)."""
    n = F.col("n")
    rates = feedback.groupBy("rule_id").agg(
        F.count("*").alias("n"),
        *(F.count_if(F.col("feedback_type").isin(*kinds)).alias(name) for name, kinds in (("ignored", ["ignored"]), ("corrected", ["corrected"]), ("accepted", ["accepted", "validated"]))),
    )
    rated = rates.filter(n >= least).select("rule_id", "n", *(F.round(F.col(c) / n, 6).alias(f"{c}_rate") for c in ("ignored", "corrected", "accepted")))
    reason = F.when(F.col("ignored_rate") >= 0.5, "ignored").when(F.col("corrected_rate") >= 0.3, "corrected").when(F.col("accepted_rate") < 0.1, "unaccepted")
    return rated.withColumn("problem", reason).filter("problem IS NOT NULL")


def dictionary_stats(signals: DataFrame) -> DataFrame:
    """Counts and mean confidence by pattern type and in total (null)."""
    return signals.rollup("pattern_type").agg(F.count("*").alias("signals"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def scene_matrix(rules: DataFrame) -> DataFrame:
    """Rules in each combination of the three axes; a missing value stands as *."""
    axes = [F.coalesce(F.col(c), F.lit("*")).alias(c) for c in ("tech", "functional", "business")]
    return rules.select("rule_id", *axes).groupBy("tech", "functional", "business").agg(F.countDistinct("rule_id").alias("rules"))


def scene_axes(rules: DataFrame) -> DataFrame:
    """Rules by value of each single axis."""
    found = rules.groupingSets([["tech"], ["functional"], ["business"]], "tech", "functional", "business").agg(F.count("*").alias("rules"))
    return found


def memory_health(memories: DataFrame) -> DataFrame:
    """One row of totals and rates of the memory store."""
    n = F.count("*")
    live = F.count_if(F.col("status") == "active")
    return memories.agg(
        n.alias("memories"), live.alias("active"), F.count_if(F.col("kind") == "procedural").alias("procedural"),
        F.count_if(F.col("contradictions") > 0).alias("contradicted"), F.count_if(F.col("state") == "promoted").alias("promoted"),
        F.round(share(F.count_if(F.col("contradictions") > 0), n), 4).alias("conflict_rate"),
        F.round(share(n - live, n), 4).alias("deletion_rate"), F.round(share(F.count_if(F.col("recalls") > 0), n), 4).alias("hit_rate"),
    )


def memory_by_class(memories: DataFrame) -> DataFrame:
    """Counts by kind and state, by kind, and in total."""
    return memories.rollup("kind", "state").agg(F.count("*").alias("memories"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def quality_alerts(rates: DataFrame, name: str, rate: str, warning: float, critical: float) -> DataFrame:
    """name, rate, level of those at a warning or critical level."""
    level = F.when(F.col(rate) >= critical, "critical").when(F.col(rate) >= warning, "warning")
    return rates.select(name, rate, level.alias("level")).filter("level IS NOT NULL")


def audit(rules: DataFrame, active: DataFrame, overall: Column, category: Column, least: float = 0.5) -> DataFrame:
    """(rule_id, issue, severity, metric) of rules (with sources, ids of memories): empty_scene, low_quality, orphaned_memory, high_business_ratio.

    overall: the unified score; category: struct(category, allowed) of the text; active: memory_id. The
    metric is the score, or how many references are dead.
    """
    dead = rules.select("rule_id", F.explode("sources").alias("memory_id")).distinct().join(active, "memory_id", "left_anti").groupBy("rule_id").agg(F.count("*").alias("_dead"))
    scored = rules.join(dead, "rule_id", "left").withColumns({"_overall": F.round(overall + 1e-9, 3), "_category": category})
    bare = F.col("tech").isNull() & F.col("functional").isNull() & F.col("business").isNull()
    issue = lambda test, name, level, metric: F.when(test, F.struct(F.lit(name).alias("issue"), F.lit(level).alias("severity"), metric.cast("double").alias("metric")))
    found = F.array(
        issue(bare, "empty_scene", "high", F.lit(0)), issue(F.col("_overall") < least, "low_quality", "high", F.col("_overall")),
        issue(F.col("_dead") > 0, "orphaned_memory", "medium", F.col("_dead")),
        issue(~F.col("_category.allowed") & (F.col("_category.category") != "general"), "high_business_ratio", "medium", F.lit(None)),
    )
    return scored.select("rule_id", F.explode(F.filter(found, lambda x: x.isNotNull())).alias("i")).select("rule_id", "i.*")


def retrieval_metrics(ranked: DataFrame) -> DataFrame:
    """Recall at 1 and 5, MRR, precision at 5, and isolation of (query, rank, relevant, expected, foreign) rows.

    Isolation is the share of queries without a foreign row, one of another namespace, among their hits.
    """
    per = ranked.groupBy("query").agg(
        F.max(F.when((F.col("rank") == 1) & F.col("relevant"), 1.0).otherwise(0.0)).alias("r1"),
        (F.count_if((F.col("rank") <= 5) & F.col("relevant")) / F.max("expected")).alias("r5"),
        F.max(F.when(F.col("relevant"), 1 / F.col("rank")).otherwise(0.0)).alias("rr"),
        (F.count_if((F.col("rank") <= 5) & F.col("relevant")) / 5).alias("p5"), F.when(F.max("foreign"), 0.0).otherwise(1.0).alias("alone"),
    )
    return per.agg(*(F.round(F.avg(c), 6).alias(name) for c, name in (("r1", "recall_at_1"), ("r5", "recall_at_5"), ("rr", "mrr"), ("p5", "precision_at_5"), ("alone", "isolation"))))

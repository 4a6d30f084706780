"""The life of memories: versions, supersession, consolidation, decay, support, promotion."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring


def latest(log: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    """The last record of each key of a log."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return log.withColumn("_rank", rank).filter("_rank = 1").drop("_rank")


def superseded(log: DataFrame, subject: list[str], at: str, tie: str) -> DataFrame:
    """Validity of each record of a subject: valid_from, valid_to (null for the current), status."""
    after = F.lead(at).over(Window.partitionBy(*subject).orderBy(at, tie))
    out = log.withColumn("valid_from", F.col(at)).withColumn("valid_to", after)
    return out.withColumn("status", F.when(F.col("valid_to").isNull(), "active").otherwise("superseded"))


def version_changes(log: DataFrame, key: str, at: str, tie: str, content: str) -> DataFrame:
    """Each version with its number, the content before it and whether it changed."""
    w = Window.partitionBy(key).orderBy(at, tie)
    before = F.lag(content).over(w)
    return log.select(key, tie, F.row_number().over(w).alias("version"), F.col(content).alias("content"), before.alias("previous"), (~F.col(content).eqNullSafe(before)).alias("changed"))


def rolled_back(versions: DataFrame, key: str, to: int) -> DataFrame:
    """Append to each key a copy of its version `to` as the newest."""
    newest = versions.groupBy(key).agg((F.max("version") + 1).alias("version"))
    copy = versions.filter(F.col("version") == to).drop("version").join(newest, key)
    return versions.unionByName(copy.select(*versions.columns))


def decay(memories: DataFrame, now: Column, stale_days: int = 180) -> DataFrame:
    """memory_id, action of the memories that age out.

    conflict_with (what a memory contradicts), expires_at and last_recalled_at count where the memories have them.
    """
    own = lambda name, kind: F.col(name) if name in memories.columns else F.lit(None).cast(kind)
    action = scoring.decay_action(
        F.col("status"), F.col("state"), own("conflict_with", "string").isNotNull(), own("expires_at", "timestamp"), F.col("created_at"), F.col("ttl_days"),
        F.col("info_class"), F.col("recalls"), own("last_recalled_at", "timestamp"), now, stale_days,
    )
    return memories.select("memory_id", action.alias("action")).filter("action IS NOT NULL")


def dependent_rules(actions: DataFrame, links: DataFrame) -> DataFrame:
    """Rules (rule_id) to demote: those that rest on a memory that ages out."""
    return links.join(actions.select("memory_id").distinct(), "memory_id", "left_semi").select("rule_id").distinct()


def linked(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """The links (rule_id, memory_id, weight) after an upsert: of equal ends the incoming one stands, and of several the largest weight."""
    ends = ["rule_id", "memory_id"]
    new = incoming.groupBy(*ends).agg(F.max("weight").alias("weight"))
    old = current.select(*ends).distinct().join(new, ends, "left_anti").withColumn("weight", F.lit(1))
    return new.unionByName(old)


def links_of(links: DataFrame, end: str, ids: DataFrame) -> DataFrame:
    """The links of the wanted rules or memories, looked up from either end."""
    return links.join(ids, end, "left_semi").distinct()


def rule_support(links: DataFrame, memories: DataFrame) -> DataFrame:
    """Mean support of each rule by its memories: .5 without any, .35 if none is known."""
    own = [F.col(c) for c in ("confidence", "validations", "sessions", "strength", "importance", "outcome")]
    scored = memories.select("memory_id", scoring.support(*own, F.col("state") == "promoted", F.lit(0.5)).alias("s"))
    found = links.join(scored, "memory_id", "left").groupBy("rule_id").agg(F.count("memory_id").alias("wanted"), F.avg("s").alias("mean"))
    value = F.when(F.col("wanted") == 0, 0.5).when(F.col("mean").isNull(), 0.35).otherwise(scoring.clamp(F.col("mean")))
    return found.select("rule_id", F.round(value + 1e-9, 6).alias("support"))  # a mean just below a tie rounds as one just above


def promotions(memories: DataFrame) -> DataFrame:
    """Score and eligibility of each active memory."""
    score = F.round(scoring.promotion_score(F.col("confidence"), F.col("sessions"), F.lit(1), F.col("validations"), F.col("strength"), F.col("contradictions")), 6)
    return memories.filter("status = 'active'").select("memory_id", score.alias("score"), scoring.promotable(score, F.col("kind"), F.col("info_class"), F.col("contradictions")).alias("eligible"))


def strengths(events: DataFrame, ident: str, order: list[str], start: float = 1.0) -> DataFrame:
    """Strength of each memory after its events in order: half up or down, never below 0.

    A sum that is held at 0 is its last value less the lowest that it reached below 0, so window sums do.
    """
    step = F.when(F.col("feedback_type").isin("rejected", "corrected", "contradicted"), -0.5).otherwise(0.5)
    w = Window.partitionBy(ident).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    free = events.withColumn("_free", F.lit(start) + F.sum(step).over(w))
    last = free.groupBy(ident).agg(F.max_by("_free", F.struct(*order)).alias("_last"), F.least(F.lit(0.0), F.min("_free")).alias("_low"), F.count("*").alias("events"))
    return last.select(ident, "events", (F.col("_last") - F.col("_low")).alias("strength"))


def merged(cached: DataFrame, fresh: DataFrame) -> DataFrame:
    """Patterns of two runs by type and description: all occurrences, the highest confidence, the latest sight."""
    both = cached.unionByName(fresh)
    return both.groupBy("type", "description").agg(F.sum("occurrences").alias("occurrences"), F.max("confidence").alias("confidence"), F.max("last_seen").alias("last_seen"))


def profile_fold(events: DataFrame, user: str, order: str, vector: str, rate: float = 0.1) -> DataFrame:
    """Exponential moving average of each user's vectors in order, by weights instead of a fold.

    The k-th last of n vectors has weight rate * (1 - rate) ** k, the first one (1 - rate) ** (n - 1).
    """
    w = Window.partitionBy(user).orderBy(F.desc(order))
    n = F.count("*").over(Window.partitionBy(user))
    ranked = events.withColumn("_k", F.row_number().over(w) - 1).withColumn("_n", n)
    weight = F.pow(F.lit(1 - rate), F.col("_k")) * F.when(F.col("_k") == F.col("_n") - 1, 1.0).otherwise(rate)
    parts = ranked.withColumn("_w", weight).select(user, "_w", F.posexplode(vector).alias("i", "x"))
    return parts.groupBy(user, "i").agg(F.sum(F.col("_w") * F.col("x")).alias("value"))

"""Weighted scores, updates and decisions as Column expressions. `now` is always an argument."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Minimum confidence and minimum occurrences of each kind of pattern.
STRATEGIES = {
    "repeated-correction": (0.45, 2),
    "anti-pattern": (0.45, 2),
    "preference": (0.3, 1),
    "performance": (0.4, 1),
    "security": (0.5, 1),
}
# What a pattern's type multiplies its confidence by; none is favoured.
TYPE_FACTORS = {"repeated-correction": 1.0, "preference": 1.0, "anti-pattern": 1.0, "performance": 1.0, "security": 1.0}
#: Rank of a priority in search results.
PRIORITY_RANK = {"critical": 0, "high": 1, "medium": 2, "low": 3}


def clamp(x: Column, low: float = 0.0, high: float = 1.0) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def capped(x: Column, at: float) -> Column:
    """Part of `at`, 1 at most."""
    return F.least(F.lit(1.0), x / at)


def priority_rank(priority: Column) -> Column:
    out = F.lit(len(PRIORITY_RANK))
    for name, rank in PRIORITY_RANK.items():
        out = F.when(priority == name, rank).otherwise(out)
    return out


def days_between(later: Column, earlier: Column) -> Column:
    return (F.unix_micros(later.cast("timestamp")) - F.unix_micros(earlier.cast("timestamp"))) / 86_400_000_000


def memory_score(semantic: Column, lexical: Column, entity: Column, importance: Column, confidence: Column, strength: Column, validations: Column, recency: Column, success: Column, contradictions: Column) -> Column:
    """Relevance of a memory to a query."""
    return (
        semantic * 0.22 + lexical * 0.25 + entity * 0.12 + importance * 0.12 + confidence * 0.12
        + capped(strength, 5) * 0.08 + capped(validations, 3) * 0.06 + recency * 0.03 + success * 0.02
        - capped(contradictions, 2) * 0.12
    )


def memory_score_indexed(semantic: Column, lexical: Column, importance: Column, confidence: Column, strength: Column, validations: Column, recency: Column, contradictions: Column) -> Column:
    """The same for the indexed store, which has no entities."""
    return (
        semantic * 0.22 + lexical * 0.32 + importance * 0.12 + confidence * 0.12 + capped(strength, 5) * 0.08
        + capped(validations, 3) * 0.06 + recency * 0.08 - capped(contradictions, 2) * 0.12
    )


def recency(now: Column, updated: Column, days: float = 30) -> Column:
    return F.greatest(F.lit(0.0), 1 - days_between(now, updated) / days)


def support(confidence: Column, validations: Column, sessions: Column, strength: Column, importance: Column, outcome: Column, promoted: Column, promotion: Column) -> Column:
    """How strongly a memory backs a rule."""
    result = F.when(outcome == "success", 1.0).when(outcome == "failed", 0.0).otherwise(0.5)
    return (
        confidence * 0.30 + capped(validations, 3) * 0.15 + capped(sessions, 3) * 0.15 + capped(strength, 5) * 0.10
        + F.coalesce(importance, F.lit(0.5)) * 0.10 + result * 0.10
        + F.when(promoted, F.coalesce(promotion, F.lit(0.5)) * 0.1).otherwise(0.0)
    )


def promotion_score(confidence: Column, sessions: Column, projects: Column, validations: Column, strength: Column, contradictions: Column) -> Column:
    return clamp(
        confidence * 0.55 + capped(sessions, 3) * 0.1 + capped(projects, 2) * 0.1 + capped(validations, 3) * 0.15
        + capped(strength, 5) * 0.1 - capped(contradictions, 2) * 0.35
    )


def promotable(score: Column, kind: Column, info_class: Column, contradictions: Column) -> Column:
    """Only procedural memories that state no mere fact become rules."""
    return (kind == "procedural") & (info_class != "fact") & (contradictions == 0) & (score >= 0.65)


def fact_upgrade(recalls: Column, confirmed: Column, sessions: Column, linked: Column) -> Column:
    """struct(score, passed, upgrade) of a fact's four checks."""
    checks = [(recalls >= 3, 0.4), (confirmed, 0.3), (sessions >= 2, 0.2), (linked, 0.1)]
    score = sum((F.when(c, w).otherwise(0.0) for c, w in checks), F.lit(0.0))
    passed = sum((F.when(c, 1).otherwise(0) for c, _ in checks), F.lit(0))
    return F.struct(score.alias("score"), passed.alias("passed"), ((passed >= 2) | (F.round(score, 6) >= 0.5)).alias("upgrade"))


def decay_action(status: Column, state: Column, conflict: Column, expires: Column, created: Column, ttl_days: Column, info_class: Column, recalls: Column, recalled: Column, now: Column, stale_days: int = 180) -> Column:
    """archived, deprecated or null: deprecated by state, contradicted, expired, then rarely recalled experiences."""
    expiry = F.coalesce(expires.cast("timestamp"), created.cast("timestamp") + F.make_dt_interval(ttl_days))
    stale = (info_class == "experience") & (recalls < 1) & (days_between(now, F.coalesce(recalled, created)) > stale_days)
    return (
        F.when(status == "archived", None).when(state == "deprecated", "archived").when(conflict, "archived")
        .when(expiry < now, "archived").when(stale, "deprecated")
    )


def outcome_update(prior: Column, outcome: Column, rate: float = 0.1) -> Column:
    """Confidence of a signal after an outcome."""
    likelihood = F.when(outcome == "true_positive", 0.9).when(outcome == "false_positive", 0.1).otherwise(0.5)
    return clamp(prior * (1 - rate) + likelihood * rate, 0.1, 0.95)


def cooccurrence_update(confidence: Column, others: Column) -> Column:
    """Confidence drawn towards the mean of the signals beside it, if any."""
    return F.when(others.isNull(), confidence).otherwise(clamp(confidence * 0.95 + others * 0.05, 0.1, 0.95))


def time_decay(confidence: Column, days: Column) -> Column:
    """Exponential decay once a signal hasn't been seen for 30 days."""
    return F.when(days < 30, confidence).otherwise(clamp(confidence * F.exp(-0.01 * days), 0.1, 0.95))


def staleness(days: Column) -> Column:
    """1 for 90 days, then falling linearly to .5 at 180."""
    return F.when(days < 90, 1.0).otherwise(F.greatest(F.lit(0.5), 1 - (days - 90) / 90 * 0.5))


def pattern_confidence(kind: Column, n: Column, sessions: Column, span_days: Column, valid: Column, validated: Column, keyword: Column) -> Column:
    """Confidence of a pattern from its occurrences: base score, cap, the factor of its type (1 for a type that has none), session bonus, keyword bonus."""
    frequency = F.least(F.lit(1.0), F.least(F.lit(1.0), n / 10) + F.when((sessions == 1) & (n >= 3), 0.1).otherwise(0.0))
    base = frequency * 0.3 + F.least(F.lit(1.0), span_days / 90) * 0.1 + F.when(n > 0, valid / n).otherwise(0.0) * 0.4 + F.when(validated > 0, 1.0).otherwise(0.0) * 0.2
    held = F.when(n == 1, F.least(base, F.lit(0.6))).when(n == 2, F.least(base, F.lit(0.75))).otherwise(base)
    factor = F.lit(1.0)
    for name, by in TYPE_FACTORS.items():
        factor = F.when(kind == name, by).otherwise(factor)
    held = held * factor
    bonus = F.when(sessions >= 3, 0.15).when(sessions == 2, 0.08).otherwise(0.0)
    return F.least(F.lit(1.0), held + bonus + F.when(keyword, 0.2).otherwise(0.0))


def qualifies(kind: Column, confidence: Column, n: Column, minimum: float, discount: Column) -> Column:
    """Whether a pattern is kept: above the minimum, or above the limits of its kind."""
    own = F.lit(False)
    for name, (least, times) in STRATEGIES.items():
        own = own | ((kind == name) & (confidence >= least) & (n >= times))
    return (confidence * discount >= minimum) | own


def rule_priority(kind: Column, confidence: Column) -> Column:
    """Priority by kind, a step up at .9."""
    base = F.when(kind == "security", 0).when(kind.isin("anti-pattern", "repeated-correction"), 1).when(kind == "performance", 2).otherwise(3)
    rank = F.greatest(F.lit(0), base - F.when(confidence >= 0.9, 1).otherwise(0))
    names = F.array(*(F.lit(p) for p in PRIORITY_RANK))
    return F.element_at(names, rank + 1)


def scope_vote(promotion: Column, llm: Column, heuristic: Column, heuristic_confidence: Column) -> Column:
    """struct(scope, confidence): weighted vote of three sources, a tie goes to organization."""
    cautious = promotion.isNotNull() & (promotion != "global") & (llm == "global")
    llm_weight = F.when(cautious, 0.1).otherwise(0.3)
    heuristic_weight = F.when((heuristic == "global") & (heuristic_confidence < 0.7), 0.1).otherwise(0.2)
    sources = [(promotion, F.lit(0.5)), (llm, llm_weight), (heuristic, heuristic_weight)]

    def votes(scope: Column) -> Column:
        return F.round(sum((F.when(v == scope, w).otherwise(0.0) for v, w in sources), F.lit(0.0)), 6)

    most = F.greatest(*(votes(F.lit(s)) for s in ("organization", "project", "global")))
    scope = F.when(most == 0, "project").when(votes(F.lit("organization")) == most, "organization")
    for v, _ in sources:
        scope = scope.when(v.isNotNull() & (votes(v) == most), v)
    return F.struct(scope.alias("scope"), F.least(F.lit(1.0), F.round(most / 0.8, 6)).alias("confidence"))

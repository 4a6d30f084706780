"""Lists, filters, totals and small decisions over the stores of rules, memories, signals, sessions and versions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scoring


# ---------------------------------------------------------------- filters and lists
def same_text(column: str, value: str) -> Column:
    """Equality without regard to case."""
    return F.lower(column) == value.lower()


def listed_rules(rules: DataFrame, kind: str | None = None, priority: str | None = None, least: float | None = None) -> DataFrame:
    """Rules of a kind and a priority with enough confidence; what isn't given doesn't matter."""
    tests = [(kind, F.col("kind") == kind), (priority, F.col("priority") == priority), (least, F.col("confidence") >= (least or 0))]
    for given, test in tests:
        rules = rules.filter(test) if given is not None else rules
    return rules


def listed_signals(signals: DataFrame, limit: int, **wanted: str) -> DataFrame:
    """The signals with the wanted values, the most certain first, then by id."""
    for column, value in wanted.items():
        signals = signals.filter(F.col(column) == value)
    return signals.orderBy(F.desc("confidence"), "signal_id").limit(limit)


def in_namespace(**wanted: str | None) -> Column:
    """Whether a memory belongs to a namespace: each given value equals the row's, or the row has none. Organizations are compared in lower case."""
    test = F.lit(True)
    for column, value in wanted.items():
        if value is not None:
            own, mine = (F.lower(column), value.lower()) if column == "organization" else (F.col(column), value)
            test = test & (F.col(column).isNull() | (own == mine))
    return test


def listed_memories(memories: DataFrame, limit: int, kind: str | None = None, info_class: str | None = None, sensitive: Column | None = None, active: bool = True, found: DataFrame | None = None) -> DataFrame:
    """The newest memories, then by id; `sensitive` hides those where it holds; `found` (memory_id) keeps the hits of a search."""
    if active:
        memories = memories.filter("status = 'active'")
    for column, value in (("kind", kind), ("info_class", info_class)):
        memories = memories.filter(F.col(column) == value) if value is not None else memories
    if sensitive is not None:
        memories = memories.filter(~sensitive)
    if found is not None:
        memories = memories.join(found, "memory_id", "left_semi")
    return memories.orderBy(F.desc("created_at"), "memory_id").limit(min(200, max(1, limit)))


def hidden(memories: DataFrame, sensitive: Column) -> DataFrame:
    """One row: memories that are shown, and those that are hidden as sensitive."""
    return memories.agg(F.count_if(~sensitive).alias("shown"), F.count_if(sensitive).alias("hidden"))


def latest_rows(log: DataFrame, key: list[str], order: list[Column | str], n: int) -> DataFrame:
    """The last n rows of each key, newest first, with their rank."""
    rank = F.row_number().over(Window.partitionBy(*key).orderBy(*order))
    return log.withColumn("rank", rank).filter(F.col("rank") <= n)


def grouped_listing(rules: DataFrame, least: float) -> DataFrame:
    """Rules with enough confidence by priority and kind: how many, the most certain, and their mean confidence."""
    own = rules.filter(F.col("confidence") >= least)
    return own.groupBy("priority", "kind").agg(F.count("*").alias("rules"), F.min_by("rule_id", F.struct(-F.col("confidence"), F.col("rule_id"))).alias("best"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def closest_rules(rules: DataFrame, relevance: Column, limit: int = 3) -> DataFrame:
    """The rules nearest to a request whatever their confidence: by relevance, then confidence, then id."""
    return rules.select("rule_id", "confidence", relevance.alias("relevance")).orderBy(F.desc("relevance"), F.desc("confidence"), "rule_id").limit(limit)


# What a hit on each axis, and on a keyword, adds to a rule's score.
INDEX_WEIGHTS = {"tech": 0.4, "functional": 0.5, "business": 0.3, "keyword": 0.6}


def indexed_rules(rules: DataFrame, request: list[tuple[str, str]], limit: int = 20, least: float = 0.3) -> DataFrame:
    """Rules by the summed weight of the requested (axis, value) pairs that they have, scaled by confidence: rule_id, relevance."""
    value = {**{a: F.lower(F.trim(a)) for a in ("tech", "functional", "business")}}
    score = F.lit(0.0)
    for axis, wanted in request:
        term = wanted.lower().strip()
        hit = F.array_contains(F.transform("keywords", F.lower), term) if axis == "keyword" else value[axis] == term
        score = score + F.when(hit, INDEX_WEIGHTS[axis]).otherwise(0.0)
    found = rules.select("rule_id", "confidence", score.alias("s")).filter((F.col("s") > 0) & (F.col("confidence") >= least))
    return found.select("rule_id", F.round(F.col("s") * (0.7 + F.col("confidence") * 0.3), 6).alias("relevance")).orderBy(F.desc("relevance"), "rule_id").limit(limit)


def proactive_bundles(rules: DataFrame, least: float = 0.6, priority: str = "high", limit: int = 5) -> DataFrame:
    """The technologies with most rules of high priority, and `general` for rules without one: bundle, rules."""
    counts = listed_rules(rules, priority=priority, least=least).groupBy("tech").agg(F.count("*").alias("rules"))
    named = counts.filter("tech is not null").orderBy(F.desc("rules"), "tech").limit(limit)
    return named.select(F.col("tech").alias("bundle"), "rules").unionByName(counts.filter("tech is null").select(F.lit("general").alias("bundle"), "rules"))


def representative_evidence(evidence: DataFrame, group: str, n: int) -> DataFrame:
    """The n most telling pieces of evidence of each group: confidence times the logarithm of their occurrences."""
    score = F.round(F.col("confidence") * F.log(1 + F.col("occurrences")), 6)
    return latest_rows(evidence.withColumn("score", score), [group], [F.desc("score"), "evidence_id"], n)


# ---------------------------------------------------------------- totals
def storage_health(rules: DataFrame, segments: DataFrame) -> DataFrame:
    """One row of totals of the store and its index: rules, segments, distinct ones, index rows without a rule, rules without an index row."""
    a = rules.agg(F.count("*").alias("rules"), F.countDistinct("rule_id").alias("ids"), F.count_if(F.col("status") == "active").alias("active"))
    b = segments.agg(F.count("*").alias("segments"), F.countDistinct("segment").alias("distinct_segments"))
    c = segments.join(rules.select("rule_id"), "rule_id", "left_anti").agg(F.count("*").alias("dangling"))
    d = rules.join(segments.select("rule_id").distinct(), "rule_id", "left_anti").agg(F.count("*").alias("unindexed"))
    return a.crossJoin(b).crossJoin(c).crossJoin(d)  # one row each


def evolution_totals(patterns: DataFrame, occurrences: DataFrame, feedback: DataFrame) -> DataFrame:
    """One row: patterns (fingerprint, sessions, occurrences), all sessions, those with feedback, and means to one decimal."""
    a = patterns.agg(F.count("*").alias("patterns"), F.sum("occurrences").alias("occurrences"), F.round(F.avg("occurrences"), 1).alias("mean_occurrences"), F.round(F.avg("sessions"), 1).alias("mean_sessions"))
    b = occurrences.agg(F.countDistinct("session_id").alias("sessions"))
    c = patterns.join(feedback.select("fingerprint").distinct(), "fingerprint", "left_semi").agg(F.count("*").alias("with_feedback"))
    return a.crossJoin(b).crossJoin(c)  # one row each


def enhanced_confidence(base: Column, sessions: Column, span_days: Column, good: Column, bad: Column) -> Column:
    """Confidence of a pattern with bonuses for sessions, span and good feedback and a penalty for bad, from 0 to 1."""
    total = good + bad
    ratio = lambda x: F.when(total > 0, x / total).otherwise(0.0)
    return scoring.clamp(base + F.least(sessions * 0.05, F.lit(0.20)) + F.least(span_days / 30 * 0.10, F.lit(0.10)) + ratio(good) * 0.15 - ratio(bad) * 0.20)


def adaptive_confidence(n: Column, sessions: Column, span_days: Column, accepted: Column, validated: Column, weights: dict[str, Column]) -> Column:
    """Confidence of a pattern by a user's own weights; corrections and accepts count for every type."""
    frequency = F.least(F.lit(1.0), F.least(F.lit(1.0), n / 10) + F.when((sessions == 1) & (n >= 3), 0.1).otherwise(0.0))
    behaviour = F.when(n > 0, accepted / n).otherwise(0.0)
    proven = F.when(validated > 0, 1.0).otherwise(0.0)
    return frequency * weights["frequency"] + F.least(F.lit(1.0), span_days / 90) * weights["time_span"] + behaviour * weights["behavior"] + proven * weights["validation"]


def support_with_penalty(memories: DataFrame, group: str) -> DataFrame:
    """Mean support of each group of memories, contradictions counting against it; .5 for none."""
    c = F.col
    result = F.when(c("outcome") == "success", 1.0).when(c("outcome") == "failed", 0.0).otherwise(0.5)
    own = c("confidence") * 0.3 + scoring.capped(c("strength"), 5) * 0.2 + c("importance") * 0.1 + scoring.capped(c("validations"), 3) * 0.25 + result * 0.15 - scoring.capped(c("contradictions"), 2) * 0.25
    return memories.groupBy(group).agg(F.round(F.coalesce(scoring.clamp(F.avg(own)), F.lit(0.5)), 6).alias("support"))


def analysis_totals(runs: DataFrame) -> DataFrame:
    """One row of all analyses (session_id, success, patterns, rules, analysed_at): sums, share of successes, the last session."""
    return runs.agg(
        F.count("*").alias("analysed"), F.sum("patterns").alias("patterns"), F.sum("rules").alias("rules"),
        F.round(F.coalesce(F.avg(F.col("success").cast("int")), F.lit(0.0)), 6).alias("success_rate"), F.max_by("session_id", F.struct("analysed_at", "session_id")).alias("last_session"),
    )


def version_totals(versions: DataFrame) -> DataFrame:
    """One row of all versions (rule_id, version, parent_version): rules, versions, their mean, rules with a rollback."""
    back = F.coalesce(F.col("parent_version") < F.col("version") - 1, F.lit(False))
    per = versions.groupBy("rule_id").agg(F.count("*").alias("n"), F.max(back.cast("int")).alias("back"))
    return per.agg(F.count("*").alias("rules"), F.sum("n").alias("versions"), F.round(F.coalesce(F.avg("n"), F.lit(0.0)), 6).alias("mean_versions"), F.coalesce(F.sum("back"), F.lit(0)).alias("rolled_back"))


def search_log(results: DataFrame) -> DataFrame:
    """Per query of a log (query, rank, relevance, priority): hits, the best and the mean relevance, hits by priority."""
    kinds = [F.count_if(F.col("priority") == p).alias(f"n_{p}") for p in scoring.PRIORITY_RANK]
    return results.groupBy("query").agg(F.count("*").alias("hits"), F.max("relevance").alias("top"), F.round(F.avg("relevance"), 6).alias("mean"), *kinds)


def promoted_by_scope(memories: DataFrame, scope: str) -> DataFrame:
    """Promoted memories by scope: how many, projects, mean confidence."""
    return memories.filter("state = 'promoted'").groupBy(scope).agg(F.count("*").alias("memories"), F.countDistinct("project").alias("projects"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def good_clusters(clusters: DataFrame, least: float = 0.7, occurrences: int = 2, per_session: bool = False) -> DataFrame:
    """Clusters of mean confidence and occurrences enough; per_session asks for as many in each of its sessions."""
    n = F.col("occurrences") / F.col("sessions") if per_session else F.col("occurrences")
    return clusters.filter((F.col("confidence") >= least) & (n >= occurrences))


def clusters_by_type(clusters: DataFrame) -> DataFrame:
    """Per pattern type and in total (null): clusters, occurrences, mean size and confidence."""
    return clusters.rollup("pattern_type").agg(F.count("*").alias("clusters"), F.sum("occurrences").alias("occurrences"), F.round(F.avg("occurrences"), 6).alias("mean_size"), F.round(F.avg("confidence"), 6).alias("mean_confidence"))


def cluster_contents(clusters: DataFrame, contents: DataFrame) -> DataFrame:
    """The contents of each cluster (cluster_id, content_ids) in the order of its list; those that are gone are left out."""
    return clusters.select("cluster_id", F.posexplode("content_ids").alias("place", "content_id")).join(contents, "content_id").select("cluster_id", "place", "content_id", "content")


# ---------------------------------------------------------------- decisions
def cluster_priority(kind: Column, confidence: Column, occurrences: Column, corrections_only: bool = False) -> Column:
    """Priority of a cluster's rule by type, then by confidence and occurrences (5, or 3 where only corrections may rise)."""
    sure = (confidence >= 0.8) & ((kind == "repeated-correction") & (occurrences >= 3) if corrections_only else occurrences >= 5)
    return F.when(kind == "security", "critical").when(kind.isin("anti-pattern", "performance"), "high").when(sure, "medium").otherwise("low")


# The words that make a memory one of security, performance, a fault, or a preference.
MEMORY_TYPES = [
    ("security", r"(?i)security|注入|injection|vulnerability|exploit|cve|xss|csrf|密码|哈希|认证|授权|权限|token|auth|安全|泄露|敏感"),
    ("performance", r"(?i)performance|性能|slow|optimize|优化|useMemo|useCallback|缓存|cache|瓶颈|耗时|延迟|加速|memory leak|内存泄露"),
    ("anti-pattern", r"(?i)bug|error|wrong|broken|fail|错误|问题|失败|异常|崩溃|报错|修复|死循环|空指针|race condition"),
]
STATED_PREFERENCE = r"(?i)^(always|never|must|should|prefer|recommend|避免|不要|必须|总是|统一|约定|建议)"
# Words of rules that come with a framework.
FRAMEWORK_WORDS = ["hooks", "useEffect", "useState", "useCallback", "useMemo", "Rules of Hooks", "循环里调用", "条件里调用", "reactive", "ref", "computed", "watch", "ngOnInit", "ngOnDestroy", "ChangeDetection"]


def memory_type(info_class: Column, content: Column) -> Column:
    """The type of pattern that a memory is of."""
    out = F.when(info_class == "preference", "preference")
    for kind, pattern in MEMORY_TYPES:
        out = out.when(content.rlike(pattern), kind)
    return out.when(info_class == "experience", "repeated-correction").when(F.trim(content).rlike(STATED_PREFERENCE), "preference").otherwise("repeated-correction")


def framework_rule(*texts: Column) -> Column:
    """Whether any of the texts names what a framework's own rules are about."""
    out = F.lit(False)
    for t in texts:
        for w in FRAMEWORK_WORDS:
            out = out | F.coalesce(F.lower(t).contains(w.lower()), F.lit(False))
    return out


def precision(good: Column, bad: Column) -> Column:
    return F.when(good + bad == 0, 0.5).otherwise(good / (good + bad))


def suggested_confidence(confidence: Column, good: Column, bad: Column) -> Column:
    """Confidence of a signal drawn towards its precision, wholly so from ten verdicts on."""
    weight = F.least(F.lit(1.0), (good + bad) / 10)
    return scoring.clamp(confidence * (1 - weight) + precision(good, bad) * weight, 0.1, 0.95)


def prune_candidate(confidence: Column, matches: Column, good: Column, bad: Column) -> Column:
    return (confidence < 0.2) & (matches >= 10) & (precision(good, bad) < 0.3)


def signature_weight(text_column: Column, words: Column, confidence: Column) -> Column:
    """Weight of a learned signature: the part of its words that a text holds, times its confidence and .3; null for none."""
    hit = F.size(F.filter(words, lambda w: F.lower(text_column).contains(w)))
    return F.when(hit > 0, hit / F.size(words) * confidence * 0.3)


def finalised(rules: DataFrame, active: DataFrame, least: float) -> DataFrame:
    """Rules with the reason to hold each back for review, else null: empty_scene, low_quality_score, orphaned_memory.

    rules: rule_id, tech, functional, business, quality, sources (memory ids); active: memory_id.
    """
    known = rules.select("rule_id", F.explode("sources").alias("memory_id")).join(active.select("memory_id").distinct(), "memory_id", "left_semi").select("rule_id").distinct().withColumn("_known", F.lit(True))
    bare = F.col("tech").isNull() & F.col("functional").isNull() & F.col("business").isNull()
    orphan = (F.size("sources") > 0) & F.col("_known").isNull()
    return rules.join(known, "rule_id", "left").select("rule_id", F.when(bare, "empty_scene").when(F.col("quality") < least, "low_quality_score").when(orphan, "orphaned_memory").alias("reason"))


def review_queue(added: DataFrame, decisions: DataFrame) -> DataFrame:
    """The queue after its decisions: rule_id, added_at, reason, status. A decision settles the first item of its rule; the last one stands.

    added: rule_id, added_at, reason; decisions: rule_id, decided_at, status.
    """
    first = F.row_number().over(Window.partitionBy("rule_id").orderBy("added_at", "reason"))
    last = decisions.groupBy("rule_id").agg(F.max_by("status", F.struct("decided_at", "status")).alias("_status"))
    joined = added.withColumn("_n", first).join(last, "rule_id", "left")
    return joined.select("rule_id", "added_at", "reason", F.when(F.col("_n") == 1, F.coalesce("_status", F.lit("pending"))).otherwise("pending").alias("status"))


def upserted(current: DataFrame, incoming: DataFrame, key: str, at: str) -> tuple[DataFrame, DataFrame]:
    """The table after an upsert, and the rows to append to its versions: each incoming row that is new or differs, numbered on from the last.

    current has `version`; of several incoming rows of a key the last by `at` counts.
    """
    columns = [c for c in current.columns if c not in (key, "version")]
    rank = F.row_number().over(Window.partitionBy(key).orderBy(F.desc(at), *(F.desc(c) for c in columns if c != at)))
    new = incoming.withColumn("_r", rank).filter("_r = 1").drop("_r")
    old = current.select(F.col(key), F.struct(*columns).alias("_old"), F.col("version").alias("_v"))
    both = new.select(F.col(key), F.struct(*columns).alias("_new")).join(old, key, "full")
    changed = F.col("_new").isNotNull() & ~F.col("_new").eqNullSafe(F.col("_old"))
    row = both.select(key, F.coalesce(F.when(changed, F.col("_new")), F.col("_old")).alias("_row"), (F.coalesce("_v", F.lit(0)) + changed.cast("int")).alias("version"), changed.alias("_changed"))
    table = row.select(key, *(F.col(f"_row.{c}").alias(c) for c in columns), "version", "_changed")
    return table.drop("_changed"), table.filter("_changed").drop("_changed")


def keywords_of(content: Column, stop: list[str], most: int = 20) -> Column:
    """Keywords of a text in order: names cut at their humps, without stop words, numbers and single characters."""
    cut = F.regexp_replace(F.regexp_replace(F.regexp_replace(content, r"([a-z\d])([A-Z])", "$1 $2"), r"([A-Z]+)([A-Z][a-z])", "$1 $2"), "_+", " ")
    parts = F.split(F.lower(cut), r"[^a-zA-Z0-9一-鿿㐀-䶿]+")
    return F.slice(F.array_distinct(F.filter(parts, lambda w: (F.length(w) >= 2) & ~w.isin(stop) & ~w.rlike(r"^\d+$"))), 1, most)


def orphan_action(state: Column, mode: str, listed: Column | None = None, dry_run: bool = False) -> Column:
    """What is done with a rule by its reference state: report lists, archive puts away the wholly orphaned, fix drops dead references of the others.

    listed: whether a rule is on the whitelist, which leaves it as it is (skip). A dry run only reports.
    """
    if mode == "report" or dry_run:
        return F.when(state.isin("fully_orphaned", "partially_orphaned"), "report").otherwise("keep")
    done = F.when(state == "fully_orphaned", "archive") if mode == "archive" else F.when(state == "partially_orphaned", "drop_references")
    skipped = F.when((state != "no_references") & (F.lit(False) if listed is None else listed), "skip")
    return F.coalesce(skipped, done, F.lit("keep"))


def cleaned_references(rules: DataFrame, memories: DataFrame, state: Column) -> DataFrame:
    """rule_id, sources of the rules (rule_id, sources, state by `state`) after fix: what is dead goes from the partially orphaned ones."""
    each = rules.filter(state == "partially_orphaned").select("rule_id", F.explode("sources").alias("memory_id"))
    live = each.join(memories.select("memory_id").distinct(), "memory_id", "left_semi").groupBy("rule_id").agg(F.array_sort(F.collect_set("memory_id")).alias("live"))
    return rules.join(live, "rule_id", "left").select("rule_id", F.coalesce("live", F.array_sort(F.array_distinct("sources"))).alias("sources"))




def lesson_scene(name: str) -> list[tuple[str, str]]:
    """The scene of a lesson's name, technology-function."""
    tech, _, functional = name.partition("-")
    return [("tech", tech), ("functional", functional)]

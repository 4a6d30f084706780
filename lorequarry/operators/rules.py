"""Rules: counters from feedback, weights of users, keyword boosts, merging, updates, gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scoring, text

# What feedback does to a rule's counters, and the weights of the places of a keyword.
COUNTERS = {"usage": ("recalled", "applied", "used"), "acceptance": ("accepted", "validated"), "correction": ("corrected", "ignored"), "contradiction": ("contradicted",)}
DEFAULT_WEIGHTS = {"frequency": 0.3, "time_span": 0.1, "behavior": 0.4, "validation": 0.2}


def counters(feedback: DataFrame) -> DataFrame:
    """Per rule: its counters and the state that its feedback leaves it in."""
    counts = [F.count_if(F.col("feedback_type").isin(*kinds)).alias(f"{name}_count") for name, kinds in COUNTERS.items()]
    found = feedback.groupBy("rule_id").agg(*counts, F.count_if(F.col("feedback_type") == "disabled").alias("_off"))
    state = F.when(F.col("_off") > 0, "disabled").when((F.col("contradiction_count") > 0) & (F.col("acceptance_count") == 0), "deprecated").when(F.col("acceptance_count") > 0, "active").otherwise("candidate")
    return found.select("rule_id", *(f"{n}_count" for n in COUNTERS), state.alias("state"))


def learned_weights(feedback: DataFrame, user: str) -> DataFrame:
    """Weights of each user after feedback: towards validation if it is mostly good, towards behaviour if mostly bad."""
    good = F.count_if((F.col("feedback_type") == "used") | (F.col("rating") >= 4))
    bad = F.count_if(F.col("feedback_type").isin("ignored", "corrected", "disabled"))
    votes = feedback.groupBy(user).agg(good.alias("good"), bad.alias("bad"))
    d = DEFAULT_WEIGHTS
    up, down = F.col("good") > F.col("bad"), F.col("bad") > F.col("good")
    raw = {
        "frequency": F.when(up, max(d["frequency"] - 0.02, 0.1)).otherwise(d["frequency"]),
        "time_span": F.when(down, max(d["time_span"] - 0.02, 0.05)).otherwise(d["time_span"]),
        "behavior": F.when(down, min(d["behavior"] + 0.05, 0.6)).otherwise(d["behavior"]),
        "validation": F.when(up, min(d["validation"] + 0.05, 0.5)).otherwise(d["validation"]),
    }
    total = sum(raw.values(), F.lit(0.0))
    return votes.select(user, *(F.round(c / total, 6).alias(n) for n, c in raw.items()))


def keyword_boost(rules: DataFrame, request: list[str], weights: dict[str, float], bonus: float = 0.2) -> DataFrame:
    """Per rule: idf times the weight of the best place of each requested keyword, over the request, 1 at most, with a bonus for several.

    Places are the keywords, the scene values and the description.
    """
    wanted = rules.sparkSession.createDataFrame([(w,) for w in sorted(set(request))], "wanted string")
    n = rules.agg(F.count("*").alias("n"))
    lists = rules.select("rule_id", "keywords", F.array("tech", "functional", "business").alias("scene"), F.lower("description").alias("d"))
    pairs = lists.crossJoin(F.broadcast(wanted))  # a stated request of a few words
    in_keywords = F.exists("keywords", lambda k: F.lower(k) == F.col("wanted"))
    in_scene = F.exists("scene", lambda k: F.lower(k) == F.col("wanted"))
    place = F.greatest(F.when(in_keywords, weights["keywords"]), F.when(in_scene, weights["scenes"]))
    found = pairs.select("rule_id", "wanted", F.coalesce(place, F.when(F.col("d").contains(F.col("wanted")), weights["description"])).alias("weight"), in_keywords.alias("has")).filter("weight IS NOT NULL")
    df = found.filter("has").groupBy("wanted").agg(F.count("*").alias("df"))
    scored = found.join(F.broadcast(df), "wanted", "left").crossJoin(F.broadcast(n))
    part = text.idf(F.col("n"), F.coalesce("df", F.lit(1))) * F.col("weight")
    total = scored.groupBy("rule_id").agg(F.sum(part).alias("s"), F.count("*").alias("matched"))
    multiple = F.when(F.col("matched") > 1, 1 + (F.col("matched") - 1) * bonus).otherwise(1.0)
    return total.select("rule_id", "matched", F.round(F.least(F.col("s") / len(set(request)), F.lit(1.0)) * multiple, 6).alias("boost"))


def needs_analysis(files: DataFrame, records: DataFrame) -> DataFrame:
    """session_id, reason, incremental of files (mtime, size) against the last records (success, mtime, size)."""
    r = records.select("session_id", F.col("success"), F.col("mtime").alias("_m"), F.col("size").alias("_s"))
    reason = F.when(F.col("success").isNull(), "never_analyzed").when(~F.col("success"), "previous_failed").when(F.col("mtime") > F.col("_m"), "file_updated").when(F.col("size") != F.col("_s"), "file_size_changed").otherwise("up_to_date")
    return files.join(r, "session_id", "left").select("session_id", reason.alias("reason"), reason.isin("file_updated", "file_size_changed").alias("incremental"))


def merged_groups(rules: DataFrame, group: list[str]) -> DataFrame:
    """Rules of equal group as one: all keywords, the mean confidence and .05, the smallest id."""
    words = F.array_sort(F.array_distinct(F.flatten(F.collect_set("keywords"))))
    return rules.groupBy(*group).agg(F.min("rule_id").alias("rule_id"), F.count("*").alias("members"), F.round(F.least(F.lit(1.0), F.avg("confidence") + 0.05), 6).alias("confidence"), F.array_join(words, " ").alias("keywords"))


def fan_out(feedback: DataFrame) -> DataFrame:
    """Each feedback event as the usage, memory and rule events that follow from it."""
    kind = F.col("feedback_type")
    usage = F.when(kind.isin("accepted", "validated"), "used").when(kind == "contradicted", "corrected").otherwise(kind)
    event = F.when(kind == "used", "applied").when(kind.isin("disabled", "ignored"), "rejected").otherwise(kind)
    targets = F.array(F.struct(F.lit("usage").alias("target"), usage.alias("kind")), F.struct(F.lit("memory").alias("target"), event.alias("kind")), F.struct(F.lit("rule").alias("target"), kind.alias("kind")))
    return feedback.select("event_id", "rule_id", F.explode(targets).alias("e")).select("event_id", "rule_id", "e.*")


def updated(rules: DataFrame, updates: DataFrame, columns: list[str]) -> DataFrame:
    """The rules with what the updates give for these columns; a null leaves the old value."""
    new = updates.select("rule_id", *(F.col(c).alias(f"_{c}") for c in columns))
    return rules.join(new, "rule_id", "left").select(*(F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in rules.columns))


def kept_recent(rows: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    return rows.filter(scoring.days_between(now, F.col(at)) <= days)


def scene_evidence(evidence: DataFrame, weights: dict[str, float]) -> DataFrame:
    """Scenes by the summed weight of their sources of evidence (scene, source), with the sources."""
    weight = F.lit(0.0)
    for name, w in weights.items():
        weight = F.when(F.col("source") == name, w).otherwise(weight)
    each = evidence.select("scene", "source").distinct()
    return each.groupBy("scene").agg(F.round(F.sum(weight), 6).alias("weight"), F.array_join(F.array_sort(F.collect_set("source")), ",").alias("sources"))


# Families of words that are taken as keywords of a rule's text.
KEYWORD_FAMILIES = [
    r"\b(react|vue|angular|typescript|javascript|python|java|go|rust)\b", r"\b(api|database|sql|nosql|redis|mongodb|postgresql)\b", r"\b(async|await|promise|callback|hook|memo|effect)\b",
    r"\b(performance|optimization|cache|memory|speed)\b", r"\b(security|auth|token|jwt|oauth|xss|csrf|injection)\b", r"\b(test|testing|unit|integration|e2e|mock)\b", r"\b(error|exception|validation|sanitize)\b",
]


# The scenes that a keyword stands for, where it isn't the scene itself.
TECH_SCENES = {w: w for w in ["react", "vue", "angular", "typescript", "javascript", "python", "java", "go", "rust", "express", "django", "flask"]} | {"node": "nodejs"}
FUNCTIONAL_SCENES = {
    "api": "api", "rest": "api", "graphql": "api", "database": "database", "sql": "database", "nosql": "database", "redis": "cache", "cache": "cache",
    "auth": "auth", "authentication": "auth", "authorization": "auth", "token": "auth", "jwt": "auth", "oauth": "auth", "test": "testing", "testing": "testing", "mock": "testing",
    "validation": "validation", "error": "error-handling", "exception": "error-handling", "performance": "performance", "optimization": "performance",
    "security": "security", "xss": "security", "csrf": "security", "injection": "security",
}


def _scenes(keywords: Column, table: dict[str, str]) -> Column:
    names = F.create_map(*(F.lit(x) for pair in table.items() for x in pair))
    return F.array_distinct(F.filter(F.transform(keywords, lambda k: F.try_element_at(names, F.lower(k))), lambda x: x.isNotNull()))


def optimised(rules: DataFrame, content: Column, least: int = 2) -> DataFrame:
    """Rules after a cleanup: rule_id, keywords (how many), inferred (scenes by the old keywords, where it had neither tech nor functional ones), confidence, changes.

    A rule of less than `least` keywords gets those of its text; confidence rises by .1 where it was below .7 and
    the rule has three keywords and a scene now.
    """
    found = F.slice(F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.lower(content), F.lit(p), F.lit(1)) for p in KEYWORD_FAMILIES)))), 1, 10)
    old = F.coalesce("keywords", F.array().cast("array<string>"))
    rows = rules.withColumn("_old", old).withColumn("_all", F.array_distinct(F.concat("_old", found)))
    more = (F.size("_old") < least) & (F.size("_all") > F.size("_old"))
    bare = F.col("tech").isNull() & F.col("functional").isNull()
    none = F.array().cast("array<string>")
    rows = rows.withColumns({"_words": F.when(more, F.col("_all")).otherwise(F.col("_old")), "_added": more})
    rows = rows.withColumns({"_tech": F.when(bare, _scenes(F.col("_old"), TECH_SCENES)).otherwise(none), "_functional": F.when(bare, _scenes(F.col("_old"), FUNCTIONAL_SCENES)).otherwise(none)})
    inferred = F.size("_tech") + F.size("_functional") > 0
    boost = (F.col("confidence") < 0.7) & (F.size("_words") >= 3) & (~bare | inferred)
    changes = F.array_compact(F.array(F.when(F.col("_added"), "keywords"), F.when(inferred, "scenes"), F.when(boost, "confidence")))
    return rows.select(
        "rule_id", F.size("_words").cast("long").alias("keywords"), F.array_join(F.concat(F.array_sort("_tech"), F.array_sort("_functional")), ",").alias("inferred"),
        F.when(boost, F.round(F.least(F.lit(1.0), F.col("confidence") + 0.1), 6)).otherwise(F.col("confidence")).alias("confidence"), F.array_join(changes, ",").alias("changes"),
    )

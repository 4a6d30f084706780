"""Queries: lists, filters, totals, decisions over the stores."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import classify, scenes, scoring, text
from ..operators import duplicates, joins, listing, memory, mining, search, stats
from ..sources import stores
from . import adapters as a
from . import queries_near

QUERIES, ORACLE_SQL = {}, {}

# ---------------------------------------------------------------- lists
QUERIES["rule_list"] = lambda s, d: listing.listed_rules(a.rules(s, d), "economy", "high", 0.5).select("rule_id", "confidence")
ORACLE_SQL["rule_list"] = f"WITH {a.RULES} SELECT rule_id, confidence FROM rules WHERE kind = 'economy' AND priority = 'high' AND confidence >= 0.5"
QUERIES["rule_by_name"] = lambda s, d: a.rules(s, d).filter(listing.same_text("tech", "brand#7")).select("rule_id", "tech")
ORACLE_SQL["rule_by_name"] = f"WITH {a.RULES} SELECT rule_id, tech FROM rules WHERE lower(tech) = 'brand#7'"
QUERIES["rule_listing"] = lambda s, d: listing.grouped_listing(a.rules(s, d), 0.4)
ORACLE_SQL["rule_listing"] = f"WITH {a.RULES} SELECT priority, kind, count(*) AS rules, arg_min(rule_id, (-confidence, rule_id)) AS best, round(avg(confidence), 6) AS mean_confidence FROM rules WHERE confidence >= 0.4 GROUP BY priority, kind"


def _words(s, d):
    words = a.table(s, d, "documents").select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("text"), "doc_id", "lang")
    return words.groupBy("text").agg(F.count("*").alias("matches"), F.min("lang").alias("language"), F.count_if(F.col("doc_id") % 3 == 0).alias("good"), F.count_if(F.col("doc_id") % 3 == 1).alias("bad")).select(
        F.col("text").alias("signal_id"), "text", "language", "matches", "good", "bad", F.round(F.length("text") / 20, 6).alias("confidence"), F.when(F.length("text") % 2 == 0, "correction").otherwise("preference").alias("pattern_type")
    )


WORDS = f"""wd AS (SELECT doc_id, lang, unnest(list_distinct({a.words_sql("text")})) AS text FROM documents),
    sg AS (SELECT text, text AS signal_id, count(*) AS matches, min(lang) AS language, count(*) FILTER (doc_id % 3 = 0) AS good, count(*) FILTER (doc_id % 3 = 1) AS bad, round(length(text) / 20.0::DOUBLE, 6) AS confidence,
        CASE WHEN length(text) % 2 = 0 THEN 'correction' ELSE 'preference' END AS pattern_type FROM wd GROUP BY text)"""
QUERIES["signal_list"] = lambda s, d: listing.listed_signals(_words(s, d), 30, language="en", pattern_type="correction").select("signal_id", "confidence", "matches")
ORACLE_SQL["signal_list"] = f"WITH {WORDS} SELECT signal_id, confidence, matches FROM sg WHERE language = 'en' AND pattern_type = 'correction' ORDER BY confidence DESC, signal_id LIMIT 30"
QUERIES["dictionary_stats"] = lambda s, d: stats.dictionary_stats(_words(s, d))
ORACLE_SQL["dictionary_stats"] = f"WITH {WORDS} SELECT pattern_type, count(*) AS signals, round(avg(confidence), 6) AS mean_confidence FROM sg GROUP BY ROLLUP (pattern_type)"
QUERIES["signal_precision"] = lambda s, d: _words(s, d).select("signal_id", F.round(listing.precision(F.col("good"), F.col("bad")), 6).alias("precision"), F.round(listing.suggested_confidence(F.col("confidence"), F.col("good"), F.col("bad")), 6).alias("suggested"), listing.prune_candidate(F.col("confidence"), F.col("matches"), F.col("good"), F.col("bad")).alias("prune"))
ORACLE_SQL["signal_precision"] = f"""
    WITH {WORDS}, p AS (SELECT *, CASE WHEN good + bad = 0 THEN 0.5 ELSE good / (good + bad)::DOUBLE END AS p, least(1.0, (good + bad) / 10.0::DOUBLE) AS w FROM sg)
    SELECT signal_id, round(p, 6)::DOUBLE AS precision, round(greatest(0.1, least(0.95, confidence * (1 - w) + p * w)), 6)::DOUBLE AS suggested, confidence < 0.2 AND matches >= 10 AND p < 0.3 AS prune FROM p"""
QUERIES["signal_sources"] = lambda s, d: _words(s, d).groupingSets([["pattern_type"], ["language"], []], "pattern_type", "language").agg(F.count("*").alias("signals"), F.round(F.avg("confidence"), 6).alias("mean_confidence"), F.sum("matches").alias("matches"))
ORACLE_SQL["signal_sources"] = f"WITH {WORDS} SELECT pattern_type, language, count(*) AS signals, round(avg(confidence), 6) AS mean_confidence, CAST(sum(matches) AS BIGINT) AS matches FROM sg GROUP BY GROUPING SETS ((pattern_type), (language), ())"
_ORGANISATION = lambda: F.when(F.floor(F.col("memory_id") / 20) % 4 == 0, "Acme").when(F.floor(F.col("memory_id") / 20) % 4 == 1, "other")
QUERIES["memory_namespace"] = lambda s, d: a.memories(s, d).withColumns({"organization": _ORGANISATION(), "project": F.when(F.col("memory_id") % 3 == 0, F.col("project"))}).filter(listing.in_namespace(project="src3", organization="acme", branch=None)).select("memory_id")
ORACLE_SQL["memory_namespace"] = f"WITH {a.MEMORIES} SELECT memory_id FROM memories WHERE (memory_id % 3 > 0 OR project = 'src3') AND memory_id // 20 % 4 <> 1"
QUERIES["memory_list"] = lambda s, d: listing.listed_memories(a.memories(s, d), 120, kind="procedural", info_class="preference", sensitive=classify.sensitive(F.col("content")), found=a.memories(s, d).filter(F.lower("content").contains("the")).select("memory_id")).select("memory_id", "confidence")
_SENSITIVE = " OR ".join("regexp_matches(coalesce(content, ''), '" + p.replace("'", "''") + "')" for p in classify.SENSITIVE)
ORACLE_SQL["memory_list"] = f"""WITH {a.MEMORIES} SELECT memory_id, confidence FROM memories WHERE status = 'active' AND kind = 'procedural' AND info_class = 'preference' AND contains(lower(content), 'the') AND NOT ({_SENSITIVE}) ORDER BY created_at DESC, memory_id LIMIT 120"""
QUERIES["memory_hidden"] = lambda s, d: listing.hidden(a.memories(s, d), classify.sensitive(F.col("content")))
ORACLE_SQL["memory_hidden"] = f"WITH {a.MEMORIES} SELECT count(*) FILTER (NOT ({_SENSITIVE})) AS shown, count(*) FILTER ({_SENSITIVE}) AS hidden FROM memories"
QUERIES["latest_versions"] = lambda s, d: listing.latest_rows(a.feedback(s, d).select("rule_id", "event_id", "feedback_type"), ["rule_id"], [F.desc("event_id")], 3).withColumn("rank", F.col("rank").cast("long"))
ORACLE_SQL["latest_versions"] = f"WITH {a.FEEDBACK}, r AS (SELECT rule_id, event_id, feedback_type, row_number() OVER (PARTITION BY rule_id ORDER BY event_id DESC) AS rank FROM feedback) SELECT * FROM r WHERE rank <= 3"
QUERIES["closest_rules"] = lambda s, d: listing.closest_rules(a.rules(s, d), F.round(((F.col("tech") == "Brand#7").cast("int") + (F.col("functional") == "ECONOMY").cast("int")) / 2 * 0.6 * F.col("confidence"), 6), 25)
ORACLE_SQL["closest_rules"] = f"WITH {a.RULES} SELECT rule_id, confidence, round(((tech = 'Brand#7')::INT + (functional = 'ECONOMY')::INT) / 2.0::DOUBLE * 0.6 * confidence, 6) AS relevance FROM rules ORDER BY relevance DESC, confidence DESC, rule_id LIMIT 25"
QUERIES["indexed_rules"] = lambda s, d: listing.indexed_rules(a.rules(s, d), [("tech", "brand#7"), ("functional", "Economy"), ("business", "size-2"), ("keyword", "Gear"), ("keyword", "red")], 60)
ORACLE_SQL["indexed_rules"] = f"""
    WITH {a.RULES}, s AS (SELECT rule_id, confidence, CASE WHEN lower(tech) = 'brand#7' THEN 0.4 ELSE 0 END::DOUBLE + CASE WHEN lower(functional) = 'economy' THEN 0.5 ELSE 0 END + CASE WHEN business = 'size-2' THEN 0.3 ELSE 0 END
        + CASE WHEN list_contains(keywords, 'gear') THEN 0.6 ELSE 0 END + CASE WHEN list_contains(keywords, 'red') THEN 0.6 ELSE 0 END AS s FROM rules)
    SELECT rule_id, round(s * (0.7 + confidence * 0.3), 6) AS relevance FROM s WHERE s > 0 AND confidence >= 0.3 ORDER BY relevance DESC, rule_id LIMIT 60"""
QUERIES["proactive_bundles"] = lambda s, d: listing.proactive_bundles(a.rules(s, d).withColumn("tech", F.when(F.col("rule_id") % 5 > 0, F.col("tech"))))
ORACLE_SQL["proactive_bundles"] = f"""
    WITH {a.RULES}, g AS (SELECT CASE WHEN rule_id % 5 > 0 THEN tech END AS t, count(*) AS rules FROM rules WHERE priority = 'high' AND confidence >= 0.6 GROUP BY 1)
    (SELECT t AS bundle, rules FROM g WHERE t IS NOT NULL ORDER BY rules DESC, t LIMIT 5) UNION ALL SELECT 'general', rules FROM g WHERE t IS NULL"""
QUERIES["representative_evidence"] = lambda s, d: listing.representative_evidence(a.table(s, d, "events").groupBy("event_type", "user_id").agg(F.count("*").alias("occurrences"), F.avg("value").alias("v")).select("event_type", F.col("user_id").alias("evidence_id"), "occurrences", F.round(F.least(F.lit(1.0), F.col("v") / 100), 6).alias("confidence")), "event_type", 5).select("event_type", "evidence_id", "score", F.col("rank").cast("long").alias("rank"))
ORACLE_SQL["representative_evidence"] = """
    WITH g AS (SELECT event_type, user_id AS evidence_id, round(round(least(1.0, avg(value) / 100), 6) * ln(1 + count(*)), 6) AS score FROM events GROUP BY 1, 2), r AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY score DESC, evidence_id) AS rank FROM g)
    SELECT event_type, evidence_id, score, rank FROM r WHERE rank <= 5"""
QUERIES["scene_lessons"] = lambda s, d: search.ranked_rules(a.rules(s, d), listing.lesson_scene("Brand#3-SMALL"), [], 20)
ORACLE_SQL["scene_lessons"] = f"""
    WITH {a.RULES}, s AS (SELECT rule_id, priority, confidence, round(((tech = 'Brand#3')::INT + (functional = 'SMALL')::INT) / 2.0::DOUBLE * 0.6 * confidence, 6) AS relevance FROM rules)
    SELECT * FROM s WHERE relevance > 0 ORDER BY {a.PRIORITY_RANK}, relevance DESC, confidence DESC, rule_id LIMIT 20"""
QUERIES["semantic_keywords"] = lambda s, d: mining.semantic_keywords(a.table(s, d, "benchmark"), "item_id", "text", 10).select("item_id", "word", F.round("score", 6).alias("score"), F.col("rank").cast("long").alias("rank"))
ORACLE_SQL["semantic_keywords"] = f"""
    WITH w AS (SELECT item_id, unnest({a.words_sql("text")}) AS word FROM benchmark), g AS (SELECT item_id, word, list_distinct(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) AS g FROM (SELECT DISTINCT * FROM w)),
    t AS (SELECT item_id, x, sum(1)::DOUBLE AS tf FROM (SELECT item_id, unnest(list_transform(range(1, length(word)), lambda i: substr(word, i, 2))) AS x FROM w) GROUP BY ALL), n AS (SELECT item_id, sqrt(sum(tf * tf)) AS n FROM t GROUP BY item_id),
    e AS (SELECT item_id, word, len(g) AS k, unnest(g) AS x FROM g WHERE len(g) > 0), c AS (SELECT e.item_id, word, round(sum(tf) / (sqrt(any_value(k)) * any_value(n)), 6) AS score FROM e JOIN t USING (item_id, x) JOIN n USING (item_id) GROUP BY e.item_id, word),
    r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, length(word) DESC, word) AS rank FROM c) SELECT * FROM r WHERE rank <= 10"""
QUERIES["text_keywords"] = lambda s, d: a.table(s, d, "documents").select("doc_id", F.array_join(listing.keywords_of(F.concat(F.col("text"), F.lit(" fooBarBaz some_name HTTPServer 42")), ["the", "and"]), " ").alias("keywords"))
ORACLE_SQL["text_keywords"] = """
    WITH x AS (SELECT doc_id, lower(regexp_replace(regexp_replace(regexp_replace(text || ' fooBarBaz some_name HTTPServer 42', '([a-z\\d])([A-Z])', '\\1 \\2', 'g'), '([A-Z]+)([A-Z][a-z])', '\\1 \\2', 'g'), '_+', ' ', 'g')) AS c FROM documents),
    p AS (SELECT doc_id, list_filter(string_split_regex(c, '[^a-zA-Z0-9一-鿿㐀-䶿]+'), lambda w: length(w) >= 2 AND w NOT IN ('the', 'and') AND NOT regexp_matches(w, '^\\d+$')) AS w FROM x),
    f AS (SELECT doc_id, w, list_filter(range(1, len(w) + 1), lambda i: list_position(w, w[i]) = i) AS i FROM p)
    SELECT doc_id, array_to_string(list_transform(i[1:20], lambda k: w[k]), ' ') AS keywords FROM f"""

# ---------------------------------------------------------------- totals
QUERIES["storage_health"] = lambda s, d: listing.storage_health(a.rules(s, d), a.rules(s, d).filter("rule_id % 50 <> 1").select(F.when(F.col("rule_id") % 97 == 0, -F.col("rule_id") - 1).otherwise(F.col("rule_id")).alias("rule_id"), F.explode("keywords").alias("segment")))
ORACLE_SQL["storage_health"] = f"""
    WITH {a.RULES}, s AS (SELECT CASE WHEN rule_id % 97 = 0 THEN -rule_id - 1 ELSE rule_id END AS rule_id, unnest(keywords) AS segment FROM rules WHERE rule_id % 50 <> 1)
    SELECT (SELECT count(*) FROM rules) AS rules, (SELECT count(DISTINCT rule_id) FROM rules) AS ids, (SELECT count(*) FILTER (status = 'active') FROM rules) AS active, (SELECT count(*) FROM s) AS segments, (SELECT count(DISTINCT segment) FROM s) AS distinct_segments,
        (SELECT count(*) FROM s WHERE rule_id NOT IN (SELECT rule_id FROM rules)) AS dangling, (SELECT count(*) FROM rules WHERE rule_id NOT IN (SELECT rule_id FROM s)) AS unindexed"""


def _patterns(s, d):
    occurrences = a.table(s, d, "events").select(F.col("user_id").alias("fingerprint"), F.floor(F.col("event_id") / 50).alias("session_id"), F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    return occurrences, mining.evolution(occurrences)


QUERIES["evolution_totals"] = lambda s, d: listing.evolution_totals((p := _patterns(s, d))[1], p[0], p[0].filter("event_type = 'purchase'"))
ORACLE_SQL["evolution_totals"] = """
    WITH g AS (SELECT user_id, count(*) AS n, count(DISTINCT event_id // 50) AS s, bool_or(event_type = 'purchase') AS f FROM events GROUP BY user_id)
    SELECT count(*) AS patterns, CAST(sum(n) AS BIGINT) AS occurrences, round(avg(n), 1) AS mean_occurrences, round(avg(s), 1) AS mean_sessions, (SELECT count(DISTINCT event_id // 50) FROM events) AS sessions, count(*) FILTER (f) AS with_feedback FROM g"""
QUERIES["evolution_filter"] = lambda s, d: _patterns(s, d)[1].filter(mining.evolved(least=5, sessions=3)).select("fingerprint", "sessions", "occurrences")
ORACLE_SQL["evolution_filter"] = "SELECT user_id AS fingerprint, count(DISTINCT event_id // 50) AS sessions, count(*) AS occurrences FROM events GROUP BY user_id HAVING count(*) >= 5 AND count(DISTINCT event_id // 50) >= 3"
QUERIES["evolution_daily"] = lambda s, d: mining.evolution_daily(_patterns(s, d)[0].withColumn("confidence", F.round(F.col("value") / 500, 6)))
ORACLE_SQL["evolution_daily"] = "SELECT user_id AS fingerprint, CAST(ts AS DATE) AS day, count(*) AS occurrences, max(round(value / 500, 6)) AS confidence FROM events GROUP BY 1, 2"
QUERIES["enhanced_confidence"] = lambda s, d: _patterns(s, d)[1].join(_patterns(s, d)[0].groupBy("fingerprint").agg(F.count_if(F.col("event_type").isin("click", "purchase")).alias("good"), F.count_if(F.col("event_type") == "error").alias("bad")), "fingerprint").select("fingerprint", F.round(listing.enhanced_confidence(F.lit(0.5), F.col("sessions"), scoring.days_between(F.col("last_seen"), F.col("first_seen")), F.col("good"), F.col("bad")), 6).alias("confidence"))
ORACLE_SQL["enhanced_confidence"] = """
    WITH g AS (SELECT user_id, count(DISTINCT event_id // 50) AS s, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS d, count(*) FILTER (event_type IN ('click', 'purchase')) AS good, count(*) FILTER (event_type = 'error') AS bad FROM events GROUP BY user_id)
    SELECT user_id AS fingerprint, round(greatest(0.0, least(1.0, 0.5 + least(s * 0.05::DOUBLE, 0.2) + least(d / 30 * 0.1, 0.1) + CASE WHEN good + bad > 0 THEN good / (good + bad)::DOUBLE * 0.15 - bad / (good + bad)::DOUBLE * 0.2 ELSE 0 END)), 6)::DOUBLE AS confidence FROM g"""
QUERIES["adaptive_confidence"] = lambda s, d: a.table(s, d, "events").groupBy("user_id").agg(F.count("*").alias("n"), F.countDistinct(F.floor(F.col("event_id") / 50)).alias("sessions"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.count_if(F.col("value") >= 10).alias("accepted"), F.count_if(F.col("value") >= 100).alias("validated")).select(
    "user_id", F.round(listing.adaptive_confidence(F.col("n"), F.col("sessions"), scoring.days_between(F.col("hi"), F.col("lo")), F.col("accepted"), F.col("validated"), {"frequency": F.lit(0.28), "time_span": F.lit(0.1), "behavior": F.lit(0.4), "validation": F.lit(0.22)}), 6).alias("confidence")
)
ORACLE_SQL["adaptive_confidence"] = """
    WITH g AS (SELECT user_id, count(*) AS n, count(DISTINCT event_id // 50) AS s, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE AS d, count(*) FILTER (value >= 10) AS a, count(*) FILTER (value >= 100) AS v FROM events GROUP BY user_id)
    SELECT user_id, round(least(1.0, least(1.0, n / 10.0::DOUBLE) + CASE WHEN s = 1 AND n >= 3 THEN 0.1 ELSE 0 END) * 0.28 + least(1.0, d / 90) * 0.1 + a / n::DOUBLE * 0.4 + CASE WHEN v > 0 THEN 0.22 ELSE 0 END, 6)::DOUBLE AS confidence FROM g"""
QUERIES["memory_support_variant"] = lambda s, d: listing.support_with_penalty(a.memories(s, d), "project")
ORACLE_SQL["memory_support_variant"] = f"""
    WITH {a.MEMORIES} SELECT project, round(greatest(0.0, least(1.0, avg(confidence * 0.3 + least(1.0, strength / 5) * 0.2 + importance * 0.1 + least(1.0, validations / 3.0::DOUBLE) * 0.25 + CASE outcome WHEN 'success' THEN 1.0 WHEN 'failed' THEN 0.0 ELSE 0.5 END * 0.15
        - least(1.0, contradictions / 2.0::DOUBLE) * 0.25))), 6)::DOUBLE AS support FROM memories GROUP BY project"""
QUERIES["analysis_totals"] = lambda s, d: listing.analysis_totals(a.table(s, d, "orders").select(F.col("o_orderkey").alias("session_id"), (F.col("o_orderstatus") == "F").alias("success"), (F.col("o_orderkey") % 7).alias("patterns"), (F.col("o_orderkey") % 3).alias("rules"), F.col("o_orderdate").alias("analysed_at")))
ORACLE_SQL["analysis_totals"] = "SELECT count(*) AS analysed, CAST(sum(o_orderkey % 7) AS BIGINT) AS patterns, CAST(sum(o_orderkey % 3) AS BIGINT) AS rules, round(avg((o_orderstatus = 'F')::INT), 6) AS success_rate, arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS last_session FROM orders"
QUERIES["version_totals"] = lambda s, d: listing.version_totals(a.feedback(s, d).withColumn("version", F.row_number().over(Window.partitionBy("rule_id").orderBy("event_id"))).select("rule_id", "version", F.when(F.col("feedback_type") == "validated", F.col("version") - 2).otherwise(F.col("version") - 1).alias("parent_version")))
ORACLE_SQL["version_totals"] = f"""
    WITH {a.FEEDBACK}, v AS (SELECT rule_id, row_number() OVER (PARTITION BY rule_id ORDER BY event_id) AS v, feedback_type FROM feedback), g AS (SELECT rule_id, count(*) AS n, bool_or(feedback_type = 'validated') AS b FROM v GROUP BY rule_id)
    SELECT count(*) AS rules, CAST(sum(n) AS BIGINT) AS versions, round(avg(n), 6) AS mean_versions, count(*) FILTER (b) AS rolled_back FROM g"""
QUERIES["search_log"] = lambda s, d: listing.search_log(a.rules(s, d).select(F.col("kind").alias("query"), F.round("confidence", 6).alias("relevance"), "priority"))
ORACLE_SQL["search_log"] = f"WITH {a.RULES} SELECT kind AS query, count(*) AS hits, max(round(confidence, 6)) AS top, round(avg(round(confidence, 6)), 6) AS mean, " + ", ".join(f"count(*) FILTER (priority = '{p}') AS n_{p}" for p in ("critical", "high", "medium", "low")) + " FROM rules GROUP BY kind"
QUERIES["promoted_by_scope"] = lambda s, d: listing.promoted_by_scope(a.memories(s, d), "kind")
ORACLE_SQL["promoted_by_scope"] = f"WITH {a.MEMORIES} SELECT kind, count(*) AS memories, count(DISTINCT project) AS projects, round(avg(confidence), 6) AS mean_confidence FROM memories WHERE state = 'promoted' GROUP BY kind"


def _records(s, d):
    return duplicates.labelled_records(c := queries_near._labelled(s, d), duplicates.labelled_clusters(c))


QUERIES["good_clusters"] = lambda s, d: listing.good_clusters(_records(s, d), 0.6).select("leader", "occurrences", "confidence", listing.cluster_priority(F.col("pattern_type"), F.col("confidence"), F.col("occurrences")).alias("priority"), listing.cluster_priority(F.when(F.col("pattern_type") == "correction", "repeated-correction").otherwise("preference"), F.col("confidence") + 0.3, F.col("occurrences"), True).alias("strict"))
ORACLE_SQL["good_clusters"] = f"""WITH RECURSIVE {queries_near.LABELLED} SELECT leader, occurrences, confidence, CASE WHEN pattern_type = 'security' THEN 'critical' WHEN pattern_type IN ('anti-pattern', 'performance') THEN 'high' WHEN confidence >= 0.8 AND occurrences >= 5 THEN 'medium' ELSE 'low' END AS priority,
    CASE WHEN pattern_type = 'correction' AND confidence + 0.3 >= 0.8 AND occurrences >= 3 THEN 'medium' ELSE 'low' END AS strict FROM lr WHERE confidence >= 0.6 AND occurrences >= 2"""
QUERIES["clusters_by_type"] = lambda s, d: listing.clusters_by_type(_records(s, d))
ORACLE_SQL["clusters_by_type"] = f"WITH RECURSIVE {queries_near.LABELLED} SELECT pattern_type, count(*) AS clusters, CAST(sum(occurrences) AS BIGINT) AS occurrences, round(avg(occurrences), 6) AS mean_size, round(avg(confidence), 6) AS mean_confidence FROM lr GROUP BY ROLLUP (pattern_type)"
QUERIES["cluster_contents"] = lambda s, d: listing.cluster_contents(a.table(s, d, "orders").select(F.col("o_orderkey").alias("cluster_id"), F.array(F.floor(F.col("o_orderkey") / 10).cast("long"), F.col("o_custkey"), F.floor(F.col("o_custkey") / 2).cast("long")).alias("content_ids")), a.table(s, d, "documents").select(F.col("doc_id").alias("content_id"), F.md5("text").alias("content"))).withColumn("place", F.col("place").cast("long"))
ORACLE_SQL["cluster_contents"] = """
    WITH l AS (SELECT o_orderkey AS cluster_id, unnest([o_orderkey // 10, o_custkey, o_custkey // 2]) AS content_id, unnest([0::BIGINT, 1, 2]) AS place FROM orders)
    SELECT cluster_id, place, content_id, md5(text) AS content FROM l JOIN documents ON doc_id = content_id"""

# ---------------------------------------------------------------- decisions
QUERIES["rule_finalisation"] = lambda s, d: listing.finalised(
    a.rules(s, d).join(a.links(s, d).groupBy("rule_id").agg(F.collect_set("memory_id").alias("sources")), "rule_id", "left").select("rule_id", F.when(F.col("rule_id") % 20 > 0, F.col("tech")).alias("tech"), F.when(F.col("rule_id") % 20 > 0, F.col("functional")).alias("functional"), F.lit(None).cast("string").alias("business"), F.col("confidence").alias("quality"), F.coalesce("sources", F.array().cast("array<long>")).alias("sources")),
    a.memories(s, d).filter("status = 'active'"), 0.2,
)
ORACLE_SQL["rule_finalisation"] = f"""
    WITH {a.RULES}, {a.MEMORIES}, {a.LINKS}, k AS (SELECT rule_id, count(*) AS n, count(m.memory_id) AS known FROM (SELECT DISTINCT rule_id, memory_id FROM links) l LEFT JOIN (SELECT memory_id FROM memories WHERE status = 'active') m USING (memory_id) GROUP BY rule_id)
    SELECT rule_id, CASE WHEN rule_id % 20 = 0 THEN 'empty_scene' WHEN confidence < 0.2 THEN 'low_quality_score' WHEN n > 0 AND known = 0 THEN 'orphaned_memory' END AS reason FROM rules LEFT JOIN k USING (rule_id)"""


def _queue(s, d):
    e = a.table(s, d, "events")
    return e.filter("event_type = 'error'").select(F.col("user_id").alias("rule_id"), F.col("event_id").alias("added_at"), F.lit("low").alias("reason")), e.filter("event_type = 'purchase'").select(F.col("user_id").alias("rule_id"), F.col("event_id").alias("decided_at"), F.when(F.col("value") > 20, "approved").otherwise("rejected").alias("status"))


QUERIES["review_queue"] = lambda s, d: listing.review_queue(*_queue(s, d))
ORACLE_SQL["review_queue"] = """
    WITH q AS (SELECT user_id AS rule_id, event_id AS added_at, 'low' AS reason, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events WHERE event_type = 'error'),
    c AS (SELECT user_id AS rule_id, arg_max(CASE WHEN value > 20 THEN 'approved' ELSE 'rejected' END, event_id) AS status FROM events WHERE event_type = 'purchase' GROUP BY user_id)
    SELECT rule_id, added_at, reason, CASE WHEN k = 1 THEN coalesce(status, 'pending') ELSE 'pending' END AS status FROM q LEFT JOIN c USING (rule_id)"""


def _upsert(s, d):
    now = a.rules(s, d).select("rule_id", "priority", "confidence", F.lit(0).cast("long").alias("at"), F.lit(1).alias("version")).filter("rule_id % 3 > 0")
    new = a.feedback(s, d).select("rule_id", F.when(F.col("feedback_type") == "corrected", "low").otherwise("high").alias("priority"), F.round(F.col("value") / 500, 6).alias("confidence"), F.col("event_id").alias("at"))
    return listing.upserted(now, new, "rule_id", "at")


QUERIES["memory_upsert"] = lambda s, d: _upsert(s, d)[0].withColumn("version", F.col("version").cast("long"))
_UPSERT = f"""{a.RULES}, {a.FEEDBACK}, ct AS (SELECT rule_id, priority, confidence, 0::BIGINT AS at FROM rules WHERE rule_id % 3 > 0),
    nw AS (SELECT rule_id, arg_max(CASE WHEN feedback_type = 'corrected' THEN 'low' ELSE 'high' END, event_id) AS priority, arg_max(round(value / 500, 6), event_id) AS confidence, max(event_id) AS at FROM feedback GROUP BY rule_id)"""
ORACLE_SQL["memory_upsert"] = f"WITH {_UPSERT} SELECT rule_id, coalesce(n.priority, c.priority) AS priority, coalesce(n.confidence, c.confidence) AS confidence, coalesce(n.at, c.at) AS at, (c.rule_id IS NOT NULL)::BIGINT + (n.rule_id IS NOT NULL)::BIGINT AS version FROM ct c FULL JOIN nw n USING (rule_id)"
QUERIES["memory_version_rows"] = lambda s, d: _upsert(s, d)[1].select("rule_id", "priority", F.col("version").cast("long").alias("version"))
ORACLE_SQL["memory_version_rows"] = f"WITH {_UPSERT} SELECT rule_id, n.priority, 1 + (c.rule_id IS NOT NULL)::BIGINT AS version FROM nw n LEFT JOIN ct c USING (rule_id)"
QUERIES["orphan_actions"] = lambda s, d: joins.typed_references(a.links(s, d).groupBy("rule_id").agg(F.collect_set("memory_id").alias("sources")), a.memories(s, d)).select("rule_id", *(listing.orphan_action(F.col("reference_state"), m, F.col("rule_id") % 4 == 0).alias(m) for m in ("report", "archive", "fix")), listing.orphan_action(F.col("reference_state"), "fix", dry_run=True).alias("dry"))
ORACLE_SQL["orphan_actions"] = f"""
    WITH {a.LINKS}, {a.MEMORIES}, g AS (SELECT rule_id, count(DISTINCT l.memory_id) AS n, count(DISTINCT m.memory_id) AS k FROM links l LEFT JOIN memories m USING (memory_id) GROUP BY rule_id), t AS (SELECT *, k = 0 AS f, k > 0 AND k < n AS p FROM g)
    SELECT rule_id, CASE WHEN f OR p THEN 'report' ELSE 'keep' END AS report, CASE WHEN rule_id % 4 = 0 THEN 'skip' WHEN f THEN 'archive' ELSE 'keep' END AS archive, CASE WHEN rule_id % 4 = 0 THEN 'skip' WHEN p THEN 'drop_references' ELSE 'keep' END AS fix, CASE WHEN f OR p THEN 'report' ELSE 'keep' END AS dry FROM t"""


def _cleaned(s, d):
    linked = a.links(s, d).groupBy("rule_id").agg(F.collect_set("memory_id").alias("sources"))
    rules = linked.join(joins.typed_references(linked, a.memories(s, d)), "rule_id")
    return listing.cleaned_references(rules, a.memories(s, d), F.col("reference_state")).select("rule_id", F.array_join("sources", ",").alias("sources"))


QUERIES["orphans_fixed"] = _cleaned
ORACLE_SQL["orphans_fixed"] = f"""
    WITH {a.LINKS}, {a.MEMORIES}, x AS (SELECT DISTINCT rule_id, l.memory_id, m.memory_id IS NOT NULL AS live FROM links l LEFT JOIN memories m USING (memory_id)),
    g AS (SELECT rule_id, bool_or(live) AS some_live, bool_and(live) AS all_live FROM x GROUP BY rule_id)
    SELECT rule_id, string_agg(CAST(memory_id AS VARCHAR), ',' ORDER BY memory_id) AS sources FROM x JOIN g USING (rule_id) WHERE live OR NOT some_live OR all_live GROUP BY rule_id"""
QUERIES["signature_weights"] = lambda s, d: a.table(s, d, "documents").select("doc_id", F.round(listing.signature_weight(F.col("text"), F.array(*map(F.lit, ("the", "ung", "eux", "ción"))), F.lit(0.8)), 6).alias("weight"))
ORACLE_SQL["signature_weights"] = "WITH h AS (SELECT doc_id, contains(lower(text), 'the')::INT + contains(lower(text), 'ung')::INT + contains(lower(text), 'eux')::INT + contains(lower(text), 'ción')::INT AS h FROM documents) SELECT doc_id, CASE WHEN h > 0 THEN round(h / 4.0::DOUBLE * 0.8 * 0.3, 6) END AS weight FROM h"
QUERIES["learned_signatures"] = lambda s, d: scenes.learned_signatures(a.rules(s, d).select(F.lower("content").alias("message")), {"ring": ["ring"], "bolt": ["bolt", "nut"], "gear": ["gear"]}, {"query": ["database", "query"], "safety": ["never", "avoid"]})
ORACLE_SQL["learned_signatures"] = f"""
    WITH {a.RULES}, t(tech, w) AS (VALUES ('ring', ['ring']), ('bolt', ['bolt', 'nut']), ('gear', ['gear'])), f(functional, w) AS (VALUES ('query', ['database', 'query']), ('safety', ['never', 'avoid'])),
    x AS (SELECT DISTINCT lower(content) AS m, count(*) AS n FROM rules GROUP BY 1)
    SELECT tech, functional, CAST(sum(n) AS BIGINT) AS commits FROM x, t, f WHERE len(list_filter(t.w, lambda v: contains(m, v))) > 0 AND len(list_filter(f.w, lambda v: contains(m, v))) > 0 GROUP BY tech, functional"""
QUERIES["topic_boosts"] = lambda s, d: a.rules(s, d).select("rule_id", F.round(queries_near.similarity.topic_boost(queries_near.similarity.topic_counts(text.words(F.col("content"))), F.array(*(F.lit(x) for x in (0, 2, 1, 0, 0)))), 6).alias("boost"))
ORACLE_SQL["topic_boosts"] = f"""
    WITH {a.RULES}, w AS (SELECT rule_id, list_distinct({a.words_sql("content")}) AS w FROM rules), c AS (SELECT rule_id, len(list_intersect(w, ['sql', 'query', 'database', '查询', '数据库', 'injection', '注入'])) AS q, len(list_intersect(w, ['component', '组件', 'jsx', 'tsx', 'react'])) AS k FROM w)
    SELECT rule_id, round(greatest(CASE WHEN q > 0 THEN least(q, 2) / greatest(q, 2)::DOUBLE ELSE 0 END, CASE WHEN k > 0 THEN 1 / k::DOUBLE ELSE 0 END), 6) AS boost FROM c"""
QUERIES["message_words"] = lambda s, d: a.messages(s, d).select("session_id", "line_number", F.array_join(queries_near.similarity.message_words(F.col("content")), " ").alias("words"))
_STOP = "[" + ", ".join(f"'{w}'" for w in "the a an and or but in on at to for of with by from up about into through is are was were be been being have has had do does did will would should could can may might must".split()) + "]"
ORACLE_SQL["message_words"] = f"WITH {a.MESSAGES} SELECT session_id, line_number, array_to_string(list_filter({a.words_sql('content')}, lambda w: length(w) >= 2 AND NOT list_contains({_STOP}, w) AND NOT regexp_matches(w, '^\\d+$') AND regexp_matches(w, '[a-zA-Z0-9一-鿿㐀-䶿]')), ' ') AS words FROM messages"
QUERIES["idf_formulas"] = lambda s, d: search.document_frequency(a.table(s, d, "documents"), "doc_id", "text").crossJoin(F.broadcast(a.table(s, d, "documents").agg(F.count("*").alias("n")))).select("term", *(F.round(text.idf(F.col("n"), F.col("df"), k), 6).alias(k) for k in ("smooth", "segment", "plain")))
ORACLE_SQL["idf_formulas"] = f"""
    WITH w AS (SELECT doc_id, unnest(list_distinct({a.words_sql("text")})) AS term FROM documents), d AS (SELECT term, count(*) AS df FROM w GROUP BY term), n AS (SELECT count(*) AS n FROM documents)
    SELECT term, round(ln((n + 1.0) / (df + 1)) + 1, 6) AS smooth, round(ln(n / (df + 1.0)), 6) AS segment, round(ln(n / df::DOUBLE), 6) AS plain FROM d, n"""
QUERIES["set_similarities"] = lambda s, d: a.rules(s, d).select("rule_id", *(F.round(f(F.array_except("keywords", F.array(F.lit("gear"), F.lit("red"))), F.array(F.lit("bolt"), F.lit("blue"), F.lit("ring"))), 6).alias(n) for n, f in (("jaccard", text.jaccard_or_equal), ("overlap", text.overlap))))
ORACLE_SQL["set_similarities"] = f"""
    WITH {a.RULES}, k AS (SELECT rule_id, list_filter(keywords, lambda w: w NOT IN ('gear', 'red')) AS k FROM rules), h AS (SELECT rule_id, len(list_distinct(k)) AS n, len(list_intersect(k, ['bolt', 'blue', 'ring'])) AS b FROM k)
    SELECT rule_id, round(b / (n + 3 - b)::DOUBLE, 6) AS jaccard, CASE WHEN n = 0 THEN 0.0 ELSE round(b / least(n, 3)::DOUBLE, 6) END AS overlap FROM h"""
QUERIES["representative_phrases"] = lambda s, d: a.table(s, d, "documents").select("doc_id", text.representative_phrase(F.trim(F.regexp_replace("text", r"\s+", " ")), 60).alias("phrase"))
ORACLE_SQL["representative_phrases"] = """
    WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g'), ' ') AS t FROM documents), s AS (SELECT *, regexp_extract(t, '^(.*?[.!?。！？])(\\s|$)', 1) AS s FROM t)
    SELECT doc_id, CASE WHEN s <> '' AND length(s) <= 60 THEN s WHEN length(t) <= 60 THEN t ELSE regexp_replace(left(t, 60), '\\s+\\S*$', '') || '...' END AS phrase FROM s"""
QUERIES["name_segments"] = lambda s, d: a.table(s, d, "documents").select("doc_id", F.concat(F.col("source"), F.lit("FooBar_baz-Qux "), F.col("text")).alias("t")).select("doc_id", F.array_join(text.name_segments(F.col("t")), "|").alias("segments"), F.array_join(text.index_segments(F.col("t")), "|").alias("indexed"))
ORACLE_SQL["name_segments"] = """
    WITH t AS (SELECT doc_id, source || 'FooBar_baz-Qux ' || text AS t FROM documents),
    n AS (SELECT doc_id, t, list_filter(list_transform(string_split_regex(regexp_replace(t, '([A-Z])', ' \\1', 'g'), '[_\\-\\s]+'), lambda w: lower(w)), lambda w: w <> '') AS s,
        list_filter(string_split_regex(lower(regexp_replace(t, '([a-z0-9])([A-Z])', '\\1 \\2', 'g')), '[^a-z0-9一-鿿]+'), lambda w: length(w) > 1) AS i FROM t)
    SELECT doc_id, array_to_string(s, '|') AS segments, array_to_string(list_transform(list_filter(range(1, len(i) + 1), lambda k: list_position(i, i[k]) = k), lambda k: i[k]), '|') AS indexed FROM n"""
QUERIES["keyword_messages"] = lambda s, d: mining.typed_messages(a.messages(s, d), {"correction": ["Thble", "der"], "performance": ["eux"], "security": ["ción", "ung"]}).select("session_id", "line_number", "pattern_type")
ORACLE_SQL["keyword_messages"] = f"""
    WITH {a.MESSAGES}, k(pattern_type, w) AS (VALUES ('correction', ['thble', 'der']), ('performance', ['eux']), ('security', ['ción', 'ung']))
    SELECT session_id, line_number, pattern_type FROM messages, k WHERE role = 'user' AND len(list_filter(w, lambda x: contains(lower(content), x))) > 0"""
QUERIES["json_repair"] = lambda s, d: a.table(s, d, "events").select("event_id", F.concat(F.when(F.col("event_id") % 3 == 0, "```json\n").otherwise("so: "), F.regexp_replace("props", '"', "'"), F.when(F.col("event_id") % 3 == 0, "\n```").otherwise("")).alias("t")).select("event_id", F.try_variant_get(stores.repaired_json(F.col("t")), "$.k", "long").alias("k"))
ORACLE_SQL["json_repair"] = "SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events"
QUERIES["json_recovered"] = lambda s, d: a.table(s, d, "events").groupBy("user_id").agg(F.array_sort(F.collect_list("props")).alias("p")).select("user_id", stores.recovered_array(F.concat(F.lit("["), F.array_join("p", ","), F.lit(',{"k": 1, "s": [2')) ).alias("t")).select("user_id", F.size(F.from_json("t", "array<struct<k long>>")).cast("long").alias("items"))
ORACLE_SQL["json_recovered"] = "SELECT user_id, count(props) AS items FROM events GROUP BY user_id"
QUERIES["scope_detection"] = lambda s, d: a.table(s, d, "customer").select("c_custkey", F.concat(F.element_at(F.array(*map(F.lit, ["/home/me/repos/", "C:\\work\\projects\\", "/tmp/", "git@github.com:"])), (F.col("c_custkey") % 4 + 1).cast("int")), F.lower("c_mktsegment"), F.lit("/app/x")).alias("p")).select("c_custkey", scenes.organisation(F.regexp_replace("p", r"\\", "/")).alias("organisation"))
ORACLE_SQL["scope_detection"] = "SELECT c_custkey, CASE WHEN c_custkey % 4 <> 2 THEN lower(c_mktsegment) END AS organisation FROM customer"
QUERIES["change_reasons"] = lambda s, d: a.rules(s, d).select("rule_id", scenes.change_reason(F.lit("use const"), F.concat(F.col("content"), F.when(F.col("rule_id") % 2 == 0, " await null").otherwise(" try"))).alias("reason"))
ORACLE_SQL["change_reasons"] = f"WITH {a.RULES} SELECT rule_id, array_to_string(list_filter([CASE WHEN contains(content, ': ') THEN 'adds a type' END, CASE WHEN rule_id % 2 = 1 THEN 'adds error handling' END, CASE WHEN rule_id % 2 = 0 THEN 'waits' END, CASE WHEN rule_id % 2 = 0 THEN 'checks for null' END], lambda x: x IS NOT NULL), '; ') AS reason FROM rules"
QUERIES["links_upserted"] = lambda s, d: memory.linked(a.links(s, d), a.links(s, d).filter("memory_id % 3 = 0").select("rule_id", "memory_id", F.lit(2).alias("weight"))).groupBy("weight").agg(F.count("*").alias("links"))
ORACLE_SQL["links_upserted"] = f"WITH {a.LINKS}, l AS (SELECT DISTINCT rule_id, memory_id FROM links) SELECT CASE WHEN memory_id % 3 = 0 THEN 2 ELSE 1 END AS weight, count(*) AS links FROM l GROUP BY 1"
QUERIES["links_by_end"] = lambda s, d: memory.links_of(a.links(s, d), "memory_id", a.memories(s, d).filter("state = 'promoted'").select("memory_id")).unionByName(memory.links_of(a.links(s, d), "rule_id", a.rules(s, d).filter("priority = 'critical'").select("rule_id"))).distinct()
ORACLE_SQL["links_by_end"] = f"WITH {a.LINKS}, {a.MEMORIES}, {a.RULES} SELECT DISTINCT rule_id, memory_id FROM links WHERE memory_id IN (SELECT memory_id FROM memories WHERE state = 'promoted') OR rule_id IN (SELECT rule_id FROM rules WHERE priority = 'critical')"

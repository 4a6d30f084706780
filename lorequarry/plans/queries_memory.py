"""Queries: joins, similarity, memory life, windows, vectors, clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scoring, text
from ..operators import automaton, joins, memory, mining, windows
from . import adapters as a

QUERIES, ORACLE_SQL = {}, {}

# ---------------------------------------------------------------- signals
QUERIES["signal_matches"] = lambda s, d: joins.dictionary_matches(a.messages(s, d), a.signals(s), ["session_id", "line_number"], "content")
MATCHES = f"""{a.MESSAGES}, {a.SIGNALS_SQL}, matches AS (
    SELECT session_id, line_number, signal_id, pattern_type, confidence,
           len(list_filter(range(1, length(content) - length(signals.text) + 2), lambda i: substr(lower(content), i, length(signals.text)) = signals.text)) AS hits
    FROM messages JOIN signals ON contains(lower(content), signals.text))"""
ORACLE_SQL["signal_matches"] = f"WITH {MATCHES} SELECT * FROM matches"
QUERIES["signal_occurrences"] = lambda s, d: automaton.occurrences(a.messages(s, d), a.signals(s).select("text", "signal_id"), ["session_id", "line_number"], "content")
ORACLE_SQL["signal_occurrences"] = f"""
    WITH {a.MESSAGES}, {a.SIGNALS_SQL}, p AS (
        SELECT session_id, line_number, content, signal_id, length(signals.text) AS n,
               unnest(list_filter(range(0, length(content)), lambda i: substr(lower(content), i + 1, length(signals.text)) = signals.text)) AS start
        FROM messages JOIN signals ON contains(lower(content), signals.text))
    SELECT session_id, line_number, signal_id, start,
           CASE WHEN start > 50 THEN '...' ELSE '' END || substr(content, greatest(start - 50, 0) + 1, least(start + n + 50, length(content)) - greatest(start - 50, 0))
           || CASE WHEN start + n + 50 < length(content) THEN '...' ELSE '' END AS context
    FROM p"""


def _vocabulary(s, d):
    """Every word of six letters or more of the messages, as a dictionary."""
    word = F.explode(F.regexp_extract_all(F.lower("content"), F.lit("([a-z]{6,})"), F.lit(1)))
    words = a.messages(s, d).select(word.alias("text")).distinct()
    return words.select("text", F.col("text").alias("word"))


# SQL would cut every text at every place for every length; tests hold this against a loop.
QUERIES["vocabulary_occurrences"] = lambda s, d: automaton.occurrences(a.table(s, d, "documents"), _vocabulary(s, d), ["doc_id"], "text", 10)
QUERIES["signal_scores"] = lambda s, d: joins.message_scores(QUERIES["signal_matches"](s, d), ["session_id", "line_number"])
ORACLE_SQL["signal_scores"] = f"""
    WITH {MATCHES}, occurrences AS (SELECT *, unnest(range(hits)) AS nth, sum(hits) OVER (PARTITION BY session_id, line_number) AS total FROM matches),
    w AS (SELECT session_id, line_number, pattern_type, round(sum(confidence * hits / total), 9) AS weight FROM occurrences GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY session_id, line_number ORDER BY weight DESC, pattern_type) AS k, sum(weight) OVER (PARTITION BY session_id, line_number) AS every FROM w)
    SELECT session_id, line_number, pattern_type, round(least(0.95::DOUBLE, every), 6) AS confidence FROM r WHERE k = 1"""
QUERIES["signal_distinct_join"] = lambda s, d: QUERIES["signal_matches"](s, d).select("session_id", "pattern_type").distinct()
ORACLE_SQL["signal_distinct_join"] = f"WITH {MATCHES} SELECT DISTINCT session_id, pattern_type FROM matches"
QUERIES["bayes_time_decay"] = lambda s, d: (
    a.table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last"), F.max_by("event_type", F.struct("ts", "event_id")).alias("kind"), F.avg("value").alias("m"))
    .select("user_id", (0.3 + F.col("user_id") % 7 / 10).alias("prior"), scoring.days_between(F.lit("2024-03-15").cast("timestamp"), F.col("last")).alias("days"),
            F.when(F.col("kind") == "purchase", "true_positive").when(F.col("kind") == "error", "false_positive").otherwise("uncertain").alias("outcome"), "m")
    .select("user_id", "outcome", F.round(scoring.outcome_update(F.col("prior"), F.col("outcome")), 6).alias("after_outcome"),
            F.round(scoring.cooccurrence_update(F.col("prior"), F.least(F.lit(1.0), F.col("m") / 50)), 6).alias("after_cooccurrence"),
            F.round(scoring.time_decay(F.col("prior"), F.col("days")), 6).alias("after_decay"))
)
ORACLE_SQL["bayes_time_decay"] = """
    WITH e AS (SELECT user_id, max(ts) AS last, arg_max(event_type, (ts, event_id)) AS kind, avg(value) AS m FROM events GROUP BY user_id),
    p AS (SELECT user_id, 0.3 + user_id % 7 / 10.0::DOUBLE AS prior, (epoch_us(TIMESTAMP '2024-03-15') - epoch_us(last)) / 86400000000.0::DOUBLE AS days, m,
          CASE kind WHEN 'purchase' THEN 'true_positive' WHEN 'error' THEN 'false_positive' ELSE 'uncertain' END AS outcome FROM e)
    SELECT user_id, outcome, round(greatest(0.1, least(0.95, prior * 0.9 + CASE outcome WHEN 'true_positive' THEN 0.9 WHEN 'false_positive' THEN 0.1 ELSE 0.5 END * 0.1)), 6)::DOUBLE AS after_outcome,
           round(greatest(0.1, least(0.95, prior * 0.95 + least(1.0, m / 50) * 0.05)), 6)::DOUBLE AS after_cooccurrence,
           round(CASE WHEN days < 30 THEN prior ELSE greatest(0.1, least(0.95, prior * exp(-0.01 * days))) END, 6)::DOUBLE AS after_decay FROM p"""

# ---------------------------------------------------------------- joins
QUERIES["near_tool_call_band"] = lambda s, d: joins.band_join(
    a.table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("m")), a.table(s, d, "lineitem").select("l_orderkey", F.col("l_linenumber").alias("t"), "l_suppkey"), "l_orderkey", "m", "t", 3
).groupBy("l_orderkey", "m").agg(F.min_by("l_suppkey", F.struct(F.abs(F.col("m") - F.col("t")), "t", "l_suppkey")).alias("nearest"), F.count("*").alias("near"))
ORACLE_SQL["near_tool_call_band"] = """
    SELECT x.l_orderkey, x.l_linenumber AS m, arg_min(y.l_suppkey, (abs(x.l_linenumber - y.l_linenumber), y.l_linenumber, y.l_suppkey)) AS nearest, count(*) AS near
    FROM lineitem x JOIN lineitem y ON x.l_orderkey = y.l_orderkey AND abs(x.l_linenumber - y.l_linenumber) < 3 GROUP BY x.l_orderkey, x.l_linenumber"""


def _nearest(s, d):
    e = a.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    left = e.filter("event_type = 'error'").select("user_id", F.col("event_id").alias("error_id"), F.col("ts").alias("lts"))
    return joins.nearest_before_or_after(left, e.filter("event_type = 'click'").select("user_id", F.col("event_id").alias("click_id"), F.col("ts").alias("rts")), "user_id", "error_id", "click_id", "lts", "rts")




def _edits(s, d):
    """Lines of orders as three kinds of events in a session, three lines apart: corrections, calls of tools, and what the calls gave."""
    row = a.table(s, d, "lineitem").select(F.col("l_orderkey").alias("session_id"), (F.col("l_linenumber") * 3).alias("line_number"), "l_partkey", "l_suppkey", "l_returnflag", F.col("l_quantity").cast("string").alias("content"))
    name = F.concat(F.lit("f"), (F.col("l_partkey") % 2).cast("string"), F.lit(".ts"))
    said = row.filter("l_returnflag = 'R'").select("session_id", "line_number", F.concat(F.lit("wrong in "), name).alias("context"))
    tool = F.element_at(F.array(*map(F.lit, ["Read", "Edit", "Write", "Read"])), (F.col("l_suppkey") % 4 + 1).cast("int"))
    call = F.concat(F.lit("c"), (F.col("l_suppkey") % 2).cast("string"))
    calls = row.select("session_id", "line_number", tool.alias("tool_name"), F.concat(F.lit("/src/"), name).alias("file_path"), call.alias("call_id"), "content")
    return said, calls, row.select("session_id", (F.col("line_number") + 1).alias("line_number"), F.concat(F.lit("c"), (F.col("l_partkey") % 2).cast("string")).alias("call_id"), "content")


QUERIES["correction_edits"] = lambda s, d: joins.edits_around(*_edits(s, d))
ORACLE_SQL["correction_edits"] = """
    WITH r AS (SELECT l_orderkey AS session_id, l_linenumber * 3 AS line_number, l_partkey, l_suppkey, l_returnflag, CAST(l_quantity AS VARCHAR) AS content, 'f' || (l_partkey % 2) || '.ts' AS name FROM lineitem),
    c AS (SELECT DISTINCT session_id, line_number, name AS file_name FROM r WHERE l_returnflag = 'R'),
    t AS (SELECT session_id, line_number, ['Read', 'Edit', 'Write', 'Read'][l_suppkey % 4 + 1] AS tool, '/src/' || name AS path, 'c' || (l_suppkey % 2) AS call_id, content FROM r),
    g AS (SELECT session_id, line_number + 1 AS line_number, 'c' || (l_partkey % 2) AS call_id, content FROM r),
    gave AS (SELECT t.session_id, t.line_number, t.call_id, t.path, arg_min(g.content, (g.line_number, g.content)) AS held FROM t JOIN g ON g.session_id = t.session_id AND g.call_id = t.call_id AND g.line_number > t.line_number AND g.line_number <= t.line_number + 5 WHERE tool = 'Read' GROUP BY ALL),
    b AS (SELECT c.*, arg_min(held, (-x.line_number, x.call_id, held)) AS before FROM c JOIN gave x ON x.session_id = c.session_id AND x.line_number BETWEEN c.line_number - 10 AND c.line_number - 1 AND contains(x.path, c.file_name) GROUP BY ALL),
    e AS (SELECT c.*, arg_min(t.content, (t.line_number, t.call_id, t.content)) AS after FROM c JOIN t ON t.session_id = c.session_id AND t.line_number BETWEEN c.line_number AND c.line_number + 9 AND contains(t.path, c.file_name) WHERE tool <> 'Read' GROUP BY ALL)
    SELECT c.session_id, c.line_number, c.file_name, before, after FROM c LEFT JOIN b USING (session_id, line_number, file_name) LEFT JOIN e USING (session_id, line_number, file_name)"""
QUERIES["nearest_event"] = _nearest
ORACLE_SQL["nearest_event"] = """
    WITH p AS (SELECT l.user_id, l.event_id AS error_id, r.event_id AS click_id, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS micros_away
        FROM events l JOIN events r ON l.user_id = r.user_id AND l.event_type = 'error' AND r.event_type = 'click'),
    k AS (SELECT *, row_number() OVER (PARTITION BY error_id ORDER BY micros_away, click_id) AS k FROM p)
    SELECT user_id, error_id, click_id, micros_away FROM k WHERE k = 1"""


QUERIES["levenshtein_topk"] = lambda s, d: (
    a.rules(s, d).select("description").distinct().withColumn("similarity", F.round(text.edit_similarity(F.col("description"), F.lit("red boltt")), 6)).orderBy(F.desc("similarity"), "description").limit(10)
)
ORACLE_SQL["levenshtein_topk"] = """SELECT DISTINCT p_name AS description, round((greatest(length(p_name), 9) - levenshtein(p_name, 'red boltt')) / greatest(length(p_name), 9)::DOUBLE, 6) AS similarity
    FROM part ORDER BY similarity DESC, description LIMIT 10"""
QUERIES["char_set_duplicates"] = lambda s, d: windows.repeats_previous(a.messages(s, d), "session_id", "line_number", lambda x, y: text.jaccard(text.characters(x), text.characters(y)))
ORACLE_SQL["char_set_duplicates"] = f"""
    WITH {a.MESSAGES}, b AS (SELECT session_id, line_number, list_distinct(list_filter(string_split(content, ''), lambda c: c <> '')) AS x,
        lag(list_distinct(list_filter(string_split(content, ''), lambda c: c <> ''))) OVER (PARTITION BY session_id ORDER BY line_number) AS y FROM messages)
    SELECT session_id, line_number, coalesce(round(CASE WHEN len(list_distinct(list_concat(x, y))) = 0 THEN 0 ELSE len(list_intersect(x, y)) / len(list_distinct(list_concat(x, y)))::DOUBLE END, 6), 0.0) AS similarity FROM b"""
QUERIES["prefix_segments"] = lambda s, d: joins.prefix_either_way(
    a.rules(s, d).select(F.explode("keywords").alias("segment")).distinct(), s.createDataFrame([("bo",), ("gearbox",), ("r",), ("widget",)], "wanted string")
)
ORACLE_SQL["prefix_segments"] = f"""WITH {a.RULES}, k AS (SELECT DISTINCT unnest(keywords) AS segment FROM rules), q(wanted) AS (VALUES ('bo'), ('gearbox'), ('r'), ('widget'))
    SELECT segment, wanted FROM k JOIN q ON starts_with(segment, wanted) OR starts_with(wanted, segment)"""
# ---------------------------------------------------------------- memory life
def _ageing(s, d):
    """Some memories contradict another, some have a date of their own, and some were recalled later than they were made."""
    i, later = F.col("memory_id"), lambda days: F.col("created_at") + F.make_dt_interval(F.lit(days))
    return a.memories(s, d).withColumns({"conflict_with": F.when(i % 23 == 0, "another"), "expires_at": F.when(i % 19 == 0, later(900)), "last_recalled_at": F.when(i % 2 == 0, later(300))})


QUERIES["memory_decay"] = lambda s, d: memory.decay(_ageing(s, d), a.now())
ORACLE_SQL["memory_decay"] = f"""
    WITH {a.MEMORIES}, x AS (SELECT memory_id, CASE WHEN status = 'archived' THEN NULL WHEN state = 'deprecated' THEN 'archived'
        WHEN memory_id % 23 = 0 THEN 'archived' WHEN coalesce(CASE WHEN memory_id % 19 = 0 THEN created_at + to_days(900) END, created_at + to_days(ttl_days)) < TIMESTAMP '{a.NOW}' THEN 'archived'
        WHEN info_class = 'experience' AND recalls < 1 AND epoch_us(TIMESTAMP '{a.NOW}') - epoch_us(CASE WHEN memory_id % 2 = 0 THEN created_at + to_days(300) ELSE created_at END) > 180 * 86400000000 THEN 'deprecated' END AS action FROM memories)
    SELECT * FROM x WHERE action IS NOT NULL"""


QUERIES["demoted_rules"] = lambda s, d: memory.dependent_rules(QUERIES["memory_decay"](s, d), a.links(s, d))
ORACLE_SQL["demoted_rules"] = f"WITH {a.LINKS}, gone AS ({ORACLE_SQL['memory_decay']}) SELECT DISTINCT rule_id FROM links WHERE memory_id IN (SELECT memory_id FROM gone)"
QUERIES["memory_support"] = lambda s, d: memory.rule_support(a.links(s, d), a.memories(s, d))
ORACLE_SQL["memory_support"] = f"""
    WITH {a.MEMORIES}, {a.LINKS}, v AS (SELECT memory_id, confidence * 0.30 + least(1.0, validations / 3.0::DOUBLE) * 0.15 + least(1.0, sessions / 3.0::DOUBLE) * 0.15 + least(1.0, strength / 5) * 0.10 + importance * 0.10
        + CASE outcome WHEN 'success' THEN 1.0 WHEN 'failed' THEN 0.0 ELSE 0.5 END * 0.10 + CASE WHEN state = 'promoted' THEN 0.05 ELSE 0 END AS s FROM memories)
    SELECT rule_id, round(CASE WHEN count(s) = 0 THEN 0.35 ELSE greatest(0.0, least(1.0, avg(s))) END + 1e-9, 6)::DOUBLE AS support FROM links LEFT JOIN v USING (memory_id) GROUP BY rule_id"""
QUERIES["memory_promotion"] = lambda s, d: memory.promotions(a.memories(s, d))
ORACLE_SQL["memory_promotion"] = f"""
    WITH {a.MEMORIES}, p AS (SELECT *, round(greatest(0.0, least(1.0, confidence * 0.55 + least(1.0, sessions / 3.0::DOUBLE) * 0.1 + 0.05 + least(1.0, validations / 3.0::DOUBLE) * 0.15 + least(1.0, strength / 5) * 0.1
        - least(1.0, contradictions / 2.0::DOUBLE) * 0.35)), 6)::DOUBLE AS score FROM memories WHERE status = 'active')
    SELECT memory_id, score, kind = 'procedural' AND info_class <> 'fact' AND contradictions = 0 AND score >= 0.65 AS eligible FROM p"""
QUERIES["fact_upgrade"] = lambda s, d: a.memories(s, d).filter("info_class = 'fact'").select(
    "memory_id", scoring.fact_upgrade(F.col("recalls") + F.col("memory_id") % 5, F.col("outcome") == "success", F.col("sessions"), F.lower("content").contains("the")).alias("u")
).select("memory_id", F.round("u.score", 6).alias("score"), F.col("u.passed").cast("long").alias("passed"), "u.upgrade")
ORACLE_SQL["fact_upgrade"] = f"""
    WITH {a.MEMORIES}, c AS (SELECT memory_id, (recalls + memory_id % 5 >= 3)::INT AS a, (outcome = 'success')::INT AS b, (sessions >= 2)::INT AS c, contains(lower(content), 'the')::INT AS d FROM memories WHERE info_class = 'fact')
    SELECT memory_id, round(a * 0.4 + b * 0.3 + c * 0.2 + d * 0.1, 6)::DOUBLE AS score, CAST(a + b + c + d AS BIGINT) AS passed, a + b + c + d >= 2 OR round(a * 0.4 + b * 0.3 + c * 0.2 + d * 0.1, 6) >= 0.5 AS upgrade FROM c"""
QUERIES["supersede_scd2"] = lambda s, d: memory.superseded(a.feedback(s, d).select("rule_id", "feedback_type", "event_id", "ts"), ["rule_id", "feedback_type"], "ts", "event_id").select("rule_id", "feedback_type", "event_id", F.unix_micros("valid_from").alias("valid_from"), F.unix_micros("valid_to").alias("valid_to"), "status")
ORACLE_SQL["supersede_scd2"] = f"""
    WITH {a.FEEDBACK}, v AS (SELECT *, lead(ts) OVER (PARTITION BY rule_id, feedback_type ORDER BY ts, event_id) AS nxt FROM feedback)
    SELECT rule_id, feedback_type, event_id, epoch_us(ts) AS valid_from, epoch_us(nxt) AS valid_to, CASE WHEN nxt IS NULL THEN 'active' ELSE 'superseded' END AS status FROM v"""
QUERIES["latest_per_id"] = lambda s, d: memory.latest(a.feedback(s, d).select("rule_id", "event_id", "feedback_type", "value"), ["rule_id"], [F.desc("event_id")])
ORACLE_SQL["latest_per_id"] = f"WITH {a.FEEDBACK}, r AS (SELECT *, row_number() OVER (PARTITION BY rule_id ORDER BY event_id DESC) AS k FROM feedback) SELECT rule_id, event_id, feedback_type, value FROM r WHERE k = 1"
QUERIES["version_diff"] = lambda s, d: memory.version_changes(a.feedback(s, d), "rule_id", "ts", "event_id", "feedback_type").withColumn("version", F.col("version").cast("long"))
ORACLE_SQL["version_diff"] = f"""WITH {a.FEEDBACK} SELECT rule_id, event_id, row_number() OVER w AS version, feedback_type AS content, lag(feedback_type) OVER w AS previous,
    feedback_type IS DISTINCT FROM lag(feedback_type) OVER w AS changed FROM feedback WINDOW w AS (PARTITION BY rule_id ORDER BY ts, event_id)"""
QUERIES["version_rollback"] = lambda s, d: memory.rolled_back(QUERIES["version_diff"](s, d).select("rule_id", "version", "content"), "rule_id", 1)
ORACLE_SQL["version_rollback"] = f"""WITH v AS ({ORACLE_SQL["version_diff"]}), n AS (SELECT rule_id, max(version) + 1 AS version FROM v GROUP BY rule_id)
    SELECT rule_id, version, content FROM v UNION ALL SELECT rule_id, n.version, v.content FROM n JOIN v USING (rule_id) WHERE v.version = 1"""
QUERIES["memory_strength"] = lambda s, d: memory.strengths(a.feedback(s, d), "rule_id", ["ts", "event_id"])
ORACLE_SQL["memory_strength"] = f"""
    WITH RECURSIVE {a.FEEDBACK}, o AS (SELECT rule_id, CASE WHEN feedback_type = 'corrected' THEN -0.5 ELSE 0.5 END::DOUBLE AS step, row_number() OVER (PARTITION BY rule_id ORDER BY ts, event_id) AS k FROM feedback),
    f AS (SELECT rule_id, k, greatest(0.0, 1.0 + step)::DOUBLE AS s FROM o WHERE k = 1 UNION ALL SELECT o.rule_id, o.k, greatest(0.0, f.s + o.step)::DOUBLE FROM f JOIN o ON o.rule_id = f.rule_id AND o.k = f.k + 1)
    SELECT rule_id, max(k) AS events, arg_max(s, k) AS strength FROM f GROUP BY rule_id"""
QUERIES["running_sessions"] = lambda s, d: windows.running_sessions(a.table(s, d, "events").select(F.col("user_id").alias("fingerprint"), F.floor(F.col("event_id") / 50).cast("long").alias("session_id"), F.to_date("ts").alias("day")), "fingerprint", "session_id", "day")
ORACLE_SQL["running_sessions"] = """
    WITH o AS (SELECT user_id AS fingerprint, event_id // 50 AS session_id, CAST(ts AS DATE) AS day FROM events), c AS (SELECT fingerprint, day, count(*) AS occurrences FROM o GROUP BY ALL)
    SELECT fingerprint, day, occurrences, (SELECT count(DISTINCT session_id) FROM o WHERE o.fingerprint = c.fingerprint AND o.day <= c.day) AS sessions_so_far FROM c"""
QUERIES["pattern_evolution"] = lambda s, d: mining.evolution(a.table(s, d, "events").select(F.col("user_id").alias("fingerprint"), F.floor(F.col("event_id") / 50).cast("long").alias("session_id"), F.col("ts").cast("timestamp").alias("ts"))).select("fingerprint", "sessions", "occurrences", "bonus")
ORACLE_SQL["pattern_evolution"] = """SELECT user_id AS fingerprint, count(DISTINCT event_id // 50) AS sessions, count(*) AS occurrences,
    round(least(0.2, count(DISTINCT event_id // 50) * 0.05::DOUBLE) + least(0.1, (epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0::DOUBLE / 300), 6) AS bonus FROM events GROUP BY 1"""
QUERIES["merged_patterns"] = lambda s, d: memory.merged(*(
    a.table(s, d, "events").filter(F.col("event_id") % 2 == k).groupBy(F.col("event_type").alias("type"), F.col("user_id").alias("description")).agg(F.count("*").alias("occurrences"), F.max("value").alias("confidence"), F.max("event_id").alias("last_seen")) for k in (0, 1)
))
ORACLE_SQL["merged_patterns"] = "SELECT event_type AS type, user_id AS description, count(*) AS occurrences, max(value) AS confidence, max(event_id) AS last_seen FROM events GROUP BY 1, 2"
QUERIES["profile_ema"] = lambda s, d: memory.profile_fold(a.table(s, d, "events").select("user_id", "event_id", F.array("value").alias("v")), "user_id", "event_id", "v").select("user_id", F.round("value", 6).alias("mean"))
ORACLE_SQL["profile_ema"] = """
    WITH r AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) - 1 AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, round(sum(value * power(0.9::DOUBLE, k) * CASE WHEN k = n - 1 THEN 1.0::DOUBLE ELSE 0.1 END), 6) AS mean FROM r GROUP BY user_id"""
QUERIES["scope_vote"] = lambda s, d: (
    a.table(s, d, "customer").select("c_custkey", *(F.element_at(F.array(*(F.lit(x) for x in ("global", "organization", "project", None))), (F.col("c_custkey") / k).cast("int") % 4 + 1).alias(n) for k, n in ((1, "p"), (4, "l"), (16, "h"))), ((F.col("c_custkey") % 10) / 10).alias("conf"))
    .select("c_custkey", scoring.scope_vote(F.col("p"), F.col("l"), F.col("h"), F.col("conf")).alias("v")).select("c_custkey", "v.scope", "v.confidence")
)
ORACLE_SQL["scope_vote"] = """
    WITH x AS (SELECT c_custkey, ['global', 'organization', 'project', NULL] AS s, c_custkey % 10 / 10.0::DOUBLE AS conf FROM customer),
    y AS (SELECT c_custkey, conf, s[CAST(c_custkey % 4 AS INT) + 1] AS p, s[CAST(c_custkey // 4 % 4 AS INT) + 1] AS l, s[CAST(c_custkey // 16 % 4 AS INT) + 1] AS h FROM x),
    w AS (SELECT *, 0.5::DOUBLE AS wp, CASE WHEN p IS NOT NULL AND p <> 'global' AND l = 'global' THEN 0.1::DOUBLE ELSE 0.3 END AS wl, CASE WHEN h = 'global' AND conf < 0.7 THEN 0.1::DOUBLE ELSE 0.2 END AS wh FROM y),
    v AS (SELECT *, round(CASE WHEN p = 'organization' THEN wp ELSE 0 END + CASE WHEN l = 'organization' THEN wl ELSE 0 END + CASE WHEN h = 'organization' THEN wh ELSE 0 END, 6) AS vo,
        round(CASE WHEN p = 'project' THEN wp ELSE 0 END + CASE WHEN l = 'project' THEN wl ELSE 0 END + CASE WHEN h = 'project' THEN wh ELSE 0 END, 6) AS vp,
        round(CASE WHEN p = 'global' THEN wp ELSE 0 END + CASE WHEN l = 'global' THEN wl ELSE 0 END + CASE WHEN h = 'global' THEN wh ELSE 0 END, 6) AS vg FROM w),
    m AS (SELECT *, greatest(vo, vp, vg) AS most FROM v), z AS (SELECT *, CASE WHEN vp = most THEN 'project' END AS isp, CASE WHEN vg = most THEN 'global' END AS isg FROM m)
    SELECT c_custkey, CASE WHEN most = 0 THEN 'project' WHEN vo = most THEN 'organization' WHEN p = isp OR p = isg THEN p WHEN l = isp OR l = isg THEN l ELSE h END AS scope, least(1.0, round(most / 0.8, 6))::DOUBLE AS confidence FROM z"""

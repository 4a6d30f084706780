"""Queries: the life of rules, gates, sessions."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import rule_text, scoring, text
from ..operators import joins, memory, rules, search, stats, windows
from . import adapters as a
from . import queries_near

QUERIES, ORACLE_SQL = {}, {}

def _bound(s, d):
    """Rules of organisations are bound to an organisation, some to a team, a repository and a branch too; some have no scope."""
    i = F.col("rule_id")
    return a.rules(s, d).withColumns({
        "scope": F.when(i % 8 > 0, F.col("scope")), "organization_id": F.when(i % 5 > 0, F.concat(F.lit("org"), (i % 2).cast("string"))), "team_id": F.when(i % 4 == 0, F.lit("team1")).when(i % 4 == 1, "team2"),
        "repository": F.when(i % 7 == 0, F.lit("repo")), "branch": F.when(i % 10 == 0, F.lit("main")),
    })


QUERIES["scope_bindings"] = lambda s, d: _bound(s, d).filter(search.in_scope_of(["project", "organization", "global"], "/srv/P3/app/", organization_id="org1", team_id="team1", repository="repo")).select("rule_id", "scope")
ORACLE_SQL["scope_bindings"] = f"""
    WITH {a.RULES}, b AS (SELECT rule_id, status, project_path, CASE WHEN rule_id % 8 > 0 THEN scope END AS scope, CASE WHEN rule_id % 5 > 0 THEN 'org' || rule_id % 2 END AS o, CASE rule_id % 4 WHEN 0 THEN 'team1' WHEN 1 THEN 'team2' END AS t, CASE WHEN rule_id % 10 = 0 THEN 'main' END AS br FROM rules)
    SELECT rule_id, scope FROM b WHERE status = 'active' AND CASE coalesce(scope, 'global') WHEN 'project' THEN project_path = '/srv/p3' WHEN 'organization' THEN coalesce(o, 'org1') = 'org1' AND coalesce(t, 'team1') = 'team1' AND br IS NULL ELSE true END"""
QUERIES["rule_texts_generic"] = lambda s, d: a.rules(s, d).select("rule_id", rule_text.family(F.col("content")).alias("family"), rule_text.whole_text(F.col("content"), F.col("kind"), F.array(F.col("project_path"), F.col("description")), F.array("description")).alias("content"))
_HAS = lambda words, column: "(" + " OR ".join(f"contains({column}, '{w}')" for w in words.split()) + ")"
ORACLE_SQL["rule_texts_generic"] = f"""
    WITH {a.RULES}, f AS (SELECT rule_id, content AS c, kind, description, project_path, left(string_split_regex(content, '[。，,;；]')[1], 200) AS one,
        CASE WHEN {_HAS("替换 replace 隐藏 hide expose 暴露 wrapper 封装", "lower(content)")} AND {_HAS("比较 compare 调用", "content")} THEN 'api' WHEN {_HAS("状态 state workflow 流程 transition 转移 status", "lower(content)")} THEN 'workflow'
            WHEN {_HAS("优化 optimize refactor 重构 拆分 split 模块化 modular", "lower(content)")} THEN CASE WHEN {_HAS("拆分 split 模块", "content")} THEN 'modules' ELSE 'speed' END
            WHEN {_HAS("setup 安装 config 配置 claude.md script 脚本", "lower(content)")} THEN CASE WHEN contains(lower(content), 'setup') OR contains(content, '脚本') THEN 'setup' ELSE 'configuration' END
            WHEN {_HAS("error 错误 exception 异常 fix 修复 bug", "lower(content)")} THEN 'errors' ELSE 'generic' END AS family FROM rules),
    v AS (SELECT *, coalesce(nullif(regexp_extract(one, '应该([一-龥]+)', 1), ''), nullif(regexp_extract(one, '需要([一-龥]+)', 1), ''), nullif(regexp_extract(one, '(?i)must ([\\w\\s]+)', 1), ''), nullif(regexp_extract(one, '(?i)should ([\\w\\s]+)', 1), ''),
        nullif(regexp_extract(one, '(?i)always ([\\w\\s]+)', 1), ''), nullif(regexp_extract(one, '(?i)never ([\\w\\s]+)', 1), '')) AS said FROM f)
    SELECT rule_id, family, CASE family WHEN 'workflow' THEN 'Change a state through its checked transition only, and give every lock a way to be released.' WHEN 'errors' THEN 'Read the whole message, find the cause, and mend that instead of what shows.'
            WHEN 'configuration' THEN 'Write down a change of the configuration with an example and the reason for it.' WHEN 'setup' THEN 'Put changes of a configuration into the setup, and let it run again without harm.'
            ELSE '**' || upper(left(kind, 1)) || substr(kind, 2) || ' Pattern**' || chr(10) || chr(10) || CASE WHEN said IS NOT NULL THEN 'Core principle: ' || string_split_regex(trim(said, ' '), '[\\s,，]')[1] ELSE left(one, 150) || CASE WHEN length(one) > 150 THEN '...' ELSE '' END END END
        || chr(10) || chr(10) || '**Applies to**: ' || regexp_extract(project_path, '([^/]*)$', 1) || CASE WHEN length(c) > 100 THEN chr(10) || chr(10) || '**Example context**: ' || left(c, 150) || '...' ELSE '' END
        || chr(10) || chr(10) || '**Original evidence**:' || chr(10) || '  1. "' || left(description, 200) || '"' AS content FROM v"""
QUERIES["scope_filter"] = lambda s, d: a.rules(s, d).filter(search.in_scope(["project", "organization"], "/srv/p3/app")).select("rule_id", "scope")
ORACLE_SQL["scope_filter"] = f"WITH {a.RULES} SELECT rule_id, scope FROM rules WHERE status = 'active' AND (scope = 'organization' OR scope = 'project' AND project_path = '/srv/p3')"

QUERIES["rollout_bucket"] = lambda s, d: a.table(s, d, "customer").select("c_custkey", text.fnv1a(F.concat(F.lit("rank:"), F.col("c_custkey").cast("string"))).alias("hash"), text.in_rollout("rank", F.col("c_custkey").cast("string"), 0.3).alias("chosen"))
ORACLE_SQL["rollout_bucket"] = """
    WITH h AS (SELECT c_custkey, list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split('rank:' || CAST(c_custkey AS VARCHAR), ''), lambda c: CAST(ascii(c) AS UBIGINT))),
        lambda x, y: (xor(x, y) * 16777619::UBIGINT) % 4294967296::UBIGINT) AS h FROM customer)
    SELECT c_custkey, CAST(h AS BIGINT) AS hash, h / 4294967295.0::DOUBLE < 0.3 AS chosen FROM h"""

QUERIES["rule_counters"] = lambda s, d: rules.counters(a.feedback(s, d))
ORACLE_SQL["rule_counters"] = f"""
    WITH {a.FEEDBACK}, c AS (SELECT rule_id, count(*) FILTER (feedback_type IN ('recalled', 'applied', 'used')) AS usage_count, count(*) FILTER (feedback_type IN ('accepted', 'validated')) AS acceptance_count,
        count(*) FILTER (feedback_type IN ('corrected', 'ignored')) AS correction_count, count(*) FILTER (feedback_type = 'contradicted') AS contradiction_count FROM feedback GROUP BY rule_id)
    SELECT *, CASE WHEN contradiction_count > 0 AND acceptance_count = 0 THEN 'deprecated' WHEN acceptance_count > 0 THEN 'active' ELSE 'candidate' END AS state FROM c"""

QUERIES["learned_weights"] = lambda s, d: rules.learned_weights(a.feedback(s, d), "rule_id")
ORACLE_SQL["learned_weights"] = f"""
    WITH {a.FEEDBACK}, v AS (SELECT rule_id, count(*) FILTER (feedback_type = 'used' OR rating >= 4) AS good, count(*) FILTER (feedback_type IN ('ignored', 'corrected')) AS bad FROM feedback GROUP BY rule_id),
    w AS (SELECT rule_id, CASE WHEN good > bad THEN 0.28 ELSE 0.3 END::DOUBLE AS f, CASE WHEN bad > good THEN 0.08 ELSE 0.1 END::DOUBLE AS t,
        CASE WHEN bad > good THEN 0.45 ELSE 0.4 END::DOUBLE AS b, CASE WHEN good > bad THEN 0.25 ELSE 0.2 END::DOUBLE AS x FROM v)
    SELECT rule_id, round(f / (f + t + b + x), 6) AS frequency, round(t / (f + t + b + x), 6) AS time_span, round(b / (f + t + b + x), 6) AS behavior, round(x / (f + t + b + x), 6) AS validation FROM w"""

QUERIES["keyword_boost"] = lambda s, d: rules.keyword_boost(a.rules(s, d), ["red", "bolt", "economy", "wid"], {"keywords": 0.8, "scenes": 0.6, "description": 0.4})
ORACLE_SQL["keyword_boost"] = f"""
    WITH {a.RULES}, q(w) AS (VALUES ('red'), ('bolt'), ('economy'), ('wid')),
    p AS (SELECT rule_id, w, list_contains(list_transform(keywords, lambda k: lower(k)), w) AS k, w IN (lower(tech), lower(functional), lower(business)) AS s, contains(lower(description), w) AS d FROM rules, q),
    f AS (SELECT rule_id, w, k, CASE WHEN k THEN 0.8::DOUBLE WHEN s THEN 0.6 ELSE 0.4 END AS weight FROM p WHERE k OR s OR d),
    df AS (SELECT w, count(*) AS df FROM f WHERE k GROUP BY w), n AS (SELECT count(*) AS n FROM rules),
    g AS (SELECT rule_id, count(*) AS matched, sum((ln((n + 1.0) / (coalesce(df, 1) + 1)) + 1) * weight) AS s FROM f LEFT JOIN df USING (w), n GROUP BY rule_id)
    SELECT rule_id, matched, round(least(s / 4, 1.0) * CASE WHEN matched > 1 THEN 1 + (matched - 1) * 0.2::DOUBLE ELSE 1 END, 6) AS boost FROM g"""


def _files(s, d):
    e = a.table(s, d, "events").groupBy((F.col("user_id") % 120).alias("session_id")).agg(F.max("event_id").alias("mtime"), F.count("*").alias("size"))
    old = a.table(s, d, "events").filter("event_id % 10 < 9").groupBy((F.col("user_id") % 120).alias("session_id")).agg(F.max("event_id").alias("mtime"), (F.count("*") + F.max("event_id") % 2).alias("size"))
    return e, old.filter("session_id % 4 <> 0").select("session_id", (F.col("session_id") % 5 != 1).alias("success"), "mtime", "size")


QUERIES["needs_analysis"] = lambda s, d: rules.needs_analysis(*_files(s, d))
ORACLE_SQL["needs_analysis"] = """
    WITH f AS (SELECT user_id % 120 AS session_id, max(event_id) AS mtime, count(*) AS size FROM events GROUP BY 1),
    o AS (SELECT user_id % 120 AS session_id, max(event_id) AS m, count(*) + max(event_id) % 2 AS s FROM events WHERE event_id % 10 < 9 GROUP BY 1 HAVING user_id % 120 % 4 <> 0),
    r AS (SELECT session_id, CASE WHEN o.session_id IS NULL THEN 'never_analyzed' WHEN session_id % 5 = 1 THEN 'previous_failed' WHEN mtime > m THEN 'file_updated' WHEN size <> s THEN 'file_size_changed' ELSE 'up_to_date' END AS reason FROM f LEFT JOIN o USING (session_id))
    SELECT session_id, reason, reason IN ('file_updated', 'file_size_changed') AS incremental FROM r"""

QUERIES["merged_rules"] = lambda s, d: rules.merged_groups(a.rules(s, d), ["kind", "tech", "business"])
ORACLE_SQL["merged_rules"] = f"""
    WITH {a.RULES} SELECT kind, tech, business, min(rule_id) AS rule_id, count(*) AS members, round(least(1.0, avg(confidence) + 0.05), 6) AS confidence,
        array_to_string(list_sort(list_distinct(flatten(list(keywords)))), ' ') AS keywords FROM rules GROUP BY ALL"""

QUERIES["feedback_fan_out"] = lambda s, d: rules.fan_out(a.feedback(s, d)).groupBy("rule_id", "target", "kind").agg(F.count("*").alias("n"))
ORACLE_SQL["feedback_fan_out"] = f"""
    WITH {a.FEEDBACK}, x AS (SELECT rule_id, 'usage' AS target, CASE WHEN feedback_type IN ('accepted', 'validated') THEN 'used' WHEN feedback_type = 'contradicted' THEN 'corrected' ELSE feedback_type END AS kind FROM feedback
        UNION ALL SELECT rule_id, 'memory', CASE WHEN feedback_type = 'used' THEN 'applied' WHEN feedback_type IN ('disabled', 'ignored') THEN 'rejected' ELSE feedback_type END FROM feedback
        UNION ALL SELECT rule_id, 'rule', feedback_type FROM feedback)
    SELECT rule_id, target, kind, count(*) AS n FROM x GROUP BY ALL"""

QUERIES["rule_updates"] = lambda s, d: rules.updated(a.rules(s, d).select("rule_id", "priority", "confidence"), a.feedback(s, d).groupBy("rule_id").agg(F.max(F.when(F.col("feedback_type") == "corrected", "low")).alias("priority"), F.round(F.avg("value") / 500, 6).alias("confidence")), ["priority", "confidence"])
ORACLE_SQL["rule_updates"] = f"""
    WITH {a.RULES}, {a.FEEDBACK}, u AS (SELECT rule_id, max(CASE WHEN feedback_type = 'corrected' THEN 'low' END) AS p, round(avg(value) / 500, 6) AS c FROM feedback GROUP BY rule_id)
    SELECT rule_id, coalesce(p, priority) AS priority, coalesce(c, confidence) AS confidence FROM rules LEFT JOIN u USING (rule_id)"""

QUERIES["pruned_patterns"] = lambda s, d: rules.kept_recent(a.table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last_seen")), "last_seen", F.lit("2024-06-29").cast("timestamp"), 151).select("user_id")
ORACLE_SQL["pruned_patterns"] = "SELECT user_id FROM events GROUP BY user_id HAVING epoch_us(TIMESTAMP '2024-06-29') - epoch_us(max(ts)) <= 151 * 86400000000"

QUERIES["temporal_decay"] = lambda s, d: a.table(s, d, "events").groupBy("user_id").agg(F.max("ts").alias("last")).select("user_id", F.round(scoring.staleness(scoring.days_between(F.lit("2024-06-01").cast("timestamp"), F.col("last"))), 6).alias("factor"))
ORACLE_SQL["temporal_decay"] = """WITH x AS (SELECT user_id, (epoch_us(TIMESTAMP '2024-06-01') - epoch_us(max(ts))) / 86400000000.0::DOUBLE AS days FROM events GROUP BY user_id)
    SELECT user_id, round(CASE WHEN days < 90 THEN 1.0 ELSE greatest(0.5, 1 - (days - 90) / 90 * 0.5) END, 6)::DOUBLE AS factor FROM x"""

QUERIES["rule_priority"] = lambda s, d: a.rules(s, d).select("rule_id", scoring.rule_priority(F.when(F.col("kind") == "economy", "security").when(F.col("kind") == "small", "anti-pattern").when(F.col("kind") == "promo", "performance").otherwise("preference"), F.col("confidence")).alias("priority"))
ORACLE_SQL["rule_priority"] = f"""
    WITH {a.RULES}, x AS (SELECT rule_id, greatest(0, CASE kind WHEN 'economy' THEN 0 WHEN 'small' THEN 1 WHEN 'promo' THEN 2 ELSE 3 END - CASE WHEN confidence >= 0.9 THEN 1 ELSE 0 END) AS r FROM rules)
    SELECT rule_id, ['critical', 'high', 'medium', 'low'][r + 1] AS priority FROM x"""

QUERIES["qualified_patterns"] = lambda s, d: a.table(s, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.round(F.avg("value") / 100, 6).alias("c")).select("user_id", "event_type", scoring.qualifies(F.when(F.col("event_type") == "error", "repeated-correction").when(F.col("event_type") == "view", "security").otherwise("preference"), F.col("c"), F.col("n"), 0.6, F.when(F.col("user_id") % 2 == 0, 0.85).otherwise(1.0)).alias("qualified"))
ORACLE_SQL["qualified_patterns"] = """
    WITH g AS (SELECT user_id, event_type, count(*) AS n, round(avg(value) / 100, 6) AS c, CASE event_type WHEN 'error' THEN 'repeated-correction' WHEN 'view' THEN 'security' ELSE 'preference' END AS k FROM events GROUP BY ALL)
    SELECT user_id, event_type, c * CASE WHEN user_id % 2 = 0 THEN 0.85 ELSE 1.0 END >= 0.6 OR k = 'repeated-correction' AND c >= 0.45 AND n >= 2 OR k = 'security' AND c >= 0.5 AND n >= 1 OR k = 'preference' AND c >= 0.3 AND n >= 1 AS qualified FROM g"""

QUERIES["scene_evidence"] = lambda s, d: rules.scene_evidence(
    a.rules(s, d).select(F.col("tech").alias("scene"), F.when(F.col("rule_id") % 5 == 0, "dependencies").when(F.col("rule_id") % 5 == 1, "paths").when(F.col("confidence") > 0.9, "input").otherwise("remote").alias("source")),
    {"dependencies": 0.4, "paths": 0.3, "input": 0.5, "remote": 0.2},
)
ORACLE_SQL["scene_evidence"] = f"""
    WITH {a.RULES}, e AS (SELECT DISTINCT tech AS scene, CASE WHEN rule_id % 5 = 0 THEN 'dependencies' WHEN rule_id % 5 = 1 THEN 'paths' WHEN confidence > 0.9 THEN 'input' ELSE 'remote' END AS source FROM rules)
    SELECT scene, round(sum(CASE source WHEN 'dependencies' THEN 0.4 WHEN 'paths' THEN 0.3 WHEN 'input' THEN 0.5 ELSE 0.2 END::DOUBLE), 6) AS weight, array_to_string(list_sort(list(source)), ',') AS sources FROM e GROUP BY scene"""

QUERIES["first_wins"] = lambda s, d: windows.first_wins(a.rules(s, d).select("description", "kind", "rule_id"), ["description", "kind"], ["rule_id"])
ORACLE_SQL["first_wins"] = f"WITH {a.RULES} SELECT description, kind, min(rule_id) AS rule_id FROM rules GROUP BY description, kind"

QUERIES["last_occurrence"] = lambda s, d: windows.last_path(a.table(s, d, "events").select("user_id", "event_id", F.when(F.col("event_type") == "click", F.col("props")).alias("path")), "user_id", "event_id", "path").select("user_id", "event_id", "last_path")
ORACLE_SQL["last_occurrence"] = """SELECT user_id, event_id, last_value(CASE WHEN event_type = 'click' THEN props END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 10 PRECEDING AND 1 PRECEDING) AS last_path FROM events"""

QUERIES["path_similarity"] = lambda s, d: a.table(s, d, "pages").select("page_id", text.path_similarity(F.regexp_replace("url", r"^https?://|\?.*$", ""), F.lit("ththre.example.com/fr/1")).alias("similarity"))
ORACLE_SQL["path_similarity"] = """
    WITH p AS (SELECT page_id, regexp_replace(url, '^https?://|\\?.*$', '', 'g') AS u FROM pages), x AS (SELECT *, string_split(u, '/') AS s FROM p)
    SELECT page_id, CASE WHEN u = '' THEN 0.5 WHEN u = 'ththre.example.com/fr/1' THEN 1.0 WHEN s[:len(s) - 1] = ['ththre.example.com', 'fr'] THEN 0.8
        WHEN len(s) > 2 AND s[:len(s) - 2] = ['ththre.example.com'] THEN 0.6 WHEN s[1] = 'ththre.example.com' THEN 0.4 ELSE 0.0 END::DOUBLE AS similarity FROM x"""

QUERIES["content_hashes"] = lambda s, d: a.table(s, d, "pages").select("page_id", text.content_hash(F.col("html")).alias("hash"))
ORACLE_SQL["content_hashes"] = "SELECT page_id, 'sha256:' || sha256(html) AS hash FROM pages"


def _retrieval(s, d):
    ranked = queries_near._related(s, d)
    return stats.retrieval_metrics(ranked.select(F.col("query_id").alias("query"), "rank", (F.col("row_id") % 3 == 0).alias("relevant"), F.lit(3).alias("expected"), (F.col("row_id") % 7 == 0).alias("foreign")))


QUERIES["retrieval_metrics"] = _retrieval
ORACLE_SQL["retrieval_metrics"] = f"""
    WITH z AS ({queries_near.RELATED}), r AS (SELECT query_id, rank, row_id % 3 = 0 AS rel, row_id % 7 = 0 AS other FROM z),
    g AS (SELECT query_id, max(CASE WHEN rank = 1 AND rel THEN 1.0::DOUBLE ELSE 0 END) AS r1, count(*) FILTER (rank <= 5 AND rel) / 3.0::DOUBLE AS r5, max(CASE WHEN rel THEN 1.0::DOUBLE / rank ELSE 0 END) AS rr, count(*) FILTER (rank <= 5 AND rel) / 5.0::DOUBLE AS p5, bool_or(other) AS leak FROM r GROUP BY query_id)
    SELECT round(avg(r1), 6) AS recall_at_1, round(avg(r5), 6) AS recall_at_5, round(avg(rr), 6) AS mrr, round(avg(p5), 6) AS precision_at_5, round(1 - avg(leak::INT), 6) AS isolation FROM g"""

QUERIES["session_stats"] = lambda s, d: a.messages(s, d).groupBy("session_id").agg(*(F.count_if(F.col("role") == r).alias(f"n_{r}") for r in ("user", "assistant", "system")), (F.max("line_number") - F.min("line_number")).alias("span"))
ORACLE_SQL["session_stats"] = f"WITH {a.MESSAGES} SELECT session_id, count(*) FILTER (role = 'user') AS n_user, count(*) FILTER (role = 'assistant') AS n_assistant, count(*) FILTER (role = 'system') AS n_system, max(line_number) - min(line_number) AS span FROM messages GROUP BY session_id"

QUERIES["distinct_reads"] = lambda s, d: joins.typed_references(a.feedback(s, d).groupBy("rule_id").agg(F.collect_set(F.floor(F.col("event_id") / 7).cast("long")).alias("sources")), memory.latest(a.memories(s, d).select("memory_id"), ["memory_id"], ["memory_id"])).groupBy("reference_state").agg(F.count("*").alias("rules"))
ORACLE_SQL["distinct_reads"] = f"""
    WITH {a.FEEDBACK}, {a.MEMORIES}, r AS (SELECT DISTINCT rule_id, event_id // 7 AS m FROM feedback), c AS (SELECT rule_id, count(*) AS n, count(memory_id) AS k FROM r LEFT JOIN memories ON m = memory_id GROUP BY rule_id)
    SELECT CASE WHEN k = 0 THEN 'fully_orphaned' WHEN k < n THEN 'partially_orphaned' ELSE 'normal' END AS reference_state, count(*) AS rules FROM c GROUP BY 1"""

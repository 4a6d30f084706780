"""Queries: transcripts in four formats and the stores, over the test tables written out as their lines and texts."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..sources import stores, transcripts
from ..staging import scratch
from . import adapters as a

QUERIES, ORACLE_SQL = {}, {}
WRAPPED = "<system-reminder>be brief</system-reminder> "


def _lines(s, d):
    """The conversations as transcripts: session % 4 chooses the format, a broken and an empty line end each session."""
    m = a.messages(s, d).withColumn("content", F.concat(F.when(F.col("line_number") == 1, WRAPPED).otherwise(""), F.col("content")))
    role, text, sid = F.col("role"), F.col("content"), F.col("session_id")
    block = lambda kind: F.array(F.struct(F.lit(kind).alias("type"), text.alias("text")))
    when, cwd = F.lit("2026-01-01T00:00:00Z"), F.concat(F.lit("/w/"), sid.cast("string"))
    claude = F.struct(role.alias("type"), F.struct(role.alias("role"), block("text").alias("content")).alias("message"), cwd.alias("cwd"), when.alias("timestamp"))
    codex = F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("message").alias("type"), F.when(role == "system", "developer").otherwise(role).alias("role"), block("input_text").alias("content"), cwd.alias("cwd")).alias("payload"))
    kiro = F.struct(F.lit("event").alias("kind"), F.struct(F.when(role == "user", "human").when(role == "assistant", "bot").otherwise(role).alias("role"), text.alias("text")).alias("data"), when.alias("createdAt"), cwd.alias("workspacePath"))
    buddy = F.struct(F.lit("message").alias("type"), role.alias("role"), text.alias("content"))
    line = F.when(sid % 4 == 0, F.to_json(claude)).when(sid % 4 == 1, F.to_json(codex)).when(sid % 4 == 2, F.to_json(kiro)).otherwise(F.to_json(buddy))
    path = F.concat(F.element_at(F.array(*map(F.lit, ["/h/.claude/p/", "/h/.codex/p/", "/h/.kiro/p/", "/h/.workbuddy/c-proj/"])), (sid % 4 + 1).cast("int")), sid.cast("string"), F.lit(".jsonl"))
    broken = m.select("session_id").distinct().select(path.alias("path"), F.explode(F.array(F.struct(F.lit(998).cast("long").alias("line_number"), F.lit("{broken").alias("line")), F.struct(F.lit(999).cast("long").alias("line_number"), F.lit(" ").alias("line")))).alias("x")).select("path", "x.*")
    return transcripts.parsed(m.select(path.alias("path"), "line_number", line.alias("line")).unionByName(broken))


QUERIES["transcript_messages"] = lambda s, d: transcripts.messages(_lines(s, d)).select("session_id", F.col("line_number").cast("long").alias("line_number"), "role", "content", "project_path", F.unix_seconds("ts").alias("seconds"))
_SAID = f"""{a.MESSAGES}, t AS (SELECT CAST(session_id AS VARCHAR) AS session_id, session_id % 4 AS f, line_number, CASE WHEN session_id % 4 = 3 AND role <> 'user' THEN 'assistant' ELSE role END AS role, trim(content, ' ') AS content FROM messages)"""
ORACLE_SQL["transcript_messages"] = f"WITH {_SAID} SELECT session_id, line_number, role, content, CASE WHEN f = 3 THEN 'C:/proj' ELSE '/w/' || session_id END AS project_path, CASE WHEN f IN (0, 2) THEN epoch(TIMESTAMP '2026-01-01')::BIGINT END AS seconds FROM t WHERE content <> ''"
QUERIES["session_archive"] = lambda s, d: transcripts.archived(transcripts.messages(_lines(s, d))).orderBy(F.desc("messages"), "session_id").limit(50)
ORACLE_SQL["session_archive"] = f"""WITH {_SAID} SELECT session_id, count(*) AS messages, count(*) FILTER (role = 'user') AS asked, min(line_number) AS first_line, max(line_number) AS last_line, CAST(sum(length(content)) AS BIGINT) AS characters
    FROM t WHERE content <> '' GROUP BY session_id ORDER BY messages DESC, session_id LIMIT 50"""
QUERIES["transcript_formats"] = lambda s, d: _lines(s, d).groupBy("session_id").agg(F.min(transcripts.detect_format(F.col("path"), F.col("line"))).alias("format"))
ORACLE_SQL["transcript_formats"] = f"WITH {a.MESSAGES} SELECT DISTINCT CAST(session_id AS VARCHAR) AS session_id, ['claude-code', 'codex', 'kiro', 'workbuddy'][session_id % 4 + 1] AS format FROM messages"


def _calls(s, d):
    """Orders as calls of tools, half as records with arguments in text, half as blocks of a message; every third argument is no JSON."""
    key = F.col("o_orderkey")
    given = F.when(key % 3 == 0, F.lit("not json")).otherwise(F.concat(F.lit('{"k":'), F.col("o_custkey").cast("string"), F.lit("}")))
    call = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("function_call").alias("type"), F.col("o_orderstatus").alias("name"), given.alias("arguments")).alias("payload")))
    block = F.to_json(F.struct(F.lit("assistant").alias("type"), F.struct(F.array(F.struct(F.lit("tool_use").alias("type"), F.col("o_orderstatus").alias("name"), F.struct(F.col("o_custkey").alias("k")).alias("input"))).alias("content")).alias("message")))
    gave = F.to_json(F.struct(F.lit("response_item").alias("type"), F.struct(F.lit("function_call_output").alias("type"), F.when(key % 5 > 0, F.concat(F.lit("c"), key.cast("string"))).alias("call_id"), F.col("o_orderpriority").alias("content")).alias("payload")))
    path = F.concat(F.lit("/h/.codex/"), (key % 97).cast("string"), F.lit(".jsonl"))
    orders = a.table(s, d, "orders")
    calls = orders.select(path.alias("path"), (key * 2 + 1).alias("line_number"), F.when(key % 2 == 0, call).otherwise(block).alias("line"))
    return transcripts.parsed(calls.unionByName(orders.select(path.alias("path"), (key * 2 + 2).alias("line_number"), gave.alias("line"))))


QUERIES["transcript_calls"] = lambda s, d: transcripts.tool_calls(_calls(s, d)).select("session_id", "line_number", "tool_name", "input")
ORACLE_SQL["transcript_calls"] = """SELECT CAST(o_orderkey % 97 AS VARCHAR) AS session_id, o_orderkey * 2 + 1 AS line_number, o_orderstatus AS tool_name,
    CASE WHEN o_orderkey % 2 = 0 AND o_orderkey % 3 = 0 THEN '{"raw":"not json"}' ELSE '{"k":' || o_custkey || '}' END AS input FROM orders"""
QUERIES["transcript_outputs"] = lambda s, d: transcripts.tool_outputs(_calls(s, d)).select("call_id", "content", "line_number")
ORACLE_SQL["transcript_outputs"] = "SELECT CASE WHEN o_orderkey % 5 > 0 THEN 'c' || o_orderkey ELSE 'line_' || (o_orderkey * 2 + 2) END AS call_id, o_orderpriority AS content, o_orderkey * 2 + 2 AS line_number FROM orders"
QUERIES["changed_sessions"] = lambda s, d: transcripts.changed_sessions(a.table(s, d, "pages").select(F.col("page_id").alias("session_id"), F.sha2("html", 256).alias("content_hash")), a.table(s, d, "pages").select(F.col("page_id").alias("session_id"), F.sha2(F.when(F.col("page_id") % 3 > 0, F.col("html")).otherwise("old"), 256).alias("content_hash"))).select("session_id")
ORACLE_SQL["changed_sessions"] = "SELECT page_id AS session_id FROM pages WHERE page_id % 3 = 0"
QUERIES["resumed_messages"] = lambda s, d: transcripts.resumed(a.messages(s, d), a.messages(s, d).filter("session_id % 3 > 0").groupBy("session_id").agg((F.max("line_number") - 2).alias("last_line"))).select("session_id", "line_number")
ORACLE_SQL["resumed_messages"] = f"WITH {a.MESSAGES}, p AS (SELECT session_id, max(line_number) - 2 AS k FROM messages WHERE session_id % 3 > 0 GROUP BY session_id) SELECT session_id, line_number FROM messages LEFT JOIN p USING (session_id) WHERE line_number > coalesce(k, 0)"



def _markdown():
    """A rule as a text of Markdown with front matter."""
    return F.concat(
        F.lit("---\nid: rule-"), F.lpad(F.col("rule_id").cast("string"), 5, "0"), F.lit("\ntype: "), F.col("kind"), F.lit("\n---\n# "), F.col("description"), F.lit("\n## Description\n"), F.col("content"), F.lit("\n\n## Steps\n- first "), F.col("tech"), F.lit("\n* then "), F.col("functional"), F.lit("\n## Reason\nso it is\n"),
    )



QUERIES["rule_texts"] = lambda s, d: stores.parsed_rules(a.rules(s, d).select(F.col("rule_id").alias("path"), _markdown().alias("value"))).select(F.col("path").alias("rule_id"), F.col("meta")["id"].alias("id"), F.col("meta")["type"].alias("kind"), F.col("sections")["Reason"].alias("reason"), F.array_join("steps", "|").alias("steps"), F.array_join(F.array_sort(F.map_keys("sections")), ",").alias("titles"))
ORACLE_SQL["rule_texts"] = f"WITH {a.RULES} SELECT rule_id, 'rule-' || lpad(CAST(rule_id AS VARCHAR), 5, '0') AS id, kind, 'so it is' AS reason, 'first ' || tech || '|then ' || functional AS steps, 'Description,Reason,Steps' AS titles FROM rules"
QUERIES["next_rule_id"] = lambda s, d: stores.next_rule_id(a.rules(s, d).select(F.concat(F.when(F.col("rule_id") % 7 == 0, "old-").otherwise("rule-"), F.format_string("%05d", "rule_id")).alias("rule_id")))
ORACLE_SQL["next_rule_id"] = f"WITH {a.RULES} SELECT 'rule-' || CAST(max(rule_id) + 1 AS VARCHAR) AS rule_id FROM rules WHERE rule_id % 7 > 0"
QUERIES["rule_export"] = lambda s, d: stores.exported(a.rules(s, d), "kind").withColumn("place", F.col("place").cast("long"))
ORACLE_SQL["rule_export"] = f"""WITH {a.RULES} SELECT DISTINCT kind AS "group", 0::BIGINT AS place, '## ' || kind AS line FROM rules
    UNION ALL SELECT kind, row_number() OVER (PARTITION BY kind ORDER BY confidence DESC, rule_id), '- ' || content || ' (' || printf('%.2f', confidence) || ')' FROM rules"""


def _written_lines(s, d):
    """The conversations written as one file of lines for each format, and read back in small splits with their numbers."""
    folder = f"{scratch(s)}/lines-{uuid.uuid4().hex[:12]}"
    m = a.messages(s, d).withColumn("part", F.col("session_id") % 4)
    row = F.to_json(F.struct("session_id", "line_number", "content"))
    m.repartition(4, "part").sortWithinPartitions("part", "session_id", "line_number").select(row.alias("value"), "part").write.partitionBy("part").text(folder)
    return transcripts.numbered(s, folder, "*")


QUERIES["numbered_lines"] = lambda s, d: (
    _written_lines(s, d).select("line_number", F.from_json("line", "session_id long, line_number long, content string").alias("m"))
    .select(F.col("m.session_id").alias("session_id"), F.col("m.line_number").alias("turn"), "line_number", F.length("m.content").cast("long").alias("characters"))
)
ORACLE_SQL["numbered_lines"] = "SELECT conv_id AS session_id, turn + 1 AS turn, row_number() OVER (PARTITION BY conv_id % 4 ORDER BY conv_id, turn) AS line_number, length(text) AS characters FROM conversations"

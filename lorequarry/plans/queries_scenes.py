"""Queries: scenes, excerpts, links between patterns and messages."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scenes
from ..operators import joins
from . import adapters as a

QUERIES, ORACLE_SQL = {}, {}
SCENES = [("tech", "latin", "ción"), ("tech", "latin", "eux"), ("tech", "latin", "osñ"), ("tech", "german", "ung"), ("tech", "german", "keit"), ("functional", "shout", "!!"), ("functional", "table", " | ")]
SCENES_SQL = "d(axis, scene, term) AS (VALUES " + ", ".join(f"('{x}', '{y}', '{z}')" for x, y, z in SCENES) + ")"

QUERIES["scene_detection"] = lambda s, d: scenes.detected(a.table(s, d, "documents"), "doc_id", "text", s.createDataFrame(SCENES, "axis string, scene string, term string"))
ORACLE_SQL["scene_detection"] = f"""
    WITH {SCENES_SQL}, c AS (SELECT doc_id, axis, scene, count(DISTINCT term) AS hits FROM documents JOIN d ON contains(lower(text), lower(term)) GROUP BY ALL)
    SELECT *, CASE WHEN hits >= 3 THEN 0.9 WHEN hits = 2 THEN 0.7 ELSE 0.5 END::DOUBLE AS confidence FROM c"""


def _synonyms(s, d):
    pair = a.rules(s, d).select(F.col("keywords")[0].alias("term"), F.col("keywords")[1].alias("synonym"))
    return pair.groupBy("term", "synonym").agg(F.count("*").alias("weight"))


QUERIES["synonym_expansion"] = lambda s, d: scenes.expanded(s.createDataFrame([("red",), ("small",), ("none",)], "term string"), _synonyms(s, d), 3).withColumn("rank", F.col("rank").cast("long"))
ORACLE_SQL["synonym_expansion"] = f"""
    WITH {a.RULES}, q(term) AS (VALUES ('red'), ('small'), ('none')), w AS (SELECT keywords[1] AS term, keywords[2] AS synonym, count(*) AS weight FROM rules GROUP BY ALL),
    r AS (SELECT term, synonym, row_number() OVER (PARTITION BY term ORDER BY weight DESC, synonym) AS k FROM w JOIN q USING (term))
    SELECT term, term AS word, 0::BIGINT AS rank FROM q UNION ALL SELECT term, synonym, k FROM r WHERE k <= 3"""

QUERIES["file_language"] = lambda s, d: a.table(s, d, "pages").select("page_id", scenes.language_of(F.concat(F.lit("file"), F.col("page_id").cast("string"), F.element_at(F.array(*(F.lit(x) for x in (".py", ".TS", "", ".unknown"))), (F.col("page_id") % 4 + 1).cast("int")))).alias("language"))
ORACLE_SQL["file_language"] = "SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'python' WHEN 1 THEN 'typescript' ELSE 'text' END AS language FROM pages"

QUERIES["code_excerpts"] = lambda s, d: a.table(s, d, "documents").select("doc_id", scenes.excerpt(F.col("text"), F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 9 + 1), 2, 3).alias("excerpt"))
ORACLE_SQL["code_excerpts"] = """
    WITH x AS (SELECT doc_id, string_split(text, chr(10)) AS l, CASE WHEN doc_id % 2 = 0 THEN doc_id % 9 + 1 END AS n FROM documents)
    SELECT doc_id, array_to_string(l[greatest(coalesce(n, 1) - 2, 1) : CASE WHEN n IS NULL THEN 3 ELSE n + 2 END], chr(10)) AS excerpt FROM x"""

QUERIES["number_changes"] = lambda s, d: a.table(s, d, "pages").select("page_id", scenes.change(F.col("url")).alias("c")).select("page_id", "c.before", "c.after", "c.part")
ORACLE_SQL["number_changes"] = """
    WITH n AS (SELECT page_id, list_transform(regexp_extract_all(url, '(\\d+(?:\\.\\d+)?)', 1), lambda x: x::DOUBLE) AS n FROM pages)
    SELECT page_id, n[1] AS before, n[2] AS after, CASE WHEN n[1] > 0 THEN round((n[2] - n[1]) / n[1], 6) END AS part FROM n"""

QUERIES["json_shape"] = lambda s, d: a.table(s, d, "events").select("event_id", scenes.looks_like_json(F.col("props")).alias("json"), scenes.is_truncated(F.left("props", (F.col("event_id") % 12).cast("int"))).alias("cut"))
ORACLE_SQL["json_shape"] = """
    WITH x AS (SELECT event_id, props, left(props, event_id % 12) AS p FROM events)
    SELECT event_id, regexp_matches(trim(props, ' '), '(?s)^(\\{.*\\}|\\[.*\\])$') AS json, length(regexp_replace(p, '[^\\[{]', '', 'g')) > length(regexp_replace(p, '[^\\]}]', '', 'g')) AS cut FROM x"""


def _corrections(s, d):
    e = a.table(s, d, "events").select("user_id", "event_id", "event_type")
    from pyspark.sql import Window

    place = e.withColumn("n", F.row_number().over(Window.partitionBy("user_id").orderBy("event_id")))
    near = joins.band_join(place.filter("event_type = 'error'").select("user_id", "event_id", F.col("n").alias("m")), place.filter("event_type = 'purchase'").select("user_id", F.col("event_id").alias("fix_id"), F.col("n").alias("t")), "user_id", "m", "t", 11)
    return near.filter("t > m").groupBy("event_id").agg(F.min("fix_id").alias("fix_id"), F.count("*").alias("fixes"))


QUERIES["edit_after_error"] = _corrections
ORACLE_SQL["edit_after_error"] = """
    WITH p AS (SELECT user_id, event_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events)
    SELECT e.event_id, min(f.event_id) AS fix_id, count(*) AS fixes FROM p e JOIN p f ON e.user_id = f.user_id AND e.event_type = 'error' AND f.event_type = 'purchase' AND f.n > e.n AND f.n - e.n < 11 GROUP BY e.event_id"""

"""Queries: retrieval, ranking, classification."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, scoring, text
from ..operators import automaton, fulltext, mining, search, windows
from . import adapters as a

TERMS = ["the", "and", "that", "queux", "ción", "einer", "anonthe", "thble"]
QUERY = ", ".join(f"'{t}'" for t in sorted(TERMS))
SCENE = [("tech", "Brand#7"), ("functional", "ECONOMY"), ("business", "size-2")]
WANTED = ["red", "bolt", "gear"]
PROBE = "the thorat andeainea"
CODE, BUSINESS = ["the", "ent", "ción"], ["que", "der", "tion"]
HINTS = ["thble", "eux"]
QUERIES, ORACLE_SQL = {}, {}


def _texts(spark, sf, columns=("doc_id", "text")):
    return a.table(spark, sf, "documents").select(*columns)


QUERIES["token_df_idf"] = lambda s, d: (
    search.document_frequency(_texts(s, d), "doc_id", "text").crossJoin(F.broadcast(_texts(s, d).agg(F.count("*").alias("n"))))
    .select("term", "df", F.round(text.idf(F.col("n"), F.col("df")), 6).alias("idf"))
)
ORACLE_SQL["token_df_idf"] = f"""
    WITH w AS (SELECT doc_id, unnest(list_distinct({a.words_sql("text")})) AS term FROM documents)
    SELECT term, count(*) AS df, round(ln(((SELECT count(*) FROM documents) + 1.0) / (count(*) + 1)) + 1, 6) AS idf FROM w GROUP BY term"""

QUERIES["keyword_search_topk"] = lambda s, d: search.keyword_search(
    a.messages(s, d).select(F.concat_ws(":", "session_id", F.lpad(F.col("line_number").cast("string"), 4, "0")).alias("message_id"), "content"), "message_id", "content", TERMS, 10
)
ORACLE_SQL["keyword_search_topk"] = f"""
    WITH {a.MESSAGES},
    m AS (SELECT session_id || ':' || lpad(CAST(line_number AS VARCHAR), 4, '0') AS message_id, content FROM messages),
    w AS (SELECT message_id, unnest(list_distinct({a.words_sql("content")})) AS term FROM m),
    h AS (SELECT * FROM w WHERE term IN ({QUERY})),
    f AS (SELECT term, ln(((SELECT count(*) FROM m) + 1.0) / (count(*) + 1)) + 1 AS idf FROM h GROUP BY term)
    SELECT message_id, count(*) AS matches, round(sum(idf), 6) AS score FROM h JOIN f USING (term)
    GROUP BY message_id ORDER BY score DESC, message_id LIMIT 10"""

QUERIES["bm25_topk"] = lambda s, d: search.bm25(_texts(s, d), "doc_id", "text", TERMS, 20)
ORACLE_SQL["bm25_topk"] = f"""
    WITH w AS (SELECT doc_id, {a.words_sql("text")} AS w FROM documents),
    t AS (SELECT doc_id, len(w) AS len, unnest(w) AS term FROM w),
    tf AS (SELECT doc_id, len, term, count(*) AS tf FROM t WHERE term IN ({QUERY}) GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w)
    SELECT doc_id, round(sum(ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score
    FROM tf JOIN df USING (term), st GROUP BY doc_id ORDER BY score DESC, doc_id LIMIT 20"""

QUERIES["fulltext_topk"] = lambda s, d: fulltext.TextIndex.build(_texts(s, d), "doc_id", "text").top("than " + " ".join(TERMS), 20).withColumnRenamed("id", "doc_id")
ORACLE_SQL["fulltext_topk"] = ORACLE_SQL["bm25_topk"].replace(f"IN ({QUERY})", f"IN ('than', {QUERY})")

POSTINGS_SQL = """
    p AS (SELECT id, len(w) AS len, w[i] AS term, i FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w)),
    st AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM w),
    tf AS (SELECT id, len, term, count(*) AS tf, list(i) AS places FROM p GROUP BY ALL),
    df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    x AS (SELECT id, term, ln((n - df + 0.5) / (df + 0.5) + 1) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean)) AS impact FROM tf JOIN df USING (term), st)"""


def _matches_sql(words, *clauses):
    """clauses: ('word', w), ('phrase', [words]) or ('prefix', p)."""
    def one(i, kind, value):
        if kind == "word":
            return f"SELECT id, {i} AS clause, impact AS score FROM x WHERE term = '{value}'"
        if kind == "prefix":
            return f"SELECT id, {i} AS clause, sum(impact) AS score FROM x WHERE starts_with(term, '{value}') GROUP BY id"
        held = f"SELECT id FROM (SELECT id, w, unnest(range(1, len(w) + 1)) AS i FROM w) WHERE w[i : i + {len(value) - 1}] = {value!r}"
        return f"SELECT id, {i} AS clause, sum(impact) AS score FROM x WHERE term IN {tuple(value)!r} AND id IN ({held}) GROUP BY id"

    return f"""WITH {words}, {POSTINGS_SQL}, c AS ({" UNION ALL ".join(one(i, *c) for i, c in enumerate(clauses))})
    SELECT id, round(sum(score), 6) AS score FROM c GROUP BY id HAVING count(DISTINCT clause) = {len(clauses)}"""


QUERIES["fulltext_documents"] = lambda s, d: fulltext.TextIndex.build(_texts(s, d), "doc_id", "text").match("and the", "to", "in*")
ORACLE_SQL["fulltext_documents"] = _matches_sql(f"w AS (SELECT doc_id AS id, {a.words_sql('text')} AS w FROM documents)", ("phrase", ["and", "the"]), ("word", "to"), ("prefix", "in"))
QUERIES["fulltext_rules"] = lambda s, d: fulltext.TextIndex.build(a.rules(s, d), "rule_id", "content").match("instead of guessing", "see", "gu*").join(a.rules(s, d).select(F.col("rule_id").alias("id"), "confidence"), "id")
ORACLE_SQL["fulltext_rules"] = _matches_sql(f"{a.RULES}, w AS (SELECT rule_id AS id, {a.words_sql('content')} AS w FROM rules)", ("phrase", ["instead", "of", "guessing"]), ("word", "see"), ("prefix", "gu")).replace(
    "SELECT id, round(sum(score), 6) AS score FROM c", "SELECT id, round(sum(score), 6) AS score, any_value(confidence) AS confidence FROM c JOIN rules ON rule_id = id"
)

QUERIES["rules_by_segments"] = lambda s, d: search.rules_by_segments(a.rules(s, d), WANTED, 50)
ORACLE_SQL["rules_by_segments"] = f"""
    WITH {a.RULES}, g AS (SELECT rule_id, confidence, unnest(list_distinct(keywords)) AS segment FROM rules)
    SELECT rule_id, confidence, count(DISTINCT segment) AS match_count FROM g WHERE segment IN ('red', 'bolt', 'gear')
    GROUP BY rule_id, confidence ORDER BY match_count DESC, confidence DESC, rule_id LIMIT 50"""

QUERIES["scene_search"] = lambda s, d: search.rules_by_scene(a.rules(s, d), SCENE)
ORACLE_SQL["scene_search"] = f"""
    WITH {a.RULES}, i AS (
        SELECT rule_id, tech AS value FROM rules WHERE tech = 'Brand#7' UNION ALL
        SELECT rule_id, functional FROM rules WHERE functional = 'ECONOMY' UNION ALL
        SELECT rule_id, business FROM rules WHERE business = 'size-2')
    SELECT rule_id, count(DISTINCT value) AS match_count FROM i GROUP BY rule_id"""

QUERIES["ranked_rules"] = lambda s, d: search.ranked_rules(a.rules(s, d).filter(search.in_scope(["global", "project"], "/srv/p3")), SCENE, WANTED, 100)
ORACLE_SQL["ranked_rules"] = f"""
    WITH {a.RULES}, s AS (
        SELECT rule_id, priority, confidence, round(
            ((CASE WHEN tech = 'Brand#7' THEN 1.0::DOUBLE ELSE 0 END + CASE WHEN functional = 'ECONOMY' THEN 1.0 ELSE 0 END
              + CASE WHEN business = 'size-2' THEN 1.0 ELSE 0 END) / 3 * 0.6
             + len(list_intersect(keywords, ['red', 'bolt', 'gear'])) / 3.0::DOUBLE * 0.4) * confidence, 6) AS relevance
        FROM rules WHERE status = 'active' AND (scope = 'global' OR scope = 'project' AND project_path = '/srv/p3'))
    SELECT * FROM s WHERE relevance > 0 ORDER BY {a.PRIORITY_RANK}, relevance DESC, confidence DESC, rule_id LIMIT 100"""

QUERIES["fuzzy_rules"] = lambda s, d: search.fuzzy_rules(a.rules(s, d), ["bolts", "gear", "re"])
ORACLE_SQL["fuzzy_rules"] = f"""
    WITH {a.RULES}, k AS (SELECT rule_id, unnest(keywords) AS k FROM rules), q(w) AS (VALUES ('bolts'), ('gear'), ('re'))
    SELECT rule_id, round(sum(CASE WHEN k = w THEN 1.0::DOUBLE ELSE
        (greatest(length(k), length(w)) - levenshtein(k, w)) / greatest(length(k), length(w))::DOUBLE * 0.7 END), 6) AS score
    FROM k JOIN q ON contains(k, w) OR contains(w, k) GROUP BY rule_id"""


def _fused(s, d):
    rules = a.rules(s, d)
    hits = [rules.filter(F.col(c) == v).select(F.lit(c).alias("scene"), F.lit(w).alias("weight"), F.col("rule_id").alias("id"), F.col("confidence").alias("relevance")) for (c, v), w in zip(SCENE, (0.9, 0.5, 0.2), strict=True)]
    return search.fused(hits[0].union(hits[1]).union(hits[2]))


QUERIES["priority_fusion"] = _fused
ORACLE_SQL["priority_fusion"] = f"""
    WITH {a.RULES}, h AS (
        SELECT rule_id AS id, confidence, 0.9::DOUBLE AS weight, 'tech' AS scene FROM rules WHERE tech = 'Brand#7' UNION ALL
        SELECT rule_id, confidence, 0.5, 'functional' FROM rules WHERE functional = 'ECONOMY'),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY weight DESC, scene) AS k FROM h)
    SELECT id, round(sum(confidence * weight * CASE WHEN k = 1 THEN 1.0::DOUBLE ELSE 0.5 END), 6) AS score, count(*) AS scenes FROM r GROUP BY id"""


def _memory_sql(weights: str) -> str:
    words = sorted(set(PROBE.split()))
    joined = "".join(PROBE.split())
    pairs = sorted({joined[i : i + 2] for i in range(len(joined) - 1)})
    matched = " + ".join(f"(CASE WHEN contains(lower(content), '{w}') THEN 1 ELSE 0 END)" for w in words)
    return f"""
    WITH {a.MEMORIES}, p AS (SELECT *, string_split(regexp_replace(lower(content), '\\s+', '', 'g'), '') AS c FROM memories WHERE status = 'active'),
    g AS (SELECT *, list_distinct(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])) AS grams FROM p),
    s AS (SELECT *, ({matched}) / {len(words)}.0::DOUBLE AS lex,
                 CASE WHEN len(grams) = 0 THEN 0.0::DOUBLE ELSE len(list_intersect(grams, {pairs})) / (len(grams) + {len(pairs)} - len(list_intersect(grams, {pairs})))::DOUBLE END AS sem,
                 greatest(0.0, 1 - (epoch_us(TIMESTAMP '{a.NOW}') - epoch_us(created_at)) / 86400000000.0::DOUBLE / 30) AS recent FROM g),
    f AS (SELECT memory_id, round(lex, 6) AS lexical, round(sem, 6) AS semantic, round({weights}, 6) AS score FROM s WHERE lex > 0 OR sem >= 0.18)
    SELECT * FROM f WHERE score > 0.12 ORDER BY score DESC, memory_id LIMIT 25"""


_SHARED = "importance * 0.12 + confidence * 0.12 + least(1.0, strength / 5) * 0.08 + least(1.0, validations / 3.0::DOUBLE) * 0.06"
QUERIES["memory_search"] = lambda s, d: search.search_memory(a.memories(s, d), PROBE, a.now(), 25)
ORACLE_SQL["memory_search"] = _memory_sql(f"sem * 0.22 + lex * 0.25 + {_SHARED} + recent * 0.03 + CASE WHEN outcome = 'success' THEN 0.02::DOUBLE ELSE 0 END - least(1.0, contradictions / 2.0::DOUBLE) * 0.12")
QUERIES["memory_search_indexed"] = lambda s, d: search.search_memory(a.memories(s, d), PROBE, a.now(), 25, indexed=True)
ORACLE_SQL["memory_search_indexed"] = _memory_sql(f"sem * 0.22 + lex * 0.32 + {_SHARED} + recent * 0.08 - least(1.0, contradictions / 2.0::DOUBLE) * 0.12")

QUERIES["sensitivity_flags"] = lambda s, d: _texts(s, d).select("doc_id", classify.sensitive(F.col("text")).alias("sensitive"))
ORACLE_SQL["sensitivity_flags"] = "SELECT doc_id, " + " OR ".join("regexp_matches(coalesce(text, ''), '" + p.replace("'", "''") + "')" for p in classify.SENSITIVE) + " AS sensitive FROM documents"

QUERIES["content_category"] = lambda s, d: _texts(s, d).select("doc_id", classify.content_category(F.col("text"), CODE, BUSINESS).alias("c")).select("doc_id", "c.category", "c.allowed")
_C = lambda ws: " + ".join(f"(CASE WHEN contains(lower(text), '{w}') THEN 1 ELSE 0 END)" for w in ws)
ORACLE_SQL["content_category"] = f"""
    WITH n AS (SELECT doc_id, {_C(CODE)} AS c, {_C(BUSINESS)} AS b FROM documents), r AS (SELECT *, CASE WHEN c + b > 0 THEN b / (c + b)::DOUBLE END AS r FROM n)
    SELECT doc_id, CASE WHEN c + b = 0 THEN 'general' WHEN r > 0.6 THEN 'business' WHEN r <= 0.3 THEN 'code' ELSE 'mixed' END AS category,
           coalesce(r, 0.0) <= 0.6 AS allowed FROM r"""

QUERIES["token_estimate"] = lambda s, d: _texts(s, d).select("doc_id", text.tokens_estimate(F.col("text")).cast("long").alias("tokens"), text.is_chinese(F.col("text")).alias("chinese"))
ORACLE_SQL["token_estimate"] = """SELECT doc_id, CAST(ceil(length(text) / 4.0) AS BIGINT) AS tokens,
    length(regexp_replace(text, '\\s', '', 'g')) > 0 AND length(regexp_replace(text, '[^一-鿿]', '', 'g')) / length(regexp_replace(text, '\\s', '', 'g'))::DOUBLE >= 0.12 AS chinese FROM documents"""

QUERIES["context_windows"] = lambda s, d: automaton.occurrences(_texts(s, d), s.createDataFrame([("than",)], "text string"), ["doc_id"], "text").withColumnRenamed("context", "excerpt")
ORACLE_SQL["context_windows"] = """
    WITH p AS (SELECT doc_id, text, unnest(list_filter(range(0, length(text)), lambda i: substr(lower(text), i + 1, 4) = 'than')) AS start FROM documents WHERE contains(lower(text), 'than')),
    b AS (SELECT *, greatest(start - 50, 0) AS lo, least(start + 54, length(text)) AS hi FROM p)
    SELECT doc_id, start, CASE WHEN lo > 0 THEN '...' ELSE '' END || substr(text, lo + 1, hi - lo) || CASE WHEN hi < length(text) THEN '...' ELSE '' END AS excerpt FROM b"""

QUERIES["pattern_fingerprint"] = lambda s, d: a.messages(s, d).filter("role = 'user'").select(text.fingerprint(F.lit("preference"), F.col("content")).alias("fingerprint")).groupBy("fingerprint").agg(F.count("*").alias("occurrences"))
ORACLE_SQL["pattern_fingerprint"] = f"""WITH {a.MESSAGES} SELECT 'pattern-fp-' || left(sha256('preference:' || lower(trim(content, ' '))), 8) AS fingerprint, count(*) AS occurrences
    FROM messages WHERE role = 'user' GROUP BY 1"""

QUERIES["props_json"] = lambda s, d: a.table(s, d, "events").select("event_type", F.try_variant_get(F.try_parse_json("props"), "$.k", "long").alias("k")).groupBy("event_type").agg(F.count("k").alias("n"), F.sum("k").alias("total"), F.max("k").alias("largest"))
ORACLE_SQL["props_json"] = "SELECT event_type, count(k) AS n, CAST(sum(k) AS BIGINT) AS total, max(k) AS largest FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events) GROUP BY event_type"

QUERIES["keyword_frequency"] = lambda s, d: mining.keyword_frequency(a.table(s, d, "documents").select("source", "text"), "source", text.words(F.col("text")), 10).withColumn("rank", F.col("rank").cast("long"))
ORACLE_SQL["keyword_frequency"] = f"""
    WITH w AS (SELECT source, unnest({a.words_sql("text")}) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL),
    r AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY n DESC, length(word) DESC, word) AS rank FROM c) SELECT * FROM r WHERE rank <= 10"""

QUERIES["common_keywords"] = lambda s, d: mining.common_keywords(a.table(s, d, "documents"), "source", "doc_id", text.words(F.col("text")), 0.6)
ORACLE_SQL["common_keywords"] = f"""
    WITH z AS (SELECT source, count(DISTINCT doc_id) AS size FROM documents GROUP BY source),
    w AS (SELECT DISTINCT source, doc_id, unnest({a.words_sql("text")}) AS word FROM documents), c AS (SELECT source, word, count(*) AS n FROM w GROUP BY ALL)
    SELECT source, word, n FROM c JOIN z USING (source) WHERE n >= greatest(1, ceil(round(size * 0.6, 9)))"""

QUERIES["export_quota"] = lambda s, d: windows.quotas(
    a.rules(s, d).select("rule_id", "kind", "confidence", "priority"), "kind",
    [F.desc(F.round("confidence", 2)), scoring.priority_rank(F.col("priority")), "rule_id"], {"economy": 0.3, "small": 0.3, "standard": 0.2, "large": 0.15, "promo": 0.05}, 60,
)
_ORDER = f"round(confidence, 2) DESC, {a.PRIORITY_RANK}, rule_id"
ORACLE_SQL["export_quota"] = f"""
    WITH {a.RULES}, r AS (SELECT rule_id, kind, confidence, priority, row_number() OVER (PARTITION BY kind ORDER BY {_ORDER}) AS k FROM rules),
    q AS (SELECT *, k <= CASE kind WHEN 'economy' THEN 18 WHEN 'small' THEN 18 WHEN 'standard' THEN 12 WHEN 'large' THEN 9 WHEN 'promo' THEN 3 ELSE 0 END AS within_quota FROM r WHERE k <= 60)
    SELECT rule_id, kind, confidence, priority, within_quota FROM q ORDER BY within_quota DESC, {_ORDER} LIMIT 60"""

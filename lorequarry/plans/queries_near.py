"""Queries: similarity joins, nearest rows, duplicates, clusters, conflicts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import similarity, text
from ..operators import clustering, conflicts, duplicates, graphs, joins, memory, mining, near, vectors
from ..staging import spread, staged
from . import adapters as a

QUERIES, ORACLE_SQL = {}, {}
JACCARD = "len(list_intersect({0}, {1})) / (len({0}) + len({1}) - len(list_intersect({0}, {1})))::DOUBLE"
BIGRAMS = "list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1])"
CHARACTERS = "string_split(regexp_replace(lower({}), '\\s+', '', 'g'), '')"


# ---------------------------------------------------------------- similarity joins
def _pairs(name, classes, sql, threshold, source="documents"):
    def query(s, d):
        sets = classes(a.table(s, d, "documents").select("source", F.col("doc_id").alias("id"), "text"))
        return near.similar(sets, ["source"], threshold, carried=["copies"]).select("a", "b", F.round("score", 6).alias("similarity"), "copies_a", "copies_b")

    QUERIES[name] = query
    ORACLE_SQL[name] = f"""
    WITH x AS (SELECT doc_id, source, list_sort(list_distinct({sql})) AS i FROM {source}),
    c AS (SELECT source, i, min(doc_id) AS id, count(*) AS copies FROM x WHERE len(i) > 0 GROUP BY source, i)
    SELECT l.id AS a, r.id AS b, round({JACCARD.format("l.i", "r.i")}, 6) AS similarity, l.copies AS copies_a, r.copies AS copies_b
    FROM c l JOIN c r ON l.source = r.source AND l.id < r.id WHERE round({JACCARD.format("l.i", "r.i")}, 9) >= {threshold}"""


_pairs("token_jaccard_pairs", lambda rows: near.classes(rows, "id", ["source"], text.words(F.col("text"))), a.words_sql("text"), 0.55)
_pairs("bigram_jaccard_pairs", lambda rows: near.set_classes(near.character_pairs(rows, "text").drop("text"), ["source"]), BIGRAMS, 0.8, f"(SELECT doc_id, source, {CHARACTERS.format('text')} AS c FROM documents)")

QUERIES["token_set_classes"] = lambda s, d: (
    a.table(s, d, "documents").select("doc_id", "source", near.hashed(text.words(F.col("text"))).alias("items"))
    .join(near.classes(a.table(s, d, "documents"), "doc_id", ["source"], text.words(F.col("text"))), ["source", "items"]).select("doc_id", F.col("id").alias("class_id"), "copies")
)
ORACLE_SQL["token_set_classes"] = f"""
    WITH x AS (SELECT doc_id, source, list_sort(list_distinct({a.words_sql("text")})) AS i FROM documents)
    SELECT doc_id, min(doc_id) OVER (PARTITION BY source, i) AS class_id, count(*) OVER (PARTITION BY source, i) AS copies FROM x WHERE len(i) > 0"""


def _word_sets(s, d):
    return staged(a.table(s, d, "documents").select("source", F.col("doc_id").alias("id"), near.hashed(text.words(F.col("text"))).alias("items")), "document_words")


def _related(s, d):
    sets = _word_sets(s, d)
    return near.nearest(sets.filter("id % 20 = 0"), sets, ["source"], 5)


QUERIES["related_memories"] = lambda s, d: _related(s, d).select("query_id", "row_id", "score")
RELATED = f"""
    WITH x AS (SELECT doc_id, source, list_distinct({a.words_sql("text")}) AS w FROM documents),
    p AS (SELECT q.doc_id AS query_id, r.doc_id AS row_id, CASE WHEN len(q.w) + len(r.w) = 0 THEN 0.0::DOUBLE ELSE round({JACCARD.format("q.w", "r.w")}, 6) END AS score
        FROM x q JOIN x r ON q.source = r.source AND q.doc_id % 20 = 0 AND r.doc_id <> q.doc_id),
    k AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, row_id) AS rank FROM p) SELECT query_id, row_id, score, rank FROM k WHERE rank <= 5"""
ORACLE_SQL["related_memories"] = f"SELECT query_id, row_id, score FROM ({RELATED})"

UNIT = lambda c: F.transform(c, lambda x: x.cast("double") / text.norm(F.col("embedding")))
UNIT_SQL = "u AS (SELECT vec_id AS id, label, list_transform(embedding, lambda x: x::DOUBLE / sqrt(list_sum(list_transform(embedding, lambda y: y::DOUBLE * y::DOUBLE)))) AS v FROM embeddings)"


def _topk(s, d):
    index = vectors.VectorIndex(a.table(s, d, "embeddings"), "vec_id", "embedding")
    found = index.nearest(index.rows.filter("id % 20 = 0"), 10, 0.1)
    return found.select(F.col("query_id").alias("id"), F.col("row_id").alias("other"), F.round("score", 4).alias("score"))


QUERIES["embedding_topk"] = _topk
ORACLE_SQL["embedding_topk"] = f"""
    WITH {UNIT_SQL},
    p AS (SELECT q.id, o.id AS other, round(list_dot_product(q.v, o.v), 6) AS score FROM u q JOIN u o ON q.id % 20 = 0 AND q.id <> o.id),
    k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, other) AS k FROM p WHERE score >= 0.1) SELECT id, other, round(score, 4) AS score FROM k WHERE k <= 10"""


def _matched(s, d):
    return a.memories(s, d).select(
        "memory_id", "kind", "project", "content", (F.col("memory_id") % 3).alias("object"), F.left("content", F.lit(60)).alias("summary"),
        F.array().cast("array<string>").alias("keywords"), F.col("created_at").alias("updated_at"),
    )


QUERIES["memory_consolidation"] = lambda s, d: conflicts.consolidation(_matched(s, d).filter("memory_id % 2 = 0"), _matched(s, d).filter("memory_id % 2 = 1"))


def _stance(column, pairs, whole):
    test = lambda w: f"regexp_matches({column}, '(^|[^a-z0-9_]){w}($|[^a-z0-9_])')" if whole and w.isascii() else f"contains({column}, '{w}')"
    return lambda x, y: "(" + " OR ".join(f"({test(p).replace('§', x)} AND {test(q).replace('§', y)} OR {test(q).replace('§', x)} AND {test(p).replace('§', y)})" for p, q in pairs) + ")"


SUBJECT = f"list_distinct(list_filter({a.words_sql('left(content, 60)')}, lambda w: length(w) > 2))"
SAME_SUBJECT = "len(list_intersect({0}, {1})) >= 0.5 * greatest(1, least(len({0}), len({1})))"
ORACLE_SQL["memory_consolidation"] = f"""
    WITH {a.MEMORIES}, x AS (SELECT memory_id, kind, project, memory_id % 3 AS object, created_at, lower(content) AS low, trim(lower(content), ' ') AS t, list_distinct({a.words_sql("content")}) AS w, {SUBJECT} AS sub FROM memories),
    p AS (SELECT n.memory_id AS new_id, o.memory_id AS old_id, round({JACCARD.format("n.w", "o.w")}, 6) AS score,
            CASE WHEN n.object <> o.object THEN 'relation-object-changed' WHEN n.t <> o.t AND {SAME_SUBJECT.format("n.sub", "o.sub")} AND {_stance("§.low", conflicts.OPPOSING, False)("n", "o")} THEN 'opposing-obligation'
                 WHEN n.t <> o.t AND {SAME_SUBJECT.format("n.sub", "o.sub")} AND {_stance("§.low", conflicts.CONTRASTIVE, True)("n", "o")} THEN 'contrastive-qualifier' END AS reason,
            n.created_at >= o.created_at AS newer
        FROM x n JOIN x o ON n.kind = o.kind AND n.project = o.project AND n.memory_id % 2 = 0 AND o.memory_id % 2 = 1 AND len(n.w) > 0 AND len(o.w) > 0),
    k AS (SELECT *, row_number() OVER (PARTITION BY new_id ORDER BY score DESC, old_id) AS k FROM p WHERE score >= 0.55)
    SELECT x.memory_id AS new_id, old_id, score, reason, CASE WHEN reason IS NOT NULL AND newer THEN 'SUPERSEDE' WHEN reason IS NULL AND score >= 0.9 THEN 'UPDATE' ELSE 'ADD' END AS decision
    FROM x LEFT JOIN k ON x.memory_id = k.new_id AND k.k = 1 WHERE x.memory_id % 2 = 0"""

# ---------------------------------------------------------------- containment
QUERIES["uncovered_patterns"] = lambda s, d: joins.uncovered(a.table(s, d, "documents").select("doc_id", F.col("text").alias("pattern")), a.table(s, d, "benchmark").select(F.col("text").alias("rule_text")), "doc_id").select("doc_id")
ORACLE_SQL["uncovered_patterns"] = """SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b
    WHERE contains(lower(d.text), left(lower(b.text), 40)) OR contains(lower(b.text), left(lower(d.text), 40)))"""
QUERIES["pattern_messages"] = lambda s, d: (
    joins.containing(a.table(s, d, "documents").select("doc_id", F.col("text").alias("body")), "body", a.table(s, d, "benchmark").select("item_id", F.left("text", F.lit(40)).alias("head")), "head")
    .groupBy("item_id").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("found"))
)
ORACLE_SQL["pattern_messages"] = "SELECT item_id, min(doc_id) AS first_doc, count(*) AS found FROM documents d JOIN benchmark b ON contains(d.text, left(b.text, 40)) GROUP BY item_id"


# ---------------------------------------------------------------- duplicates of rules
def _rules(s, d):
    axes = [F.array(c).alias(c) for c in duplicates.AXES]
    return spread(a.rules(s, d)).select("rule_id", "kind", "scope", "project_path", "keywords", *axes, "description", "confidence")


QUERIES["rule_duplicate_pairs"] = lambda s, d: duplicates.rule_pairs(_rules(s, d))
_STOP = "[" + ", ".join(f"'{w}'" for w in similarity.RULE_STOP_WORDS) + "]"
RULE_SIMILARITY = f"""{a.RULES}, w AS (SELECT rule_id, kind, scope, CASE WHEN scope = 'project' THEN project_path ELSE '' END AS place, keywords, tech, functional, business, description,
        list_distinct(list_filter({a.words_sql("description")}, lambda x: length(x) >= 2 AND NOT list_contains({_STOP}, x))) AS dw FROM rules),
    cl AS (SELECT kind, scope, place, keywords, tech, functional, business, description, dw, min(rule_id) AS id, list(rule_id) AS members FROM w GROUP BY ALL),
    sim AS (SELECT x.id AS a, y.id AS b, round({JACCARD.format("list_distinct(x.keywords)", "list_distinct(y.keywords)")} * 0.5
            + ((x.tech = y.tech)::INT + (x.functional = y.functional)::INT + (x.business = y.business)::INT) / 3.0::DOUBLE * 0.3
            + CASE WHEN len(x.dw) = 0 AND len(y.dw) = 0 THEN 1.0 WHEN len(x.dw) = 0 OR len(y.dw) = 0 THEN 0.0 ELSE {JACCARD.format("x.dw", "y.dw")} END * 0.1 + 0.1, 6) AS similarity
        FROM cl x JOIN cl y ON x.kind = y.kind AND x.scope = y.scope AND x.place = y.place AND x.id < y.id)"""
ORACLE_SQL["rule_duplicate_pairs"] = f"""WITH {RULE_SIMILARITY} SELECT a, b, similarity, CASE WHEN similarity >= 0.8 THEN 'merge' WHEN similarity >= 0.75 THEN 'update-existing' ELSE 'keep-separate' END AS action FROM sim WHERE similarity >= 0.65"""
QUERIES["rule_duplicate_groups"] = lambda s, d: duplicates.duplicate_groups(_rules(s, d)).select("class_id", "leader", F.size("members").cast("long").alias("rules"))
# A recursive table settles one class after the other: a class is free unless an earlier leader is like it.
LEADERS = """o AS (SELECT id, row_number() OVER (ORDER BY {order}) AS k FROM {nodes}),
    n AS (SELECT p.k AS k, q.k AS e FROM {pairs} JOIN o p ON p.id = {pairs}.b JOIN o q ON q.id = {pairs}.a WHERE q.k < p.k UNION SELECT p.k, q.k FROM {pairs} JOIN o p ON p.id = {pairs}.a JOIN o q ON q.id = {pairs}.b WHERE q.k < p.k),
    l AS (SELECT k, list(e ORDER BY e) AS e FROM n GROUP BY k),
    f AS (SELECT 1::BIGINT AS k, [1::BIGINT] AS lead, 1::BIGINT AS mine UNION ALL
        SELECT f.k + 1, CASE WHEN len(list_intersect(coalesce(l.e, []), f.lead)) = 0 THEN list_append(f.lead, f.k + 1) ELSE f.lead END,
               CASE WHEN len(list_intersect(coalesce(l.e, []), f.lead)) = 0 THEN f.k + 1 ELSE list_min(list_intersect(l.e, f.lead)) END
        FROM f LEFT JOIN l ON l.k = f.k + 1 WHERE f.k < (SELECT count(*) FROM o)),
    led AS (SELECT o.id, q.id AS leader FROM f JOIN o USING (k) JOIN o q ON q.k = f.mine)"""
GROUPS = f"""WITH RECURSIVE {RULE_SIMILARITY}, dup AS (SELECT a, b FROM sim WHERE similarity >= 0.75), {LEADERS.format(order="id", nodes="cl", pairs="dup")}"""
ORACLE_SQL["rule_duplicate_groups"] = f"{GROUPS} SELECT cl.id AS class_id, leader, len(members)::BIGINT AS rules FROM cl JOIN led ON cl.id = led.id"
QUERIES["rule_merges"] = lambda s, d: duplicates.merged_rules(r := _rules(s, d).withColumn("examples", F.array("description", F.concat("scope", F.lit(" "), F.col("rule_id").cast("string")))), duplicates.duplicate_groups(r)).withColumn("examples", F.array_join("examples", ";"))
ORACLE_SQL["rule_merges"] = f"""{GROUPS}, m AS (SELECT leader, unnest(members) AS rule_id FROM cl JOIN led ON cl.id = led.id), g AS (SELECT leader, count(*) AS members, avg(confidence) AS c FROM m JOIN rules USING (rule_id) GROUP BY leader),
    kw AS (SELECT leader, array_to_string(list_sort(list_distinct(flatten(list(keywords)))), ' ') AS keywords FROM m JOIN rules USING (rule_id) GROUP BY leader),
    xa AS (SELECT leader, e, min((rule_id, pos)) AS f FROM (SELECT leader, rule_id, unnest([0, 1]) AS pos, unnest([description, scope || ' ' || rule_id]) AS e FROM m JOIN rules USING (rule_id)) GROUP BY leader, e),
    xb AS (SELECT leader, string_agg(e, ';' ORDER BY f, e) AS examples FROM (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY f, e) AS k FROM xa) WHERE k <= 5 GROUP BY leader)
    SELECT leader, members, round(CASE WHEN members > 1 THEN least(1.0, c + 0.05) ELSE c END, 6) AS confidence, keywords, examples FROM g JOIN kw USING (leader) JOIN xb USING (leader)"""
QUERIES["generated_rules_kept"] = lambda s, d: duplicates.generated_kept(_rules(s, d)).select("leader", F.col("taken").cast("long").alias("taken"))
ORACLE_SQL["generated_rules_kept"] = f"{GROUPS} SELECT leader, (sum(len(members)) - 1)::BIGINT AS taken FROM cl JOIN led ON cl.id = led.id GROUP BY leader"
QUERIES["merge_proposals"] = lambda s, d: duplicates.merge_proposal(a.rules(s, d).withColumn("topic", F.concat("functional", F.lit("-"), (F.round(F.col("confidence") * 50) % 8).cast("int").cast("string"))), "topic")
ORACLE_SQL["merge_proposals"] = f"""
    WITH {a.RULES}, tp AS (SELECT *, functional || '-' || (round(confidence * 50)::BIGINT % 8) AS topic FROM rules), w AS (SELECT topic, rule_id, list_distinct({a.words_sql("content")}) AS w FROM tp),
    p AS (SELECT x.topic, avg({JACCARD.format("x.w", "y.w")}) AS similarity FROM w x JOIN w y ON x.topic = y.topic AND x.rule_id < y.rule_id GROUP BY x.topic),
    t AS (SELECT DISTINCT topic, trim(unnest(string_split_regex(content, '[.!?]\\s+|\\n[-*]\\s+')), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS point FROM tp),
    u AS (SELECT topic, list_sort(list(point)) AS p FROM t WHERE length(point) > 10 GROUP BY topic),
    g AS (SELECT topic, count(*) AS rules, round(avg(confidence), 6) AS confidence FROM tp GROUP BY topic)
    SELECT topic, g.rules, confidence, round(similarity, 6) AS similarity, coalesce(CASE WHEN len(p) > 1 THEN array_to_string(list_transform(p, lambda x: '- ' || x), chr(10)) ELSE array_to_string(p, '. ') END, '') AS content
    FROM g JOIN p USING (topic) LEFT JOIN u USING (topic) WHERE g.rules > 1 AND round(similarity, 6) >= 0.25"""



def _patterns(s, d):
    return a.rules(s, d).select(F.col("rule_id").alias("pattern_id"), F.col("kind").alias("pattern_type"), F.when(F.col("rule_id") % 9 > 0, F.col("keywords")).otherwise(F.array().cast("array<string>")).alias("keywords"), F.col("content").alias("description"), F.when(F.col("rule_id") % 4 > 0, F.concat_ws(" ", "tech", "business")).alias("context"), "confidence")


QUERIES["pattern_pairs"] = lambda s, d: duplicates.pattern_pairs(_patterns(s, d), 0.7, 6)
ORACLE_SQL["pattern_pairs"] = f"""
    WITH {a.RULES}, x AS (SELECT rule_id, kind, CASE WHEN rule_id % 9 > 0 THEN list_distinct(keywords) ELSE [] END AS k, list_distinct(list_filter({a.words_sql("content")}, lambda w: length(w) >= 3)) AS w,
        rule_id % 4 > 0 AS known, list_distinct(list_filter({a.words_sql("tech || ' ' || business")}, lambda w: length(w) >= 3)) AS c FROM rules),
    p AS (SELECT x.rule_id AS a, y.rule_id AS b, round(0.4 * CASE WHEN len(x.k) + len(y.k) = 0 THEN 1 WHEN len(x.k) * len(y.k) = 0 THEN 0 ELSE {JACCARD.format("x.k", "y.k")} END
            + 0.3 * CASE WHEN len(x.w) + len(y.w) = 0 THEN 1 WHEN len(x.w) * len(y.w) = 0 THEN 0 ELSE {JACCARD.format("x.w", "y.w")} END
            + CASE WHEN x.known AND y.known THEN 0.1 * {JACCARD.format("x.c", "y.c")} ELSE 0 END + 0.2, 9)::DOUBLE AS s
        FROM x JOIN x y ON x.kind = y.kind AND x.rule_id < y.rule_id)
    SELECT a, b, round(s, 6) AS similarity FROM p WHERE s >= 0.7"""
# Clusters of ten at most, by confidence: tests hold them against a loop.
QUERIES["pattern_clusters"] = lambda s, d: duplicates.pattern_clusters(_patterns(s, d))

# ---------------------------------------------------------------- evidence
def _evidence(s, d):
    """Memories of three ids are added to the one before them."""
    i = F.col("memory_id")
    rows = a.memories(s, d).select(
        "memory_id", "confidence", "importance", "strength", (1 + i % 2).alias("support"), "validations", "contradictions", F.col("created_at").alias("updated_at"),
        F.array("kind", "info_class").alias("keywords"), F.array((i % 7).cast("string"), (i % 5).cast("string")).alias("session_ids"), F.array("project").alias("projects"),
    )
    decisions = rows.filter(i % 4 > 0).select(i.alias("new_id"), (i - i % 4).alias("old_id"), F.when(i % 9 > 0, "UPDATE").otherwise("ADD").alias("decision"))
    return conflicts.merged_evidence(decisions, rows.filter(i % 4 > 0), rows.filter(i % 4 == 0))


QUERIES["evidence_updates"] = lambda s, d: _evidence(s, d)[0].withColumn("updated_at", F.unix_micros("updated_at"))
_EVIDENCE = f"""{a.MEMORIES}, u AS (SELECT memory_id - memory_id % 4 AS tgt, * FROM memories WHERE memory_id % 4 > 0 AND memory_id % 9 > 0),
    o AS (SELECT memory_id AS tgt, * FROM memories WHERE memory_id IN (SELECT tgt FROM u) AND memory_id % 4 = 0), al AS (SELECT *, true AS added FROM u WHERE tgt IN (SELECT tgt FROM o) UNION ALL SELECT *, false FROM o),
    ev AS (SELECT DISTINCT tgt AS memory_id, kind_, value FROM (SELECT tgt, unnest(['keyword', 'keyword', 'session', 'session', 'project']) AS kind_, unnest([kind, info_class, CAST(memory_id % 7 AS VARCHAR), CAST(memory_id % 5 AS VARCHAR), project]) AS value FROM al) WHERE value IS NOT NULL)"""
ORACLE_SQL["evidence_updates"] = f"""
    WITH {_EVIDENCE}, n AS (SELECT memory_id, count(*) FILTER (kind_ = 'keyword') AS keywords, count(*) FILTER (kind_ = 'session') AS sessions, count(*) FILTER (kind_ = 'project') AS projects FROM ev GROUP BY memory_id)
    SELECT n.memory_id, max(confidence) AS confidence, max(importance) AS importance, sum(strength) AS strength, CAST(sum(1 + al.memory_id % 2) AS BIGINT) AS support, CAST(sum(validations) AS BIGINT) AS validations, CAST(sum(contradictions) AS BIGINT) AS contradictions,
        max(CASE WHEN added THEN epoch_us(created_at) END) AS updated_at, any_value(n.keywords) AS keywords, any_value(n.sessions) AS sessions, any_value(n.projects) AS projects FROM al JOIN n ON n.memory_id = al.tgt GROUP BY n.memory_id"""
QUERIES["evidence_rows"] = lambda s, d: _evidence(s, d)[1]
ORACLE_SQL["evidence_rows"] = f"WITH {_EVIDENCE} SELECT memory_id, kind_ AS kind, value FROM ev"

# ---------------------------------------------------------------- conflicts
QUERIES["contradicting_rules"] = lambda s, d: conflicts.contradictions(a.rules(s, d)).withColumn("pair", F.col("pair").cast("long"))
_CLAIMS = [
    "SELECT rule_id, -1::BIGINT AS pair, CASE WHEN regexp_extract(low, '\\b(always|never)\\s+(?:use|choose|prefer)\\s+(.+?)(?:[.,;]|$)', 1) = 'never' THEN 1 ELSE 0 END AS side, trim(regexp_extract(low, '\\b(always|never)\\s+(?:use|choose|prefer)\\s+(.+?)(?:[.,;]|$)', 2), ' ') AS subject FROM t WHERE regexp_matches(low, '\\b(always|never)\\s+(?:use|choose|prefer)\\s+(.+?)(?:[.,;]|$)')",
    "SELECT rule_id, -1, CASE WHEN regexp_matches(regexp_extract(low, '(?:总是|绝不|从不|不要)\\s*(?:使用|选择|采用|用|优先)\\s*([一-鿿㐀-䶿A-Za-z0-9_]+)'), '绝不|从不|不要') THEN 1 ELSE 0 END, regexp_extract(low, '(?:总是|绝不|从不|不要)\\s*(?:使用|选择|采用|用|优先)\\s*([一-鿿㐀-䶿A-Za-z0-9_]+)', 1) FROM t WHERE regexp_matches(low, '(?:总是|绝不|从不|不要)\\s*(?:使用|选择|采用|用|优先)\\s*([一-鿿㐀-䶿A-Za-z0-9_]+)') AND NOT regexp_matches(low, '\\b(always|never)\\s+(?:use|choose|prefer)\\s+(.+?)(?:[.,;]|$)')",
]
_VERBS = "v(pair, side, verb) AS (VALUES (0, 0, 'use'), (0, 1, 'avoid'), (1, 0, 'prefer'), (1, 1, 'avoid'), (2, 0, 'always'), (2, 1, 'never'), (3, 0, 'enable'), (3, 1, 'disable'), (4, 0, 'add'), (4, 1, 'remove'), (5, 0, '使用'), (5, 1, '避免'), (6, 0, '优先'), (6, 1, '避免'), (7, 0, '总是'), (7, 1, '从不'), (8, 0, '启用'), (8, 1, '禁用'), (9, 0, '添加'), (9, 1, '移除'))"
_CLAIMS += [
    f"SELECT rule_id, {k}, {side}, trim(regexp_extract(low, '{verb}\\s*([一-鿿㐀-䶿A-Za-z0-9_\\s]+?)(?:[.,;，。]|$)', 1), ' ') FROM t WHERE regexp_matches(low, '{verb}\\s*([一-鿿㐀-䶿A-Za-z0-9_\\s]+?)(?:[.,;，。]|$)')"
    for k, verbs in enumerate([("use", "avoid"), ("prefer", "avoid"), ("always", "never"), ("enable", "disable"), ("add", "remove"), ("使用", "避免"), ("优先", "避免"), ("总是", "从不"), ("启用", "禁用"), ("添加", "移除")])
    for side, verb in enumerate(verbs)
]
ORACLE_SQL["contradicting_rules"] = f"""
    WITH {a.RULES}, t AS (SELECT rule_id, lower(content) AS low FROM rules), c AS ({" UNION ALL ".join(_CLAIMS)}),
    g AS (SELECT pair, side, subject, min(rule_id) AS id, count(DISTINCT rule_id) AS n, list_distinct({a.words_sql("subject")}) AS w FROM c GROUP BY pair, side, subject)
    SELECT x.id AS a, y.id AS b, x.pair, x.subject AS subject_a, y.subject AS subject_b, x.n AS rules_a, y.n AS rules_b
    FROM g x JOIN g y ON x.pair = y.pair AND x.side = 0 AND y.side = 1 WHERE len(x.w) > 0 AND len(y.w) > 0 AND {JACCARD.format("x.w", "y.w")} > CASE WHEN x.pair < 0 THEN 0.2 ELSE 0.6 END"""
QUERIES["overlapping_rules"] = lambda s, d: conflicts.overlaps(a.rules(s, d))
ORACLE_SQL["overlapping_rules"] = f"""
    WITH {a.RULES}, x AS (SELECT rule_id, list_sort(list_distinct({a.words_sql("content")})) AS w FROM rules), c AS (SELECT w, min(rule_id) AS id FROM x WHERE len(w) > 0 GROUP BY w),
    s AS (SELECT l.id AS a, r.id AS b, {JACCARD.format("l.w", "r.w")} AS s FROM c l JOIN c r ON l.id < r.id)
    SELECT a, b, CASE WHEN round(s, 9) >= 0.95 THEN 'redundancy' ELSE 'overlap' END AS conflict, round(s, 6) AS similarity FROM s WHERE round(s, 9) > 0.7
    UNION ALL SELECT c.id, rule_id, 'redundancy', 1.0 FROM x JOIN c USING (w) WHERE rule_id <> c.id"""
STANCES = [("the", "thble"), ("und", "ung"), ("que", "eux")]
QUERIES["memory_conflicts"] = lambda s, d: conflicts.stated_conflicts(a.memories(s, d, conflicts.stated(F.col("text"), F.left("text", F.lit(60)), F.array().cast("array<string>"), STANCES)).select("memory_id", "kind", "project", "stances", "words"))
ORACLE_SQL["memory_conflicts"] = f"""
    WITH {a.MEMORIES}, x AS (SELECT memory_id, kind, project, lower(content) AS low, {SUBJECT} AS sub FROM memories)
    SELECT p.memory_id AS a, q.memory_id AS b, coalesce(p.project = q.project, true) AS same_project FROM x p JOIN x q ON p.kind = q.kind AND p.memory_id < q.memory_id
    WHERE len(p.sub) > 0 AND len(q.sub) > 0 AND len(list_intersect(p.sub, q.sub)) >= 0.5 * least(len(p.sub), len(q.sub)) AND {_stance("§.low", STANCES, False)("p", "q")}"""


# ---------------------------------------------------------------- clusters
def _embedding_clusters(s, d):
    rows = near.dense_vectors(a.table(s, d, "embeddings"), "vec_id", UNIT(F.col("embedding")), "label")
    pairs = staged(near.similar(rows, ["label"], 0.5, "cosine").select("a", "b"), "embedding_pairs")
    led = graphs.leader_clusters(rows.select("id", (-F.col("id")).alias("_o")), pairs, ["_o"], 20)
    return rows.select("label", "id").join(led, "id").select("label", F.col("id").alias("vec_id"), "leader")


QUERIES["embedding_clusters"] = _embedding_clusters
QUERIES["cluster_stats"] = lambda s, d: clustering.cluster_stats(QUERIES["embedding_clusters"](s, d))


def _user_messages(s, d):
    words = similarity.message_words(F.col("content"))
    said = mining.user_messages(a.messages(s, d)).withColumn("id", F.col("session_id") * 1000 + F.col("line_number"))
    return said.select("id", "session_id", F.length("content").alias("length"), words.alias("words"), similarity.topic_counts(F.array_distinct(words)).alias("topics"), F.concat(F.lit("src/m"), (F.col("line_number") % 3).cast("string"), F.lit("/a")).alias("path"))


def _message_clusters(s, d):
    said = staged(_user_messages(s, d), "messages")
    vectors = clustering.block_vectors(said, "session_id", "id", F.col("words"), F.col("topics"))
    pairs = staged(duplicates.message_pairs(said, vectors, "session_id"), "message_pairs")
    led = graphs.leader_clusters(said.select("id", (-F.col("length")).alias("_o")), pairs, ["_o"], 20)
    return said.select("session_id", "id").join(led, "id").select("session_id", (F.col("id") % 1000).alias("line_number"), (F.col("leader") % 1000).alias("leader"))


QUERIES["message_clusters"] = _message_clusters
QUERIES["centroid_assignment"] = lambda s, d: clustering.assigned(
    near.dense_vectors(a.table(s, d, "embeddings"), "vec_id", UNIT(F.col("embedding"))), clustering.centroids(a.table(s, d, "embeddings").select("label", UNIT(F.col("embedding")).alias("vector")), "label", "vector"), 0.2
).select("id", "centroid")
ORACLE_SQL["centroid_assignment"] = f"""
    WITH {UNIT_SQL}, e AS (SELECT label, unnest(v) AS x, unnest(range(1, len(v) + 1)) AS i FROM u), m AS (SELECT label, i, avg(x) AS m FROM e GROUP BY label, i),
    c AS (SELECT label, list(m ORDER BY i) AS v FROM m GROUP BY label), p AS (SELECT id, c.label, round(list_dot_product(u.v, c.v), 6) AS s FROM u, c),
    r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY s DESC, label) AS k FROM p)
    SELECT id, CASE WHEN s >= 0.2 THEN label END AS centroid FROM r WHERE k = 1"""
QUERIES["hashed_tfidf"] = lambda s, d: clustering.hashed_terms(a.table(s, d, "documents"), "doc_id", "text").select("doc_id", "slot", F.round("weight", 6).alias("weight"))
HASHED = f"""ch AS (SELECT doc_id, list_filter({CHARACTERS.format("text")}, lambda x: x <> '') AS c FROM documents),
    gr AS (SELECT doc_id, unnest(list_concat(list_transform(range(1, len(c)), lambda i: c[i] || c[i + 1]), list_transform(range(1, len(c) - 1), lambda i: c[i] || c[i + 1] || c[i + 2]))) AS term FROM ch),
    tf AS (SELECT doc_id, term, count(*) AS tf FROM gr GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
    sl AS (SELECT term, ln(((SELECT count(*) FROM documents) + 1.0) / (df + 1)) + 1 AS idf, CAST(list_reduce(list_prepend(2166136261::UBIGINT, list_transform(string_split(term, ''), lambda c: CAST(ascii(c) AS UBIGINT))),
        lambda x, y: (xor(x, y) * 16777619::UBIGINT) % 4294967296::UBIGINT) % 2048 AS BIGINT) AS slot FROM df),
    wt AS (SELECT doc_id, slot, sum(tf * idf) AS w FROM tf JOIN sl USING (term) GROUP BY ALL), nm AS (SELECT doc_id, sqrt(sum(w * w)) AS n FROM wt GROUP BY doc_id)"""
ORACLE_SQL["hashed_tfidf"] = f"WITH {HASHED} SELECT doc_id, slot, round(w / n, 6) AS weight FROM wt JOIN nm USING (doc_id)"


def _memory_clusters(s, d):
    docs = a.table(s, d, "benchmark").select(F.col("item_id").alias("memory_id"), "text").unionByName(a.table(s, d, "benchmark").select((F.col("item_id") + 100000).alias("memory_id"), F.concat(F.lit("again "), F.col("text")).alias("text")))
    vectors = near.weighted_terms(clustering.hashed_terms(docs, "memory_id", "text"), "memory_id", "slot", "weight")
    return duplicates.memory_clusters(docs, vectors)


QUERIES["memory_clusters"] = _memory_clusters


def _merged_memories(s, d):
    rows = near.dense_vectors(a.table(s, d, "embeddings"), "vec_id", UNIT(F.col("embedding")))
    memories = a.memories(s, d).join(rows.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    known = rows.join(memories.select(F.col("memory_id").alias("id")), "id", "left_semi")
    return duplicates.merged_memories(memories, duplicates.memory_clusters(memories, staged(known, "known_vectors")))


QUERIES["merged_memories"] = _merged_memories


def _promoted(s, d):
    rows = near.dense_vectors(a.table(s, d, "embeddings"), "vec_id", UNIT(F.col("embedding")))
    memories = a.memories(s, d).filter("status = 'active' and kind = 'procedural'").join(rows.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
    known = rows.join(memories.select(F.col("memory_id").alias("id")), "id", "left_semi")
    return duplicates.promoted_clusters(memories, duplicates.memory_clusters(memories, staged(known, "known_vectors"), 0.3))


QUERIES["promoted_clusters"] = _promoted
ORACLE_SQL["promoted_clusters"] = f"""
    WITH RECURSIVE {a.MEMORIES}, {UNIT_SQL}, nodes AS (SELECT id FROM u JOIN memories ON id = memory_id WHERE status = 'active' AND kind = 'procedural'),
    near AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.id < q.id JOIN nodes x ON x.id = p.id JOIN nodes y ON y.id = q.id WHERE round(list_dot_product(p.v, q.v), 9) >= 0.3), {LEADERS.format(order="id", nodes="nodes", pairs="near")},
    r AS (SELECT leader, arg_min(info_class, (-confidence, memory_id)) AS c, max(contradictions) AS bad, round(greatest(0.0, least(1.0, max(confidence) * 0.55 + least(1.0, max(sessions) / 3.0::DOUBLE) * 0.1 + least(1.0, count(DISTINCT project) / 2.0::DOUBLE) * 0.1
        + least(1.0, sum(validations) / 3.0::DOUBLE) * 0.15 + least(1.0, max(strength) / 5) * 0.1 - least(1.0, max(contradictions) / 2.0::DOUBLE) * 0.35)), 6)::DOUBLE AS score FROM led JOIN memories ON led.id = memory_id GROUP BY leader)
    SELECT memory_id, leader, score FROM led JOIN memories ON led.id = memory_id JOIN r USING (leader) WHERE c <> 'fact' AND bad = 0 AND score >= 0.65 AND state <> 'promoted'"""
ORACLE_SQL["merged_memories"] = f"""
    WITH RECURSIVE {a.MEMORIES}, {UNIT_SQL}, nodes AS (SELECT id FROM u JOIN memories ON id = memory_id),
    near AS (SELECT p.id AS a, q.id AS b FROM u p JOIN u q ON p.id < q.id JOIN nodes x ON x.id = p.id JOIN nodes y ON y.id = q.id WHERE round(list_dot_product(p.v, q.v), 9) >= 0.68), {LEADERS.format(order="id", nodes="nodes", pairs="near")}
    SELECT leader, arg_min(memory_id, (-confidence, memory_id)) AS representative, count(*) AS members, max(confidence) AS confidence, max(strength) AS strength, CAST(sum(validations) AS BIGINT) AS validations,
        max(contradictions) AS contradictions, max(sessions) AS sessions, count(DISTINCT project) AS projects FROM led JOIN memories ON led.id = memory_id GROUP BY leader"""


def _labelled(s, d):
    matches = joins.dictionary_matches(a.messages(s, d), a.signals(s), ["session_id", "line_number"], "content")
    said = matches.groupBy("session_id", "line_number").agg(F.collect_set("signal_id").alias("ids"), F.round(F.avg("confidence"), 6).alias("confidence"), F.min("pattern_type").alias("pattern_type"))
    length = a.messages(s, d).select("session_id", "line_number", F.length("content").alias("length"))
    return staged(said.join(length, ["session_id", "line_number"]).select((F.col("session_id") * 1000 + F.col("line_number")).alias("content_id"), "session_id", "pattern_type", F.transform("ids", lambda x: x.cast("string")).alias("signals"), "length", "confidence"), "labelled")


QUERIES["labelled_clusters"] = lambda s, d: duplicates.labelled_records(c := _labelled(s, d), duplicates.labelled_clusters(c)).withColumn("signals", F.array_join("signals", ","))
LABELLED = f"""{a.MESSAGES}, {a.SIGNALS_SQL}, lb AS (SELECT session_id * 1000 + line_number AS id, session_id, min(pattern_type) AS pattern_type, list_sort(list(CAST(signal_id AS VARCHAR))) AS sg, min(length(content)) AS n, round(avg(confidence), 6) AS c
        FROM messages JOIN signals ON contains(lower(content), signals.text) GROUP BY session_id, line_number),
    lp AS (SELECT x.id AS a, y.id AS b FROM lb x JOIN lb y ON x.pattern_type = y.pattern_type AND x.id < y.id
        WHERE round({JACCARD.format("x.sg", "y.sg")} * 0.7 + (1 - abs(x.n - y.n) / greatest(x.n, y.n)::DOUBLE) * 0.1 + (1 - abs(x.c - y.c)) * 0.2, 9) > 0.7), {LEADERS.format(order="id", nodes="lb", pairs="lp")},
    lz AS (SELECT leader, pattern_type, count(*) AS occurrences, count(DISTINCT session_id) AS sessions, round(avg(c), 6) AS confidence FROM led JOIN lb USING (id) GROUP BY ALL),
    lm AS (SELECT leader, list(sg ORDER BY id) AS sets FROM led JOIN lb USING (id) GROUP BY leader),
    lr AS (SELECT lz.*, list_sort(list_reduce(sets, lambda x, y: CASE WHEN len(list_intersect(x, y)) > 0 THEN list_intersect(x, y) ELSE x END)) AS signals FROM lz JOIN lm USING (leader))"""
ORACLE_SQL["labelled_clusters"] = f"WITH RECURSIVE {LABELLED} SELECT leader, pattern_type, occurrences, sessions, confidence, array_to_string(signals, ',') AS signals FROM lr"
QUERIES["small_clusters"] = lambda s, d: duplicates.merged_small(staged(duplicates.labelled_records(c := _labelled(s, d), duplicates.labelled_clusters(c)), "clusters"), 4)
ORACLE_SQL["small_clusters"] = f"""WITH RECURSIVE {LABELLED}, lq AS (SELECT x.leader, y.leader AS target, round({JACCARD.format("x.signals", "y.signals")}, 6) AS score FROM lr x JOIN lr y ON x.pattern_type = y.pattern_type AND x.occurrences < 4 AND y.occurrences >= 4),
    lk AS (SELECT *, row_number() OVER (PARTITION BY leader ORDER BY score DESC, target) AS k FROM lq WHERE score > 0.5) SELECT leader, target, score FROM lk WHERE k = 1"""


def _words_as_signals(s, d):
    words = a.table(s, d, "benchmark").select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("text")).distinct()
    return words.select((F.conv(F.substring(F.md5("text"), 1, 12), 16, 10).cast("long")).alias("signal_id"), "text", F.when(F.length("text") % 2 == 0, "correction").otherwise("preference").alias("pattern_type"))


QUERIES["merged_signals"] = lambda s, d: duplicates.alike_signals(_words_as_signals(s, d))
ORACLE_SQL["merged_signals"] = f"""
    WITH RECURSIVE w AS (SELECT DISTINCT unnest({a.words_sql("text")}) AS t FROM benchmark), sg AS (SELECT CAST(('0x' || left(md5(t), 12)) AS BIGINT) AS id, length(t) % 2 AS p, list_distinct(string_split(t, '')) AS c FROM w),
    sp AS (SELECT x.id AS a, y.id AS b FROM sg x JOIN sg y ON x.p = y.p AND x.id < y.id WHERE round({JACCARD.format("x.c", "y.c")}, 9) > 0.8), {LEADERS.format(order="id", nodes="sg", pairs="sp")}
    SELECT id AS signal_id, leader FROM led"""
QUERIES["absorbed_clusters"] = lambda s, d: duplicates.absorbed(
    a.rules(s, d).groupBy("kind", "content").agg(F.min("rule_id").alias("leader"), F.count("*").alias("members")).select("leader", F.col("kind").alias("pattern_type"), F.col("content").alias("description"), "members")
)
ORACLE_SQL["absorbed_clusters"] = f"""
    WITH RECURSIVE {a.RULES}, cx AS (SELECT min(rule_id) AS id, kind, count(*) AS m, list_distinct({a.words_sql("content")}) AS w FROM rules GROUP BY kind, content),
    cp AS (SELECT x.id AS a, y.id AS b FROM cx x JOIN cx y ON x.kind <> y.kind AND x.id < y.id WHERE len(x.w) > 0 AND len(y.w) > 0 AND round({JACCARD.format("x.w", "y.w")}, 9) >= 0.65), {LEADERS.format(order="m DESC, id", nodes="cx", pairs="cp")}
    SELECT id AS leader, leader AS keeper FROM led"""

"""Ranked search over rules and memories."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import scoring, text


def document_frequency(docs: DataFrame, id_col: str, content: str) -> DataFrame:
    """term, df: in how many rows a word stands."""
    return docs.select(id_col, F.explode(F.array_distinct(text.words(F.col(content)))).alias("term")).groupBy("term").agg(F.count("*").alias("df"))


def keyword_search(docs: DataFrame, id_col: str, content: str, query: list[str], limit: int) -> DataFrame:
    """Top rows by summed idf of the query words that they hold: id, matches, score. Ties go to the smaller id."""
    wanted = sorted(set(query))
    each = docs.select(id_col, F.explode(F.array_intersect(text.words(F.col(content)), F.array(*map(F.lit, wanted)))).alias("term"))
    counts = each.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.agg(F.count("*").alias("n"))
    weights = counts.crossJoin(F.broadcast(n)).select("term", text.idf(F.col("n"), F.col("df")).alias("idf"))  # a row for each query word
    scored = each.join(F.broadcast(weights), "term").groupBy(id_col).agg(F.count("*").alias("matches"), F.round(F.sum("idf"), 6).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(limit)


def bm25(docs: DataFrame, id_col: str, content: str, query: list[str], limit: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Full-text ranking: id, score."""
    wanted = F.array(*map(F.lit, sorted(set(query))))
    counted = docs.select(id_col, text.words(F.col(content)).alias("w")).select(id_col, F.size("w").alias("len"), F.filter("w", lambda x: F.array_contains(wanted, x)).alias("hits"))
    stats = counted.agg(F.count("*").alias("n"), F.avg("len").alias("mean"))
    terms = counted.select(id_col, "len", F.explode("hits").alias("term")).groupBy(id_col, "len", "term").agg(F.count("*").alias("tf"))
    df = terms.groupBy("term").agg(F.count("*").alias("df"))
    joined = terms.join(F.broadcast(df), "term").crossJoin(F.broadcast(stats))  # one row of totals
    weight = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    part = F.col("tf") * (k1 + 1) / (F.col("tf") + k1 * (1 - b + b * F.col("len") / F.col("mean")))
    return joined.groupBy(id_col).agg(F.round(F.sum(weight * part), 6).alias("score")).orderBy(F.desc("score"), id_col).limit(limit)


def rules_by_segments(rules: DataFrame, query: list[str], limit: int) -> DataFrame:
    """Rules by how many distinct query segments their keywords hold, then confidence, then id."""
    request = F.array(*map(F.lit, sorted(set(query))))
    found = rules.select("rule_id", "confidence", F.explode(F.array_intersect("keywords", request)).alias("segment"))
    return found.groupBy("rule_id", "confidence").agg(F.countDistinct("segment").alias("match_count")).orderBy(F.desc("match_count"), F.desc("confidence"), "rule_id").limit(limit)


def rules_by_scene(rules: DataFrame, scene: list[tuple[str, str]]) -> DataFrame:
    """Rules by how many distinct values of a scene, given as (dimension, value), they have."""
    axes = F.explode(F.array(*(F.struct(F.lit(d).alias("dimension"), F.col(d).alias("value")) for d in ("tech", "functional", "business"))))
    index = rules.select("rule_id", axes.alias("s")).select("rule_id", "s.*")
    request = rules.sparkSession.createDataFrame(sorted(set(scene)), "dimension string, value string")
    return index.join(F.broadcast(request), ["dimension", "value"]).groupBy("rule_id").agg(F.countDistinct("value").alias("match_count"))


#: What an organisation's rule may be bound to.
BINDINGS = ("organization_id", "team_id", "repository", "branch")


def in_scope_of(scopes: list[str], project: str | None, **context: str | None) -> Column:
    """in_scope, where rules without a scope are global and an organisation's rule asks for what it is bound to.

    context: organization_id, team_id, repository, branch of the asker; a rule that has one of them (a column of that
    name) is shown where the asker has the same. No scopes: all are wanted, whatever they are bound to.
    """
    scope = F.coalesce(F.col("scope"), F.lit("global"))
    visible = F.col("status").isNull() | ~F.col("status").isin("deprecated", "disabled", "archived")
    if not scopes:
        return visible
    bound = F.lit(True)
    for name in BINDINGS:
        own = F.coalesce(F.col(name), F.lit(""))
        bound = bound & ((own == "") | (own == F.lit(context.get(name) or "")))
    theirs = text.path_key(F.col("project_path"))
    mine = F.lit((project or "").replace("\\", "/").rstrip("/").lower())
    related = (mine == theirs) | mine.startswith(F.concat(theirs, F.lit("/"))) | theirs.startswith(F.concat(mine, F.lit("/")))
    near = F.lit(bool(project)) & F.col("project_path").isNotNull() & related
    return visible & scope.isin(scopes) & F.coalesce(F.when(scope == "project", near).when(scope == "organization", bound).otherwise(True), F.lit(False))


def in_scope(scopes: list[str], project: str) -> Column:
    """Whether a rule may be shown: a visible status, a wanted scope and, for project rules, a related path."""
    mine, theirs = F.lit(project), text.path_key(F.col("project_path"))
    related = (mine == theirs) | mine.startswith(F.concat(theirs, F.lit("/"))) | theirs.startswith(F.concat(mine, F.lit("/")))
    return ~F.col("status").isin("deprecated", "disabled", "archived") & F.col("scope").isin(scopes) & ((F.col("scope") != "project") | related)


def ranked_rules(rules: DataFrame, scene: list[tuple[str, str]], keywords: list[str], limit: int) -> DataFrame:
    """Search order: priority, relevance (.6 scene + .4 keywords, times confidence), confidence, id."""
    request = dict(scene)
    hits = sum((F.when(F.col(d) == v, 1.0).otherwise(0.0) for d, v in request.items()), F.lit(0.0)) / max(1, len(request))
    words = F.size(F.array_intersect("keywords", F.array(*map(F.lit, keywords)))) / max(1, len(keywords))
    relevance = F.round((hits * 0.6 + words * 0.4) * F.col("confidence"), 6)
    found = rules.select("rule_id", "priority", "confidence", relevance.alias("relevance")).filter("relevance > 0")
    return found.orderBy(scoring.priority_rank(F.col("priority")), F.desc("relevance"), F.desc("confidence"), "rule_id").limit(limit)


def fuzzy_rules(rules: DataFrame, query: list[str]) -> DataFrame:
    """Rules by fuzzy keywords: 1 for an equal word, .7 times edit similarity where one contains the other."""
    request = rules.sparkSession.createDataFrame([(w,) for w in sorted(set(query))], "wanted string")
    pairs = rules.select("rule_id", F.explode("keywords").alias("keyword")).join(F.broadcast(request), F.col("keyword").contains(F.col("wanted")) | F.col("wanted").contains(F.col("keyword")))
    score = F.when(F.col("keyword") == F.col("wanted"), 1.0).otherwise(text.edit_similarity(F.col("keyword"), F.col("wanted")) * 0.7)
    return pairs.groupBy("rule_id").agg(F.round(F.sum(score), 6).alias("score"))


def fused(results: DataFrame, min_weight: float = 0.3) -> DataFrame:
    """Hits of several weighted scenes (scene, weight, id, relevance) in one list: the first counts in full, others by half."""
    from pyspark.sql import Window

    w = Window.partitionBy("id").orderBy(F.desc("weight"), "scene")
    ranked = results.filter(F.col("weight") >= min_weight).withColumn("rank", F.row_number().over(w))
    part = F.col("relevance") * F.col("weight") * F.when(F.col("rank") == 1, 1.0).otherwise(0.5)
    return ranked.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("scenes"))


def pair_counts(rows: DataFrame, content: str, wanted: list[str]) -> DataFrame:
    """rows without the text, with _pairs, the distinct character pairs of a text without white space, and _shared, those among the wanted.

    No rows move. Texts come alone, a few at a time, and are counted one by one.
    """
    dense = rows.withColumn("_dense", F.regexp_replace(F.lower(content), r"\s+", ""))
    query = frozenset(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.zeros((2, batch.num_rows), np.int32)
            for i, t in enumerate(batch.column("_dense")):
                t = t.as_py() or ""
                own = set(map(str.__add__, t, t[1:]))
                found[:, i] = len(own), len(own & query)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), *map(pa.array, found)], [*names, "_pairs", "_shared"])

    names = [c for c in rows.columns if c != content]
    dense = dense.drop(content)
    schema = T.StructType([*(f for f in rows.schema.fields if f.name != content), T.StructField("_pairs", T.IntegerType()), T.StructField("_shared", T.IntegerType())])
    return dense.mapInArrow(count, schema)


def search_memory(memories: DataFrame, query: str, now: Column, limit: int, indexed: bool = False) -> DataFrame:
    """Active memories by relevance to a query: memory_id, lexical, semantic, score.

    Every memory is scored; one without a matching word and with little in common by character pairs is left out.
    """
    body = F.lower("content")
    wanted = sorted({w for w in query.lower().split() if w})
    matched = sum((F.when(body.contains(w), 1).otherwise(0) for w in wanted), F.lit(0))
    pairs = sorted({p for q in ["".join(query.lower().split())] for p in (q[i : i + 2] for i in range(len(q) - 1))})
    lexical = matched / max(1, len(wanted))
    recent = scoring.recency(now, F.col("created_at"))
    own = [F.col(c) for c in ("importance", "confidence", "strength", "validations")]
    if indexed:
        score = scoring.memory_score_indexed(F.col("semantic"), F.col("lexical"), *own, recent, F.col("contradictions"))
    else:
        success = F.when(F.col("outcome") == "success", 1.0).otherwise(0.0)
        score = scoring.memory_score(F.col("semantic"), F.col("lexical"), F.lit(0.0), *own, recent, success, F.col("contradictions"))
    needed = ["memory_id", "importance", "confidence", "strength", "validations", "contradictions", "created_at", "outcome"]
    active = memories.filter("status = 'active'").select("content", lexical.alias("lexical"), *(c for c in needed if c in memories.columns))
    counted = pair_counts(active, "content", pairs)
    semantic = F.when(F.col("_pairs") + len(pairs) > F.col("_shared"), F.col("_shared") / (F.col("_pairs") + len(pairs) - F.col("_shared"))).otherwise(0.0)
    scored = counted.withColumn("semantic", semantic)
    found = scored.filter((F.col("lexical") > 0) | (F.col("semantic") >= 0.18)).select("memory_id", F.round("lexical", 6).alias("lexical"), F.round("semantic", 6).alias("semantic"), F.round(score, 6).alias("score"))
    return found.filter("score > 0.12").orderBy(F.desc("score"), "memory_id").limit(limit)

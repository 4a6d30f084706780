"""Scenes, scopes and code excerpts as Column expressions; the dictionaries are arguments."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: File extensions and the languages that they stand for.
LANGUAGES = {"py": "python", "ts": "typescript", "tsx": "typescript", "js": "javascript", "jsx": "javascript", "java": "java", "go": "go", "rs": "rust", "sql": "sql", "md": "markdown", "html": "html", "css": "css", "json": "json", "yaml": "yaml", "yml": "yaml"}


def detected(rows: DataFrame, ident: str, content: str, dictionary: DataFrame) -> DataFrame:
    """Scenes of texts by a small dictionary (axis, scene, term): ident, axis, scene, hits, confidence by hits."""
    found = rows.select(ident, F.lower(F.col(content)).alias("_c")).join(F.broadcast(dictionary), F.col("_c").contains(F.lower(F.col("term"))))
    counted = found.groupBy(ident, "axis", "scene").agg(F.countDistinct("term").alias("hits"))
    confidence = F.when(F.col("hits") >= 3, 0.9).when(F.col("hits") == 2, 0.7).otherwise(0.5)
    return counted.withColumn("confidence", confidence)


def expanded(request: DataFrame, synonyms: DataFrame, limit: int = 5) -> DataFrame:
    """Terms with their first `limit` synonyms (term, synonym, weight): term, word, rank; rank 0 is the term itself."""
    rank = F.row_number().over(Window.partitionBy("term").orderBy(F.desc("weight"), "synonym"))
    near = synonyms.join(F.broadcast(request.select("term")), "term").withColumn("rank", rank).filter(F.col("rank") <= limit)
    return request.select("term", F.col("term").alias("word"), F.lit(0).alias("rank")).unionByName(near.select("term", F.col("synonym").alias("word"), "rank"))


def organisation(path: Column) -> Column:
    """The folder below a common root of repositories, else null."""
    org = F.regexp_extract(path, r"(?i)(?:github\.com|gitlab\.com|/repos|/workspace|/projects|/src)[/:]([A-Za-z0-9._-]+)/", 1)
    return F.when(org != "", F.lower(org))


def language_of(name: Column) -> Column:
    """Language by the extension of a file name, text if it is unknown."""
    ext = F.lower(F.regexp_extract(name, r"\.([A-Za-z0-9]+)(?:[?#].*)?$", 1))
    out = F.lit("text")
    for e, language in LANGUAGES.items():
        out = F.when(ext == e, language).otherwise(out)
    return out


def excerpt(content: Column, line: Column, around: int = 5, otherwise: int = 20) -> Column:
    """The lines around a line (from 1), or the first ones where none is given."""
    lines = F.split(content, "\n")
    first = F.greatest(F.coalesce(line, F.lit(1)) - around, F.lit(1))
    last = F.when(line.isNull(), F.lit(otherwise)).otherwise(line + around)
    return F.array_join(F.slice(lines, first.cast("int"), F.greatest(last - first + 1, F.lit(0)).cast("int")), "\n")


def change(text: Column) -> Column:
    """struct(before, after, part) of the first two numbers of a text; part is the change over the first."""
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"(\d+(?:\.\d+)?)"), F.lit(1)), lambda x: x.cast("double"))
    a, b = F.get(numbers, F.lit(0)), F.get(numbers, F.lit(1))
    return F.struct(a.alias("before"), b.alias("after"), F.when(a > 0, F.round((b - a) / a, 6)).alias("part"))


def looks_like_json(text: Column) -> Column:
    return F.trim(text).rlike(r"(?s)^(\{.*\}|\[.*\])$")


def is_truncated(text: Column) -> Column:
    """Whether a text opens more brackets than it closes."""
    opened = F.length(F.regexp_replace(text, r"[^\[{]", ""))
    return opened > F.length(F.regexp_replace(text, r"[^\]}]", ""))


def change_reason(before: Column, after: Column) -> Column:
    """What the text after a correction has that the one before hasn't, joined by semicolons."""
    checks = {"adds a type": ": ", "adds error handling": "try", "waits": "await", "checks for null": "null"}
    found = [F.when(after.contains(mark) & ~before.contains(mark), F.lit(name)) for name, mark in checks.items()]
    return F.array_join(F.filter(F.array(*found), lambda x: x.isNotNull()), "; ")


def learned_signatures(log: DataFrame, tech: dict[str, list[str]], functional: dict[str, list[str]]) -> DataFrame:
    """tech, functional, commits: how many commits (message) name both, for each pair of the two small sets of labels."""
    named = lambda labels: F.filter(F.array(*(F.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.col("message").contains(w)), F.lit(name)) for name, words in labels.items())), lambda x: x.isNotNull())
    pairs = log.select(F.explode(named(tech)).alias("tech"), named(functional).alias("f")).select("tech", F.explode("f").alias("functional"))
    return pairs.groupBy("tech", "functional").agg(F.count("*").alias("commits"))

"""Readers and writers of the stores: logs of JSON records, rule texts, tables of signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.classify import stripped
from ..operators.memory import latest

FEEDBACK = "rule_id string, ts timestamp, feedback_type string, context string, user_rating int, user_id string, signal_text string"
SIGNALS = "text string, language string, pattern_type string, polarity string, confidence double, source string"


def read_feedback(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(FEEDBACK).json(path)


def append_feedback(feedback: DataFrame, path: str) -> None:
    feedback.write.mode("append").json(path)


def replayed(log: DataFrame, ident: str, position: str) -> DataFrame:
    """A log of whole records: the last one of each id stands."""
    return latest(log, [ident], [F.desc(position)])


def read_signals(spark: SparkSession, path: str) -> DataFrame:
    """The seed dictionary, a JSON array, or an object that holds it as `signals`."""
    raw = spark.read.text(path, wholetext=True)
    data = F.try_parse_json("value")
    rows = F.coalesce(F.try_variant_get(data, "$.signals", "array<variant>"), F.try_variant_get(data, "$", "array<variant>"))
    names = [f.split() for f in SIGNALS.split(", ")]
    return raw.select(F.explode(rows).alias("s")).select(*(F.try_variant_get("s", f"$.{n}", t).alias(n) for n, t in names))


def front_matter(content: Column) -> Column:
    """The `key: value` lines between the first two lines of dashes, as a map."""
    head = F.regexp_extract(content, r"(?s)^---\n(.*?)\n---", 1)
    lines = F.filter(F.split(head, "\n"), lambda x: x.contains(":"))
    entries = F.transform(lines, lambda x: F.struct(F.trim(F.substring_index(x, ":", 1)), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    return F.map_from_entries(entries)


def section(content: Column, title: str) -> Column:
    """The text of a `## title` section."""
    return F.trim(F.regexp_extract(content, rf"(?s)##+ {title}\s*\n(.*?)(?=\n##|\z)", 1))


def bullets(text: Column) -> Column:
    return F.transform(F.regexp_extract_all(text, F.lit(r"(?m)^\s*[-*] (.+)$"), F.lit(1)), lambda x: F.trim(x))


def sections(content: Column) -> Column:
    """All `## title` sections as a map from title to text; of equal titles the first one counts."""
    parts = F.slice(F.split(F.concat(F.lit("\n"), content), r"\n#{2,3} "), 2, 1_000)
    entries = F.transform(parts, lambda p: F.struct(F.trim(F.substring_index(p, "\n", 1)).alias("k"), stripped(F.regexp_replace(p, r"(?s)^[^\n]*\n?", "")).alias("v")))
    fresh = F.filter(entries, lambda e: e["k"] != "")
    names = F.array_distinct(F.transform(fresh, lambda e: e["k"]))
    return F.map_from_arrays(names, F.transform(names, lambda n: F.element_at(F.filter(fresh, lambda e: e["k"] == n), 1)["v"]))


def parsed_rules(texts: DataFrame) -> DataFrame:
    """Rule texts (path, value) in parts: path, meta (map of the front matter), sections (map), description and steps."""
    text = F.col("value")
    return texts.select("path", front_matter(text).alias("meta"), sections(text).alias("sections"), section(text, "Description").alias("description"), bullets(section(text, "Steps")).alias("steps"))


def read_rules(spark: SparkSession, path: str) -> DataFrame:
    """Rule texts in Markdown below a folder, in parts."""
    files = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.md").text(path, wholetext=True)
    return parsed_rules(files.select(F.col("_metadata.file_path").alias("path"), "value"))


def save_index(rules: DataFrame, path: str) -> None:
    """Write the index of rules as JSON lines, in place of the one before."""
    rules.write.mode("overwrite").json(path)


def load_index(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).json(path)


def exported(rules: DataFrame, group: str) -> DataFrame:
    """Rules as lines of Markdown to be written as text: group, place, line; a heading for each group, the most certain rule first."""
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("confidence"), "rule_id"))
    line = F.concat(F.lit("- "), F.col("content"), F.lit(" ("), F.format_string("%.2f", "confidence"), F.lit(")"))
    heads = rules.select(F.col(group).alias("group")).distinct().select("group", F.lit(0).alias("place"), F.concat(F.lit("## "), F.col("group")).alias("line"))
    return heads.unionByName(rules.select(F.col(group).alias("group"), rank.alias("place"), line.alias("line")))


def next_rule_id(rules: DataFrame) -> Column | DataFrame:
    """One row: the id after the largest rule-NNN."""
    number = F.regexp_extract("rule_id", r"^rule-(\d+)$", 1)
    top = rules.agg(F.coalesce(F.max(F.when(number != "", number.cast("decimal(37,0)"))), F.lit(0)).alias("n"))
    following = (F.col("n") + 1).cast("string")
    return top.select(F.concat(F.lit("rule-"), F.when(F.col("n") < 999, F.lpad(following, 3, "0")).otherwise(following)).alias("rule_id"))


def repaired_json(text: Column) -> Column:
    """VARIANT of the JSON in a model's answer: fenced or bare, with trailing commas or single quotes; null if hopeless."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    body = F.when(fenced != "", fenced).otherwise(F.regexp_extract(text, r"(?s)([\[{].*[\]}])", 1))
    commas = F.regexp_replace(body, r",\s*([\]}])", "$1")
    quotes = F.regexp_replace(commas, r"'([^']*)'", '"$1"')
    return F.coalesce(F.try_parse_json(body), F.try_parse_json(commas), F.try_parse_json(quotes))


def recovered_array(text: Column) -> Column:
    """A JSON array that was cut off, closed after its last whole object: everything to the last `}` or `]` that leaves depth one."""
    marks = F.regexp_extract_all(text, F.lit(r'("(?:[^"\\]|\\.)*"?|[^"\[\]{}]+|[\[\]{}])'), F.lit(1))
    start = F.struct(F.lit(0).alias("depth"), F.lit(0).alias("at"), F.lit(0).alias("end"))

    def step(state: Column, mark: Column) -> Column:
        depth = state["depth"] + F.when(mark.isin("[", "{"), 1).when(mark.isin("]", "}"), -1).otherwise(0)
        at = state["at"] + F.length(mark)
        return F.struct(depth.alias("depth"), at.alias("at"), F.when(mark.isin("]", "}") & (depth <= 1), at).otherwise(state["end"]).alias("end"))

    folded = F.aggregate(marks, start, step)
    whole = F.substring(text, F.lit(1), folded["end"])
    return F.when(folded["depth"] == 0, text).when(folded["end"] == 0, "[]").otherwise(F.concat(whole, F.lit("]")))

"""Band, nearest, similarity and dictionary joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import fits, small, staged
from . import automaton

#: What belongs to a word, and what stands between two, where texts and patterns meet on words.
WORD, WORD_EDGE = r"[\p{L}\p{N}_]", r"[^\p{L}\p{N}_]+"


def band_join(left: DataFrame, right: DataFrame, key: str, at_left: str, at_right: str, width: int) -> DataFrame:
    """Pairs with equal keys less than `width` apart.

    Places are cut into buckets of `width`; a left row meets the bucket of its own and the two beside it, so
    a long key is not one task and pairs that are far apart are never made.
    """
    a = left.withColumn("_bucket", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda k: F.floor(F.col(at_left) / width) + k)))
    b = right.withColumn("_bucket", F.floor(F.col(at_right) / width))
    return a.join(b, [key, "_bucket"]).filter(F.abs(F.col(at_left) - F.col(at_right)) < width).drop("_bucket")


def nearest_before_or_after(left: DataFrame, right: DataFrame, key: str, left_id: str, right_id: str, left_ts: str, right_ts: str, parts: int | None = None) -> DataFrame:
    """For each left row the right row of the same key nearest in time; a tie goes to the smaller id.

    Both sides are laid out in ranges of key and time, so a key with most of the rows is many ranges (parts of them in all,
    the session's shuffle partitions if not given). In a range the nearest is the last one before or the first one
    after; what lies beyond a range comes from a small table of the ranges' ends, which holds the keys that reach
    over several ranges only: a row for each such key and range, at most two for each range.
    """
    a = left.select(key, F.col(left_ts).alias("ts"), F.col(left_id).alias("lid"), F.lit(None).cast(dict(right.dtypes)[right_id]).alias("rid"))
    b = right.select(key, F.col(right_ts).alias("ts"), F.lit(None).cast(dict(left.dtypes)[left_id]).alias("lid"), F.col(right_id).alias("rid"))
    both = a.unionByName(b).filter(F.col(key).isNotNull() & F.col("ts").isNotNull()).withColumn("mine", F.when(F.col("rid").isNotNull(), F.struct("ts", "rid")))
    parts = parts or int(both.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # The smallest id of equal times stands nearest on either side. The left id parts many rows of one time.
    last_first = F.col("rid").desc_nulls_last()
    placed = staged(both.repartitionByRange(parts, key, "ts", last_first, "lid").withColumn("_part", F.spark_partition_id()), "time_ranges")
    before = Window.partitionBy(key, "_part").orderBy("ts", last_first).rowsBetween(Window.unboundedPreceding, 0)
    after = Window.partitionBy(key, "_part").orderBy(F.desc("ts"), last_first).rowsBetween(Window.unboundedPreceding, 0)
    seen = placed.withColumn("p", F.last("mine", ignorenulls=True).over(before)).withColumn("n", F.last("mine", ignorenulls=True).over(after)).filter("lid IS NOT NULL")

    split = placed.groupBy(key).agg(F.min("_part").alias("lo"), F.max("_part").alias("hi")).filter("lo < hi").select(key)
    micros = F.unix_micros(F.col("ts"))
    ends = placed.join(F.broadcast(split), key).groupBy(key, "_part").agg(F.min_by("mine", F.when(F.col("rid").isNotNull(), F.struct(-micros, F.col("rid")))).alias("end"), F.min_by("mine", F.when(F.col("rid").isNotNull(), F.struct(micros, F.col("rid")))).alias("start"))
    order = Window.partitionBy(key).orderBy("_part")
    carried = staged(ends.select(
        key, "_part", F.last("end", ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, -1)).alias("cp"), F.first("start", ignorenulls=True).over(order.rowsBetween(1, Window.unboundedFollowing)).alias("cn"),
    ), "range_ends")
    # Equal times may stand on both sides of a range's border, so what is carried competes with what the range has.
    seen = seen.join(F.broadcast(carried), [key, "_part"], "left")
    away = lambda c: F.when(F.col(c).isNotNull(), F.struct(F.abs(F.unix_micros(F.col("ts")) - F.unix_micros(F.col(f"{c}.ts"))).alias("away"), F.col(f"{c}.rid").alias("rid")))
    seen = seen.withColumn("best", F.least(away("p"), away("n"), away("cp"), away("cn"))).filter("best IS NOT NULL")
    return seen.select(key, F.col("lid").alias(left_id), F.col("best.rid").alias(right_id), F.col("best.away").alias("micros_away"))


def edits_around(corrections: DataFrame, calls: DataFrame, results: DataFrame, reach: int = 10, within: int = 5) -> DataFrame:
    """What a file held before a correction and what it was changed to: session_id, line_number, file_name, before, after.

    corrections: session_id, line_number, context, which names a file; those that name none are left out. calls: session_id, line_number, tool_name,
    file_path, call_id, content. results: session_id, line_number, call_id, content.
    before: of the Read calls in the `reach` lines before whose path holds the file's name, the result (its content) of the
    nearest that has one within `within` lines; after: the content of the first Edit or Write of the file in
    the `reach` lines from the correction on. Several calls of a line count by their call_id, then by their content, results of one call by their line and content.

    The three kinds of events meet in buckets of lines of a session, so a long session is many tasks and events that are far apart never meet.
    """
    named = corrections.select("session_id", "line_number", F.regexp_extract("context", r"([a-zA-Z0-9_-]+\.[a-zA-Z]+)", 1).alias("file_name")).filter("file_name <> ''").distinct()
    named = staged(named, "corrections")
    reads, edits = calls.filter("tool_name = 'Read'"), calls.filter("tool_name IN ('Edit', 'Write')")
    ends = lambda rows, line, *more: rows.select("session_id", F.col("line_number").alias(line), *more)
    gave = band_join(ends(reads, "read_line", "call_id", "file_path"), ends(results, "result_line", F.col("call_id").alias("result_call"), "content"), "session_id", "read_line", "result_line", within + 1)
    gave = gave.filter("call_id = result_call and result_line > read_line").groupBy("session_id", "read_line", "call_id", "file_path").agg(F.min_by("content", F.struct("result_line", "content")).alias("held"))
    seen = band_join(named, gave, "session_id", "line_number", "read_line", reach + 1).filter(F.col("read_line").between(F.col("line_number") - reach, F.col("line_number") - 1) & F.col("file_path").contains(F.col("file_name")))
    key = ["session_id", "line_number", "file_name"]
    before = seen.groupBy(*key).agg(F.min_by("held", F.struct(-F.col("read_line"), F.col("call_id"), F.col("held"))).alias("before"))
    made = band_join(named, ends(edits, "edit_line", "call_id", "file_path", "content"), "session_id", "line_number", "edit_line", reach)
    made = made.filter((F.col("edit_line") >= F.col("line_number")) & F.col("file_path").contains(F.col("file_name")))
    after = made.groupBy(*key).agg(F.min_by("content", F.struct("edit_line", "call_id", "content")).alias("after"))
    return named.join(before, key, "left").join(after, key, "left")


def dictionary_matches(messages: DataFrame, signals: DataFrame, key: list[str], content: str) -> DataFrame:
    """Every signal found in a message: key, signal_id, pattern_type, confidence, hits (how often, overlapping ones too)."""
    return automaton.counts(messages, signals.select("text", "signal_id", "pattern_type", "confidence"), key, content)


def message_scores(matches: DataFrame, key: list[str]) -> DataFrame:
    """Per message: the dominant pattern type, and the confidence of all its signals together, .95 at most.

    Every occurrence counts with its signal's share of all occurrences, so a signal counts with the square
    of its number. The type with the largest sum is dominant, a tie goes to the first by name.
    """
    total = matches.groupBy(*key).agg(F.sum("hits").alias("total"))
    weight = F.col("confidence") * F.col("hits") * F.col("hits") / F.col("total")
    by_type = matches.join(total, key).groupBy(*key, "pattern_type").agg(F.round(F.sum(weight), 9).alias("weight"))
    best = by_type.groupBy(*key).agg(F.min(F.struct((-F.col("weight")).alias("minus"), "pattern_type")).alias("best"), F.sum("weight").alias("all"))
    return best.select(*key, F.col("best.pattern_type").alias("pattern_type"), F.round(F.least(F.lit(0.95), F.col("all")), 6).alias("confidence"))


def prefix_either_way(segments: DataFrame, request: DataFrame) -> DataFrame:
    """(segment, wanted) where one starts with the other; rows meet on their first character."""
    a = segments.withColumn("_c", F.substring("segment", 1, 1))
    b = request.withColumn("_c", F.substring("wanted", 1, 1))
    return a.join(F.broadcast(b), "_c").filter(F.col("segment").startswith(F.col("wanted")) | F.col("wanted").startswith(F.col("segment"))).drop("_c")


def containing(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """All pairs of a text and a pattern that it contains: the columns of both sides. Empty and null patterns are in no pair.

    Patterns that may be broadcast are looked for by an automaton in one pass over each text. Of more patterns, a
    word inside the pattern, between two others, stands as a whole word in every text that contains it, so
    texts meet them on the longest such word, and those without one by the automaton.
    """
    if fits(patterns.select(pattern)):
        return automaton.containing(texts, text, patterns, pattern)
    cut = F.regexp_replace(F.regexp_replace(pattern, rf"^{WORD}*", ""), rf"{WORD}*$", "")
    whole = F.array_sort(F.filter(F.split(cut, WORD_EDGE), lambda w: w != ""), lambda a, b: F.length(b) - F.length(a))
    anchored = patterns.withColumn("_anchor", F.get(whole, F.lit(0)))
    has, short = anchored.filter("_anchor is not null"), anchored.filter("_anchor is null").drop("_anchor")
    words = texts.withColumn("_anchor", F.explode(F.array_distinct(F.split(F.col(text), WORD_EDGE))))
    met = words.join(small(has), "_anchor").filter(F.col(text).contains(F.col(pattern))).drop("_anchor")
    return met.unionByName(automaton.containing(texts, text, short, pattern).select(met.columns))


def uncovered(patterns: DataFrame, rules: DataFrame, ident: str, width: int = 40) -> DataFrame:
    """Patterns (ident, pattern) whose first `width` characters stand in no rule_text and which hold no rule's first ones.

    An empty pattern stands in every rule's text, and an empty rule's text covers every pattern; a null one covers none.
    """
    p, r = F.lower(F.col("pattern")), F.lower(F.col("rule_text"))
    texts, said = patterns.select(ident, p.alias("_text")), rules.filter("rule_text is not null")
    heads = said.select(F.left(r, F.lit(width)).alias("_head")).distinct()
    own = patterns.select(ident, F.left(p, F.lit(width)).alias("_head"))
    covered = containing(texts, "_text", heads, "_head").select(ident).union(containing(said.select(r.alias("_text")).distinct(), "_text", own, "_head").select(ident))
    lengths = said.agg(F.min(F.length("rule_text"))).first()[0]
    if lengths is not None:
        covered = covered.union(texts.filter("_text is not null" if lengths == 0 else "_text = ''").select(ident))
    return patterns.join(covered.distinct(), ident, "left_anti")


def typed_references(rules: DataFrame, memories: DataFrame) -> DataFrame:
    """Rules (rule_id, sources) by how many of their source memories are known: normal, partially or fully orphaned, none."""
    refs = rules.select("rule_id", F.explode_outer("sources").alias("memory_id"))
    known = memories.select("memory_id").distinct().withColumn("known", F.lit(True))
    counts = refs.join(known, "memory_id", "left").groupBy("rule_id").agg(F.count("memory_id").alias("n_refs"), F.count("known").alias("n_known"))
    kind = F.when(F.col("n_refs") == 0, "no_references").when(F.col("n_known") == 0, "fully_orphaned").when(F.col("n_known") < F.col("n_refs"), "partially_orphaned").otherwise("normal")
    return counts.withColumn("reference_state", kind)

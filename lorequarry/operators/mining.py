"""Mining of patterns from messages: selection, occurrences, confidence, evolution."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import classify, scoring, text
from ..staging import small, staged

# How a continued session begins.
CONTINUED = r"(?i)this session is being continued from|summary below covers the earlier portion"


def user_messages(messages: DataFrame) -> DataFrame:
    return messages.filter((F.col("role") == "user") & ~F.col("content").rlike(CONTINUED))


def typed_messages(messages: DataFrame, keywords: dict[str, list[str]]) -> DataFrame:
    """A row for each message and pattern type whose keywords it holds, in either case."""
    types = [F.when(classify.any_word(F.col("content"), words), F.lit(kind)) for kind, words in sorted(keywords.items())]
    return user_messages(messages).withColumn("pattern_type", F.explode(text.present(*types)))


def described(messages: DataFrame, limit: int = 150) -> DataFrame:
    """Messages with a description and their fingerprint."""
    phrase = text.representative_phrase(F.trim(F.regexp_replace("content", r"\s+", " ")), limit)
    return messages.withColumn("description", phrase).withColumn("fingerprint", text.fingerprint(F.col("pattern_type"), F.col("description")))


def patterns(occurrences: DataFrame) -> DataFrame:
    """Patterns of (kind, description, session_id, ts, action, validated, keyword) rows with their confidence."""
    valid = F.count_if((F.col("action") == "explicit_correction") | ((F.col("kind") == "preference") & (F.col("action") == "accept")))
    found = occurrences.groupBy("kind", "description").agg(
        F.count("*").alias("n"), F.countDistinct("session_id").alias("sessions"), F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"),
        valid.alias("valid"), F.count_if("validated").alias("validated"), F.max("keyword").alias("keyword"),
    )
    span = scoring.days_between(F.col("last_seen"), F.col("first_seen"))
    confidence = scoring.pattern_confidence(F.col("kind"), F.col("n"), F.col("sessions"), span, F.col("valid"), F.col("validated"), F.col("keyword"))
    return found.withColumn("confidence", F.round(confidence, 6))


def evolution(occurrences: DataFrame) -> DataFrame:
    """Per fingerprint: first and last sight, sessions, occurrences, and a bonus for spread."""
    found = occurrences.groupBy("fingerprint").agg(F.min("ts").alias("first_seen"), F.max("ts").alias("last_seen"), F.countDistinct("session_id").alias("sessions"), F.count("*").alias("occurrences"))
    span = scoring.days_between(F.col("last_seen"), F.col("first_seen"))
    bonus = F.least(F.lit(0.2), F.col("sessions") * 0.05) + F.least(F.lit(0.1), span / 300)
    return found.withColumn("bonus", F.round(bonus, 6))


def prefiltered(messages: DataFrame, hints: list[str] = classify.SIGNS, threshold: float = 0.9) -> DataFrame:
    """Each user message with what becomes of it: kept for a sign, dropped as acknowledgement, too short or a duplicate, or kept.

    A duplicate has nearly the characters of the last message that was kept, so a session is folded in order:
    its messages stream through one task, which holds that one message only.
    """
    body = classify.stripped(F.coalesce(F.col("content"), F.lit("")))
    own = F.when(classify.any_match(body, hints), "hint").when(classify.acknowledgement(body), "acknowledgement").when(F.length(body) <= 2, "too_short")
    characters = lambda c: F.array_sort(F.array_distinct(F.filter(F.split(F.lower(c), ""), lambda x: x != "")))
    said = user_messages(messages).select("session_id", "line_number", own.alias("own"), characters(body).alias("mine"), characters(F.coalesce("content", F.lit(""))).alias("whole"))

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        session, last = None, None
        for batch in batches:
            verdicts = []
            for at, own, mine, whole in zip(*(batch.column(c).to_pylist() for c in ("session_id", "own", "mine", "whole")), strict=True):
                if at != session:
                    session, last = at, None
                verdict = own
                if own is None:
                    mine = set(mine)
                    verdict = "duplicate" if last and mine and len(mine & last) / len(mine | last) > threshold else "kept"
                if verdict in ("hint", "kept"):
                    last = set(whole)
                verdicts.append(verdict)
            yield pa.RecordBatch.from_arrays([batch.column("session_id"), batch.column("line_number"), pa.array(verdicts, pa.string())], ["session_id", "line_number", "verdict"])

    kinds = dict(said.dtypes)
    ordered = said.repartition("session_id").sortWithinPartitions("session_id", "line_number")
    return ordered.mapInArrow(fold, f"session_id {kinds['session_id']}, line_number {kinds['line_number']}, verdict string")


def keyword_frequency(rows: DataFrame, group: str, content: Column, k: int) -> DataFrame:
    """The k commonest words of each group, a tie going to the longer, then by name."""
    counts = rows.select(group, F.explode(content).alias("word")).groupBy(group, "word").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc("n"), F.desc(F.length("word")), "word"))
    return counts.withColumn("rank", rank).filter(F.col("rank") <= k)


def common_keywords(members: DataFrame, cluster: str, member: str, words: Column, part: float = 0.3) -> DataFrame:
    """Words that stand in at least `part` of a cluster's members.

    Words of a member with one row are counted where they are read; only those of members with several rows move, to be made distinct.
    """
    key, members = [cluster, member], members.dropna(subset=[cluster, member])
    rows = staged(members.groupBy(*key).agg(F.count("*").alias("rows")), "member_rows")
    sizes = rows.groupBy(cluster).agg(F.count("*").alias("size"))
    several = rows.filter("rows > 1").select(*key)
    each = lambda some: some.select(*key, F.explode(F.array_distinct(words)).alias("word"))
    counted = lambda some: some.groupBy(cluster, "word").agg(F.count("*").alias("n"))
    if several.limit(1).count():
        several = small(several)
        parts = counted(each(members.join(several, key, "left_anti"))).unionByName(counted(each(members.join(several, key, "left_semi")).distinct()))
        counts = parts.groupBy(cluster, "word").agg(F.sum("n").alias("n"))
    else:
        counts = counted(each(members))
    return counts.join(sizes, cluster).filter(F.col("n") >= F.greatest(F.lit(1), F.ceil(F.round(F.col("size") * part, 9)))).select(cluster, "word", "n")


# Texts that describe nothing, what makes a text technical, and the words that mark the sentences that matter.
REQUESTS = [
    r"(?i)^(请|能不能|帮我|可以吗|麻烦|帮忙)", r"(?i)^(can you|could you|please|help me|would you)", r"(?i)^(how do|how to|how can|what should|should i)", r"(?i)^(给我|看看|检查|分析一下)",
    r"(?i)(能不能|可以吗|好吗|行吗)\s*[?？]?\s*$", r"(?i)this session is being continued from", r"(?i)summary below covers the earlier portion", r"(?i)(帮忙梳理|请帮我|帮我看看)",
]
NOISE = [
    r"(?i)(Base directory|Context Usage|Session analyzed|Model:|Tokens:)", r"(?i)^(为什么|怎么|如何|what|why|how)\s*(还是不行|不work|doesn't work)", r"^\?+$|^[\?？]+.*[\?？]$", r"^/[/\w\-\.]+$",
    r"(?i)^[a-f0-9-]{8,36}$", r"(?i)^(error|failed|不行|问题)$", r"^\.\.\.", r"(?i)^(Consolidation|Analysis|Summary).*Results?$",
]
DETAIL = [
    r"[\w]+\(.*\)", r"[\w]+\.\w+", r"[\w]+::\w+", r"`[^`]+`", r"```", r"(?i)\w+\.(ts|js|tsx|jsx|py|java|go|rs|c|cpp|h|css|html|json|yaml|yml|md|sql)", r"(?i)src/|lib/|dist/|node_modules/",
    r"(?i)(function|method|class|interface|type|const|let|var|import|export|async|await)", r"(?i)(useState|useEffect|useCallback|useMemo|useRef)", r"(?i)(query|mutation|resolver|schema)", r"(?i)(endpoint|route|handler|middleware)",
    r"\w+_\w+", r"[a-z]+[A-Z]\w*",
]
CORRECTIVE_WORDS = ["应该", "不应该", "需要", "必须", "建议", "改成", "修改", "优化", "should", "shouldn't", "need to", "must", "recommend", "change to", "fix", "improve"]
PREFERENCE_WORDS = ["我们用", "我们使用", "团队", "约定", "规范", "习惯", "we use", "our team", "convention", "practice", "prefer"]


def description(content: Column, kind: Column, limit: int = 150) -> Column:
    """What a message says of a pattern of a kind: the sentences with the kind's words, else its first one; '' for requests and noise."""
    body = classify.stripped(content)
    found = F.filter(F.split(body, r"[。.!！\n]+"), lambda s: F.length(classify.stripped(s)) > 10)
    cut = lambda t: F.concat(F.left(t, F.lit(limit)), F.when(F.length(t) > limit, "...").otherwise(""))
    marked = F.when(kind.isin("anti-pattern", "performance", "security"), F.filter(found, lambda s: classify.any_word(s, CORRECTIVE_WORDS))).when(kind == "preference", F.filter(found, lambda s: classify.any_word(s, PREFERENCE_WORDS)))
    first = classify.stripped(F.get(found, F.lit(0)))
    useless = (F.length(body) < 30) | classify.any_match(body, REQUESTS) | classify.any_match(body, NOISE) | (~classify.any_match(body, DETAIL) & (kind != "preference")) | (F.size(found) == 0)
    return F.when(useless, "").when(F.size(marked) > 0, cut(F.array_join(marked, ". "))).when(F.length(first) > 15, cut(first)).otherwise("")


def evolved(least: int | None = None, sessions: int | None = None) -> Column:
    """Whether a pattern has been seen often enough, and in enough sessions."""
    test = F.lit(True)
    for column, value in (("occurrences", least), ("sessions", sessions)):
        test = test if value is None else test & (F.col(column) >= value)
    return test


def evolution_daily(occurrences: DataFrame) -> DataFrame:
    """Per fingerprint and day: occurrences and the highest confidence."""
    return occurrences.groupBy("fingerprint", F.to_date("ts").alias("day")).agg(F.count("*").alias("occurrences"), F.max("confidence").alias("confidence"))


def semantic_keywords(rows: DataFrame, ident: str, content: str, k: int) -> DataFrame:
    """The k words of each text nearest to it: cosine of a word's distinct character pairs and all pairs of the text's words; a tie goes to the longer word."""
    words = rows.select(ident, F.explode(text.words(F.col(content))).alias("word"))
    pairs = words.select(ident, "word", F.explode(text.char_ngrams(F.col("word"), 2)).alias("pair"))
    whole = pairs.groupBy(ident, "pair").agg(F.count("*").cast("double").alias("tf"))
    length = whole.groupBy(ident).agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("length"))
    each = pairs.distinct().join(whole, [ident, "pair"]).groupBy(ident, "word").agg(F.sum("tf").alias("dot"), F.count("*").alias("n")).join(length, ident)
    scored = each.select(ident, "word", F.round(F.col("dot") / (F.sqrt("n") * F.col("length")), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy(ident).orderBy(F.desc("score"), F.desc(F.length("word")), "word"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)

"""Weighted similarities of rules, patterns, labelled contents and messages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import text
from .classify import stripped

# Words that say nothing, in descriptions of rules and in messages, and groups of words on one topic.
RULE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "as", "is", "are", "was", "were", "be", "been", "being",
    "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "may", "might", "must", "can", "this", "that", "these", "those",
]
MESSAGE_STOP_WORDS = [
    "the", "a", "an", "and", "or", "but", "in", "on", "at", "to", "for", "of", "with", "by", "from", "up", "about", "into", "through", "is", "are",
    "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did", "will", "would", "should", "could", "can", "may", "might", "must",
]
TOPICS = [
    ["usestate", "useeffect", "usememo", "usecallback", "useref", "hooks", "hook"],
    ["sql", "query", "database", "查询", "数据库", "injection", "注入"],
    ["component", "组件", "jsx", "tsx", "react"],
    ["performance", "性能", "optimize", "优化", "slow", "慢"],
    ["security", "安全", "vulnerability", "漏洞", "xss", "csrf"],
]


def lowered(items: Column) -> Column:
    return F.array_distinct(F.transform(items, F.lower))


def meaningful_words(content: Column, stop: list[str] = RULE_STOP_WORDS) -> Column:
    """The distinct words of two characters and more that aren't stop words."""
    return F.array_distinct(F.filter(text.words(F.coalesce(content, F.lit(""))), lambda w: (F.length(w) >= 2) & ~w.isin(stop)))


def message_words(content: Column, stop: list[str] = MESSAGE_STOP_WORDS) -> Column:
    """The words of a message in order, without stop words and numbers."""
    return F.filter(text.words(F.coalesce(content, F.lit(""))), lambda w: (F.length(w) >= 2) & ~w.isin(stop) & ~w.rlike(r"^\d+$") & w.rlike(r"[a-zA-Z0-9一-鿿㐀-䶿]"))


def described_alike(a: Column, b: Column) -> Column:
    """Jaccard of the words of two descriptions; 0 if either is missing, 1 if neither has words."""
    empty = a.isNull() | b.isNull() | (a == "") | (b == "")
    return F.when(empty, 0.0).otherwise(text.jaccard_or_equal(meaningful_words(a), meaningful_words(b)))


def scenes_alike(a: list[Column], b: list[Column]) -> Column:
    """Mean Jaccard of the three axes of two scenes."""
    return sum((text.jaccard_or_equal(lowered(x), lowered(y)) for x, y in zip(a, b, strict=True)), F.lit(0.0)) / len(a)


def rules_alike(keywords: Column, scenes: Column, descriptions: Column, same_kind: Column) -> Column:
    return keywords * 0.5 + scenes * 0.3 + descriptions * 0.1 + F.when(same_kind, 1.0).otherwise(0.0) * 0.1


def merge_action(similarity: Column) -> Column:
    return F.when(similarity >= 0.80, "merge").when(similarity >= 0.75, "update-existing").otherwise("keep-separate")


def patterns_alike(keywords: Column, descriptions: Column, same_type: Column, contexts: Column) -> Column:
    return keywords * 0.4 + descriptions * 0.3 + F.when(same_type, 0.2).otherwise(0.0) + contexts * 0.1


def labelled_alike(signals: Column, a_length: Column, b_length: Column, a_confidence: Column, b_confidence: Column) -> Column:
    most = F.greatest(a_length, b_length)
    lengths = F.when(most > 0, 1 - F.abs(a_length - b_length) / most).otherwise(1.0)
    return signals * 0.7 + lengths * 0.1 + (1 - F.abs(a_confidence - b_confidence)) * 0.2


def topic_counts(words: Column, topics: list[list[str]] = TOPICS) -> Column:
    """How many distinct words of a message belong to each topic."""
    return F.array(*(F.size(F.array_intersect(words, F.array(*map(F.lit, t)))) for t in topics))


def topic_boost(a: Column, b: Column) -> Column:
    """The largest share, smaller over larger count, of a topic that both have (topic_counts)."""
    return F.array_max(F.zip_with(a, b, lambda x, y: F.when((x > 0) & (y > 0), F.least(x, y) / F.greatest(x, y)).otherwise(0.0)))


def sentences(content: Column, least: int) -> Column:
    """The sentences or points of a text that are longer than `least`."""
    return F.filter(F.transform(F.split(content, r"[.!?]\s+|\n[-*]\s+"), stripped), lambda s: F.length(s) > least)

"""Scores of a rule's text: clarity, specificity, actionability, technical relevance, structure, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .scoring import clamp
from .text import present

# The words that raise or lower a score, in two languages, and what each is worth.
VAGUE = ["maybe", "possibly", "sometimes", "might", "could", "也许", "可能", "或许", "大概", "有时", "尽量"]
TERMS = ["useeffect", "async/await", "props", "state", "component", "api", "database", "query", "function", "class", "组件", "状态", "函数", "类", "数据库", "查询", "接口", "异步", "渲染", "钩子", "模块"]
GENERAL = ["always", "never", "everything", "all", "any", "总是", "从不", "所有", "任何", "全部", "一切"]
VERBS = ["use", "avoid", "prefer", "ensure", "check", "validate", "wrap", "extract", "refactor", "implement", "使用", "避免", "优先", "确保", "检查", "验证", "封装", "提取", "重构", "实现", "采用"]
CODE_WORDS = [
    "function", "class", "method", "api", "endpoint", "component", "hook", "module", "import", "export", "async", "await", "promise", "type", "interface", "query",
    "database", "test", "build", "deploy", "docker", "kubernetes", "cache", "typescript", "javascript", "python", "react", "vue", "node", "sql", "graphql", "http", "rest",
]
ISSUES = [("clarity", 0.5, "Rule description is unclear or vague", "Add specific examples or code snippets"), ("specificity", 0.4, "Rule is too general", "Add context about when and where this rule applies"), ("actionability", 0.4, "Rule doesn't provide clear action", "Use imperative verbs and provide concrete steps")]
LOW_CONFIDENCE = ("Low confidence score", "Need more evidence (occurrences or validation)")
NO_KEYWORDS = "Consider adding keywords for better matching"


def hits(text: Column, words: list[str]) -> Column:
    """How many of the words stand in a lower-case text."""
    return sum((F.when(text.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def worth(test: Column, value: float) -> Column:
    return F.when(test, value).otherwise(0.0)


def clarity(content: Column) -> Column:
    low = F.lower(content)
    shown = content.contains("```") | content.contains("Example:") | content.contains("示例") | content.contains("例子")
    return clamp(
        1.0 - hits(low, VAGUE) * 0.21 - worth(F.length(content) < 20, 0.3) - worth((F.length(content) > 500) & ~content.contains("\n"), 0.2)
        + worth(shown, 0.1) + worth(content.rlike(r"(?m)^[-*]\s") | content.rlike(r"(?m)^\d+\.\s"), 0.15)
    )


def specificity(content: Column, meta: Column) -> Column:
    """meta: whether the text is about the assistant itself."""
    low = F.lower(content)
    return clamp(0.5 - worth(meta, 0.5) + hits(low, TERMS) * 0.05 + worth(low.contains("/") | low.contains(".ts"), 0.1) - hits(low, GENERAL) * 0.05)


def actionability(content: Column) -> Column:
    low = F.lower(content)
    instead = low.contains("instead of") | low.contains("rather than") | low.contains("而不是") | low.contains("而非")
    return clamp(0.5 + hits(low, VERBS) * 0.08 + worth(instead, 0.15) + worth(low.rlike(r"\d+\.\s"), 0.1))


def technical_relevance(content: Column, labels: Column) -> Column:
    """How much a text is about code: its words, its labels (keywords and technologies), files and code blocks."""
    low = F.lower(content)
    named = F.size(F.filter(labels, lambda t: (F.length(t) > 1) & t.rlike(r"(?i)[a-z0-9+#]")))
    placed = low.contains("```") | low.rlike(r"\.\w{1,4}\b") | low.contains("/")
    return clamp(F.least(hits(low, CODE_WORDS) * 0.1, F.lit(0.6)) + F.least(named * 0.05, F.lit(0.25)) + worth(placed, 0.15))


def scene_completeness(*axes: Column) -> Column:
    """The part of the axes (arrays) that have a value."""
    return sum((F.when(F.size(a) > 0, 1).otherwise(0) for a in axes), F.lit(0)) / len(axes)


def assessed(content: Column, keywords: Column, confidence: Column, meta: Column) -> Column:
    """struct(clarity, specificity, actionability, overall, issues, suggestions)."""
    scores = {"clarity": clarity(content), "specificity": specificity(content, meta), "actionability": actionability(content)}
    tests = [F.round(scores[name], 9) < least for name, least, _, _ in ISSUES] + [confidence < 0.4]
    listed = lambda texts, more: present(*(F.when(t, F.lit(x)) for t, x in zip(tests, texts, strict=True)), *more)
    overall = scores["clarity"] * 0.4 + scores["specificity"] * 0.3 + scores["actionability"] * 0.3
    bare = F.when(F.size(F.coalesce(keywords, F.array().cast("array<string>"))) == 0, F.lit(NO_KEYWORDS))
    return F.struct(
        *(F.round(c, 6).alias(n) for n, c in scores.items()), F.round(overall, 6).alias("overall"),
        listed([*(i[2] for i in ISSUES), LOW_CONFIDENCE[0]], []).alias("issues"), listed([*(i[3] for i in ISSUES), LOW_CONFIDENCE[1]], [bare]).alias("suggestions"),
    )


def unified(evidence: Column, content: Column, meta: Column, scope: Column, technical: Column, scenes: Column) -> Column:
    """The score that decides on a rule. Support by memories is shown beside it and has no weight."""
    return (
        clamp(evidence) * 0.25 + clarity(content) * 0.15 + specificity(content, meta) * 0.15 + actionability(content) * 0.15
        + clamp(scope) * 0.10 + technical * 0.15 + scenes * 0.05
    )


def structure(description: Column, reason: Column, steps: Column, good: Column, bad: Column, content: Column) -> Column:
    """Score of a written rule by its parts; steps is an array, good and bad are the first example's halves."""
    d = F.length(description)
    described = (
        F.when(description.isNull() | (description == ""), 0.0).when(description.contains("...") | description.contains("…"), 0.05)
        .when(description.rlike(r"[^\x00-\x7F]{3,}") & ~description.rlike(r"[一-龥]{3,}"), 0.05)
        .when(description.rlike(r"<[^>]+>") | description.rlike(r"\{[\"\w]+:"), 0.1).when(d < 50, 0.1).when(d.between(100, 500), 0.3).otherwise(0.2)
    )
    counted = reason.contains("Corrected") & reason.contains("times in") & (F.length(reason) < 100)
    reasoned = F.when(reason.isNull() | (reason == ""), 0.0).when(counted, 0.05).when((F.length(reason) >= 50) & ~reason.contains("..."), 0.2).when(F.length(reason) >= 20, 0.1).otherwise(0.0)
    concrete = F.exists(steps, lambda s: (F.length(s) > 20) & (s.rlike(r"\w+\(") | s.rlike(r"`[^`]+`") | s.rlike(r"(?i)\b(check|verify|add|remove|use|call|import|export)\b")))
    n = F.size(steps)
    stepped = F.when(n <= 0, 0.0).when(concrete & (n >= 3), 0.2).when(n >= 2, 0.1).otherwise(0.05)
    shown = F.when((F.length(good) > 20) & ~good.contains("..."), 0.15 + worth(F.length(bad) > 20, 0.05)).otherwise(0.0)
    heads = content.rlike(r"(?m)^#{1,3}\s+\w+")
    formed = F.when(heads & (content.rlike(r"(?m)^[*\-]\s+\w+") | content.rlike(r"```\w*\n")), 0.1).when(heads, 0.05).otherwise(0.0)
    return described + reasoned + stepped + shown + formed


def cleanup_score(keywords: Column, has_scene: Column, description: Column, confidence: Column, least: tuple[int, int, float] = (3, 30, 0.5)) -> Column:
    """struct(score, issues) of a stored rule; least: its keywords, characters of its description, and confidence."""
    tests = [(F.size(keywords) < least[0], 0.15, "low-keywords"), (~has_scene, 0.25, "missing-scene"), (F.length(description) < least[1], 0.2, "weak-description"), (confidence < least[2], 0.3, "low-confidence")]
    score = F.greatest(F.lit(0.0), 1.0 - sum((worth(t, v) for t, v, _ in tests), F.lit(0.0)))
    found = present(*(F.when(t, F.lit(name)) for t, _, name in tests))
    return F.struct(F.round(score, 6).alias("score"), found.alias("issues"))

"""The generic text of a rule that a pattern leads to, by the family of its description."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The families in the order in which they are tried, and the words that stand for them.
API_WORDS = ["替换", "replace", "隐藏", "hide", "expose", "暴露", "wrapper", "封装"]
API_COMPARED = ["比较", "compare", "调用"]
WORKFLOW_WORDS = ["状态", "state", "workflow", "流程", "transition", "转移", "status"]
REFACTORING_WORDS = ["优化", "optimize", "refactor", "重构", "拆分", "split", "模块化", "modular"]
SPLIT_WORDS = ["拆分", "split", "模块"]
CONFIG_WORDS = ["setup", "安装", "config", "配置", "claude.md", "script", "脚本"]
ERROR_WORDS = ["error", "错误", "exception", "异常", "fix", "修复", "bug"]
ACTIONS = [r"应该([一-龥]+)", r"需要([一-龥]+)", r"(?i)must ([\w\s]+)", r"(?i)should ([\w\s]+)", r"(?i)always ([\w\s]+)", r"(?i)never ([\w\s]+)"]

#: What a rule of a family says; callers may give their own.
GUIDANCE = {
    "api": "Wrap the lower call once, let every caller use the wrapper, and keep what it wraps internal.",
    "workflow": "Change a state through its checked transition only, and give every lock a way to be released.",
    "modules": "Cut code along its duties, give each part a clear interface, and keep the old one working meanwhile.",
    "speed": "Measure before and after, and work on the slowest path first.",
    "setup": "Put changes of a configuration into the setup, and let it run again without harm.",
    "configuration": "Write down a change of the configuration with an example and the reason for it.",
    "errors": "Read the whole message, find the cause, and mend that instead of what shows.",
}


def _any(text: Column, words: list[str]) -> Column:
    found = F.lit(False)
    for w in words:
        found = found | text.contains(w)
    return found


def family(description: Column) -> Column:
    """api, workflow, modules, speed, setup, configuration, errors, or generic; the first that fits. Case is ignored where the words of a family are looked for."""
    d, low = F.coalesce(description, F.lit("")), F.lower(F.coalesce(description, F.lit("")))
    return (
        F.when(_any(low, API_WORDS) & _any(d, API_COMPARED), "api").when(_any(low, WORKFLOW_WORDS), "workflow")
        .when(_any(low, REFACTORING_WORDS), F.when(_any(d, SPLIT_WORDS), "modules").otherwise("speed"))
        .when(_any(low, CONFIG_WORDS), F.when(low.contains("setup") | d.contains("脚本"), "setup").otherwise("configuration"))
        .when(_any(low, ERROR_WORDS), "errors").otherwise("generic")
    )


def action(sentence: Column) -> Column:
    """The first word of what a sentence says must, should, always or never be done; null if it says nothing of it."""
    found = [F.regexp_extract(sentence, p, 1) for p in ACTIONS]
    return F.coalesce(*(F.when(f != "", F.element_at(F.split(F.trim(f), r"[\s,，]"), 1)) for f in found))


def generic_text(description: Column, kind: Column, guidance: dict[str, str] | None = None) -> Column:
    """The text of a rule: its family's guidance, else the action that its first sentence names, else that sentence."""
    own = guidance or GUIDANCE
    name = family(description)
    first = F.substring(F.element_at(F.split(F.coalesce(description, F.lit("")), "[。，,;；]"), 1), 1, 200)
    said = action(first)
    title = F.concat(F.lit("**"), F.upper(F.substring(kind, 1, 1)), F.substring(kind, 2, 1 << 20), F.lit(" Pattern**\n\n"))
    cut = F.concat(F.substring(first, 1, 150), F.when(F.length(first) > 150, "...").otherwise(""))
    other = F.concat(title, F.when(said.isNotNull(), F.concat(F.lit("Core principle: "), said)).otherwise(cut))
    text = other
    for key, value in own.items():
        text = F.when(name == key, value).otherwise(text)
    return text


def whole_text(description: Column, kind: Column, contexts: Column, evidence: Column, guidance: dict[str, str] | None = None) -> Column:
    """generic_text with what it applies to (the last parts of the first three paths, sorted), the beginning of a long description, and three pieces of evidence."""
    names = F.array_distinct(F.transform(F.filter(contexts, lambda c: c.contains("/")), lambda c: F.regexp_extract(c, "([^/]*)$", 1)))
    applies = F.array_join(F.array_sort(F.slice(names, 1, 3)), ", ")
    pieces = F.array_join(F.transform(F.slice(evidence, 1, 3), lambda e, i: F.concat(F.lit("  "), (i + 1).cast("string"), F.lit('. "'), F.substring(e, 1, 200), F.lit('"'))), "\n")
    return F.concat(
        generic_text(description, kind, guidance), F.when(F.size(names) > 0, F.concat(F.lit("\n\n**Applies to**: "), applies)).otherwise(""),
        F.when(F.length(description) > 100, F.concat(F.lit("\n\n**Example context**: "), F.substring(description, 1, 150), F.lit("..."))).otherwise(""),
        F.when(F.size(evidence) > 0, F.concat(F.lit("\n\n**Original evidence**:\n"), pieces)).otherwise(""),
    )

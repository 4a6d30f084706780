"""Gates that class texts by patterns and dictionaries. The dictionaries are arguments with defaults."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import present

# The patterns of the cognitive classes and of sensitive content.
ONE_TIME = [
    r"(?i)^(请|能不能|帮我|可以吗|麻烦|帮忙)",
    r"(?i)^(can you|could you|please|help me|would you)",
    r"(?i)^(how do|how to|how can|what should|should i)",
    r"(?i)^(给我|看看|检查|分析一下)",
    r"(?i)(能不能|可以吗|好吗|行吗)\s*[?？]?\s*$",
    r"(?i)this session is being continued from",
    r"(?i)summary below covers the earlier portion",
    r"(?i)^(为什么|怎么|如何|what|why|how)\s",
    r"(?i)^(帮我看看|帮忙梳理|请帮我)",
    r"(?i)^(ok|okay|好的|收到|明白|got it|thanks|thank you)",
]
PREFERENCE = [
    r"(我们团队|团队习惯|我更喜欢|我们约定|约定|规范|习惯|我们一般用|我们总是|以后都)",
    r"(?i)(we prefer|our team|we use|convention|we always|our practice|our convention)",
]
CORRECTIVE = [
    r"(需要|应该|必须|改成|修改|添加|使用|不要|避免|别用|记得|务必)",
    r"(?i)(need to|should|must|change to|modify|add|use|fix|prevent|don't|avoid|never|remove|remember to|always)",
]
TECHNICAL = [
    r"[\w]+\(.*\)",
    r"[\w]+\.\w+",
    r"`[^`]+`",
    r"(?i)\w+\.(ts|js|tsx|jsx|py|java|go|rs|c|cpp|h|css|html|json|yaml|yml|md|sql)",
    r"(?i)(function|method|class|interface|type|const|let|var|import|export|async|await|return|useState|useEffect|def|public|private|static)",
    r"(?i)(query|mutation|endpoint|route|handler|middleware|schema|component|service|module)",
    r"(循环|对象|实例|函数|方法|接口|类|模块|组件|缓存|数据库|数据表|索引|线程|进程|内存|堆|栈|队列|锁|并发|异步|同步|请求|响应|服务|部署|构建|编译|测试|配置|日志|异常|错误|性能|优化|路由|中间件|消息|事件|状态|参数|变量|类型|泛型|正则|协议|端口|域名|证书|密钥|令牌|算法|编码|解码|序列化)",
    r"(?i)(GC|CPU|GPU|I/O|IO|SQL|API|JSON|XML|HTTP|HTTPS|TCP|UDP|RPC|REST|GraphQL|OAuth|JWT)",
]
SENSITIVE = [
    r"(?i)sk-[a-zA-Z0-9]{20,}",
    r"AKIA[0-9A-Z]{16}",
    r"ghp_[a-zA-Z0-9]{36}",
    r"""(?i)(api[_-]?key|secret|token|password|passwd|access[_-]?key|private[_-]?key|私钥|密钥)\s*[:=]\s*["']?[^\s"']{4,}""",
    r"(?i)(?:https?|postgres|postgresql|mysql|mongodb|mongodb\+srv|redis|ftp|amqp)://[^\s:@]+:[^\s:@]+@",
    r"(C:\\[^\s]+|/home/[^\s]+|/Users/[^\s]+)",
    r"(192\.168\.|10\.\d+\.|172\.(1[6-9]|2\d|3[01])\.)",
    r"(?i)(localhost|127\.0\.0\.1)",
]


def any_match(text: Column, patterns: list[str]) -> Column:
    out = F.lit(False)
    for p in patterns:
        out = out | text.rlike(p)
    return out


def any_word(text: Column, words: list[str]) -> Column:
    """Whether a word stands anywhere in the text, in either case."""
    low = F.lower(text)
    out = F.lit(False)
    for w in words:
        out = out | low.contains(w.lower())
    return out


def info_class(text: Column, one_time=ONE_TIME, preference=PREFERENCE, corrective=CORRECTIVE, technical=TECHNICAL) -> Column:
    """one-time, preference, experience (corrective and technical) or fact (technical); one-time if nothing fits."""
    t = stripped(F.coalesce(text, F.lit("")))
    fixes, details = any_match(t, corrective), any_match(t, technical)
    return F.when(any_match(t, one_time), "one-time").when(any_match(t, preference), "preference").when(fixes & details, "experience").when(details, "fact").otherwise("one-time")


def sensitive(text: Column, patterns=SENSITIVE) -> Column:
    return any_match(F.coalesce(text, F.lit("")), patterns)


# Words that are only found whole, as they stand inside others.
WHOLE_WORDS = {"go", "c", "r", "sql", "api", "ci"}
# What holds for the moment only.
EPHEMERAL = [
    r"(?i)(build failed|编译失败|构建失败|临时|temporary|for now|目前|本次|this time|一次性的)",
    r"(?i)(端口|port)\s*\d+",
    r"(?i)(今天|today|刚才|just now)",
]
# Small talk, and the signs of a message that says something.
ACKNOWLEDGEMENT = r"(?i)^(ok|okay|好的|好|嗯|对|是的|yes|yeah|yep|👍|ok!|fine|sure|got it|noted)\.?\s*$"
SIGNS = [
    r"```",
    r"`[^`]+`",
    r"\b(function|class|import|export|const|let|var|def|public|private|async|await)\b",
    r"\/(?:[\w.-]+\/)*[\w.-]+\.\w{1,6}",
    r"(?i)(fix|bug|error|wrong|incorrect|应该|不对|改成|修正|错误|问题|prefer|convention|约定|规范|optimize|性能|security|安全)",
]
# Phrases of texts about the assistant itself. Names of a tool are the caller's to add.
META_PHRASES = [
    "strictly follow the rules", "strictly follow rules", "follow the defined rules", "adhere to the defined rules", "adhere to the rules",
    "complete multi-step tasks", "completing multi-step tasks", "after completing multi-step tasks", "system prompt", "system prompt says",
    "you are an ai", "you are a helpful ai", "as an ai assistant", "as an ai language model", "memory support", "memory support value",
    "meta-instruction", "meta instruction",
    "严格遵循规则", "严格遵循既定规则", "遵循既定规则", "遵循既定的规则", "完成多步任务", "在完成多步任务后", "在完成多步任务之前", "系统提示", "系统提示词",
    "作为ai", "作为人工智能", "作为助手", "记忆支持", "记忆支持值", "元指令", "关于工具本身", "关于自身", "助手自身的规范", "自身的规范", "学习器", "本工具自身",
]
SELF_PHRASES = [
    "the rule itself", "this rule itself", "the system itself", "the assistant's own", "the assistant itself", "the tool itself", "our own guidelines", "about itself", "the learner",
    "规则本身", "本规则", "本系统", "本工具", "本助手", "元规则", "关于自身", "关于工具自身",
]
# Names that make a pattern one of a project.
FRAMEWORK = r"(?i)^(react|vue|angular|typescript|javascript|python|node|express|prisma|graphql|postgres|mysql|sqlite|django|flask|spring|kotlin|go|rust|java)\b"
# Technical context and corrective words of messages on security.
SECURITY_CONTEXT = [
    r"(?i)(validate|sanitize|escape|filter)\s+(\w+|input|output|data|parameter)",
    r"(?i)(prepared statement|parameterized query|sql parameter|query builder)",
    r"(?i)(innerHTML|dangerouslySetInnerHTML|DOM manipulation|script tag)",
    r"(?i)(jwt|token|session|auth|permission|role|access control)",
    r"(?i)(encrypt|decrypt|hash|bcrypt|crypto|salt)",
    r"(?i)\w+\.(escape|sanitize|validate|filter)\(",
    r"(?i)(if|check|verify)\s+.*\s+(auth|permission|valid|safe)",
]
SECURITY_CORRECTIVE = [r"(需要|应该|必须|改成|修改|添加|使用)", r"(?i)(need to|should|must|change to|modify|add|use|fix|prevent)", r"(不要|别用|避免)", r"(?i)(don't|avoid|never|remove)"]
# Texts of the system that are no labelled content.
SYSTEM_TEXT = [r"(?i)^Base directory for this skill:", r"(?i)^<command-", r"(?i)/Users/[^/]+/\.claude/", r"(?i)^/Users/[^/]+/\.config/"]
# Signals that say nothing.
GENERIC_SIGNAL = [r"(?i)^(is|are|the|a|an|this|that|these|those)$", r"^[.,!?;:]$", r"^[\d\s]+$"]


def stripped(text: Column) -> Column:
    """The text without white space at its ends."""
    return F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))


def word_hits(text: Column, words: list[str]) -> Column:
    """How many of the words stand in a lower-case text; short ones only as whole words."""
    return sum((F.when(text.rlike(rf"\b{w}\b") if w in WHOLE_WORDS else text.contains(w), 1).otherwise(0) for w in words), F.lit(0))


def content_category(text: Column, code: list[str], business: list[str], reject: float = 0.6, pure: float = 0.3) -> Column:
    """struct(category, allowed): by the business part of the dictionary words found; without any it is general."""
    low = F.lower(F.coalesce(text, F.lit("")))
    c, b = word_hits(low, [w.lower() for w in code]), word_hits(low, [w.lower() for w in business])
    ratio = F.when(c + b > 0, b / (c + b))
    category = F.when(c + b == 0, "general").when(ratio > reject, "business").when(ratio <= pure, "code").otherwise("mixed")
    return F.struct(category.alias("category"), (F.coalesce(ratio, F.lit(0.0)) <= reject).alias("allowed"))


def write_gate(text: Column, allowed: Column, given: Column | None = None) -> Column:
    """First reason not to keep a statement (one-time, non-code-content, not-reusable), or keep. given: its class, where known."""
    kind = info_class(text) if given is None else F.coalesce(given, info_class(text))
    return F.when(kind == "one-time", "one-time").when(~allowed, "non-code-content").when(any_match(text, EPHEMERAL), "not-reusable").otherwise("keep")


def acknowledgement(text: Column) -> Column:
    """Whether a message only confirms."""
    return stripped(text).rlike(ACKNOWLEDGEMENT)


def meta(text: Column, phrases: list[str] = META_PHRASES + SELF_PHRASES) -> Column:
    """Whether a text is about the assistant itself."""
    return any_word(F.coalesce(text, F.lit("")), phrases)


def meta_reasons(text: Column, phrases: list[str] = META_PHRASES, own: list[str] = SELF_PHRASES) -> Column:
    """The phrases about the assistant itself that a text holds, each with its kind."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = [F.when(low.contains(p.lower()), F.lit(f"{kind}:{p}")) for kind, words in (("meta-phrase", phrases), ("self-ref", own)) for p in words]
    return present(*found)


def generality_discount(paths: Column, keywords: Column) -> Column:
    """1 for a pattern of a project or a named framework, else .85."""
    own = (F.size(F.coalesce(paths, F.array().cast("array<string>"))) > 0) | F.exists(keywords, lambda k: k.rlike(FRAMEWORK))
    return F.when(own, 1.0).otherwise(0.85)


def security_message(text: Column, specific: list[str], generic: list[str]) -> Column:
    """The keyword that makes a message one on security, else null: a specific one, or a generic one with technical and corrective words."""
    low = F.lower(text)
    first = lambda words: F.coalesce(*(F.when(low.contains(w), F.lit(w)) for w in words))
    return F.coalesce(first(specific), F.when(any_match(text, SECURITY_CONTEXT) & any_match(text, SECURITY_CORRECTIVE), first(generic)))


def labelled_content(text: Column) -> Column:
    """Whether a text may be stored as labelled content."""
    return ~any_match(F.coalesce(text, F.lit("")), SYSTEM_TEXT)


def valid_signal(text: Column, confidence: Column) -> Column:
    """Whether a proposed signal may enter the dictionary."""
    return F.length(text).between(2, 50) & confidence.between(0.5, 0.8) & text.rlike(r"[\w一-龥]") & ~any_match(stripped(text), GENERIC_SIGNAL)

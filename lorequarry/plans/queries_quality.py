"""Queries: quality of rules, audits, gates, classes of texts. The SQL states its word lists itself."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import classify, quality, text
from ..operators import listing, mining, rules, stats
from ..staging import spread
from . import adapters as a

QUERIES, ORACLE_SQL = {}, {}
VAGUE = "['maybe', 'possibly', 'sometimes', 'might', 'could', '也许', '可能', '或许', '大概', '有时', '尽量']"
TERMS = "['useeffect', 'async/await', 'props', 'state', 'component', 'api', 'database', 'query', 'function', 'class', '组件', '状态', '函数', '类', '数据库', '查询', '接口', '异步', '渲染', '钩子', '模块']"
GENERAL = "['always', 'never', 'everything', 'all', 'any', '总是', '从不', '所有', '任何', '全部', '一切']"
VERBS = "['use', 'avoid', 'prefer', 'ensure', 'check', 'validate', 'wrap', 'extract', 'refactor', 'implement', '使用', '避免', '优先', '确保', '检查', '验证', '封装', '提取', '重构', '实现', '采用']"
CODE = "['function', 'class', 'method', 'api', 'endpoint', 'component', 'hook', 'module', 'import', 'export', 'async', 'await', 'promise', 'type', 'interface', 'query', 'database', 'test', 'build', 'deploy', 'docker', 'kubernetes', 'cache', 'typescript', 'javascript', 'python', 'react', 'vue', 'node', 'sql', 'graphql', 'http', 'rest']"


def _hits(words: str, column: str = "low") -> str:
    return f"len(list_filter({words}, lambda w: contains({column}, w)))"


CLARITY = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, 1.0 - {_hits(VAGUE)} * 0.21::DOUBLE - CASE WHEN length(content) < 20 THEN 0.3 ELSE 0 END - CASE WHEN length(content) > 500 AND NOT contains(content, chr(10)) THEN 0.2 ELSE 0 END
    + CASE WHEN contains(content, '```') OR contains(content, 'Example:') OR contains(content, '示例') OR contains(content, '例子') THEN 0.1 ELSE 0 END
    + CASE WHEN regexp_matches(content, '(?m)^[-*]\\s') OR regexp_matches(content, '(?m)^\\d+\\.\\s') THEN 0.15 ELSE 0 END))"""
SPECIFICITY = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 - CASE WHEN contains(low, 'you are an ai') THEN 0.5 ELSE 0 END + {_hits(TERMS)} * 0.05::DOUBLE
    + CASE WHEN contains(low, '/') OR contains(low, '.ts') THEN 0.1 ELSE 0 END - {_hits(GENERAL)} * 0.05::DOUBLE))"""
ACTION = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, 0.5 + {_hits(VERBS)} * 0.08::DOUBLE + CASE WHEN regexp_matches(low, 'instead of|rather than|而不是|而非') THEN 0.15 ELSE 0 END + CASE WHEN regexp_matches(low, '\\d+\\.\\s') THEN 0.1 ELSE 0 END))"""
TECHNICAL = f"""greatest(0.0::DOUBLE, least(1.0::DOUBLE, least({_hits(CODE)} * 0.1::DOUBLE, 0.6) + least(len(list_filter(list_append(keywords, tech), lambda t: length(t) > 1 AND regexp_matches(t, '(?i)[a-z0-9+#]'))) * 0.05::DOUBLE, 0.25)
    + CASE WHEN contains(low, '```') OR regexp_matches(low, '\\.\\w{{1,4}}\\b') OR contains(low, '/') THEN 0.15 ELSE 0 END))"""
SCORED = f"{a.RULES}, lw AS (SELECT *, lower(content) AS low FROM rules), sc AS (SELECT *, {CLARITY} AS clarity, {SPECIFICITY} AS specificity, {ACTION} AS actionability, {TECHNICAL} AS technical FROM lw)"

QUERIES["rule_quality"] = lambda s, d: spread(a.rules(s, d)).select("rule_id", quality.assessed(F.col("content"), F.col("keywords"), F.col("confidence"), classify.meta(F.col("content"))).alias("q")).select(
    "rule_id", "q.clarity", "q.specificity", "q.actionability", "q.overall", F.array_join("q.issues", "; ").alias("issues"), F.array_join("q.suggestions", "; ").alias("suggestions")
)
ORACLE_SQL["rule_quality"] = f"""
    WITH {SCORED} SELECT rule_id, round(clarity, 6) AS clarity, round(specificity, 6) AS specificity, round(actionability, 6) AS actionability, round(clarity * 0.4 + specificity * 0.3 + actionability * 0.3, 6) AS overall,
        array_to_string(list_filter([CASE WHEN round(clarity, 9) < 0.5 THEN 'Rule description is unclear or vague' END, CASE WHEN round(specificity, 9) < 0.4 THEN 'Rule is too general' END,
            CASE WHEN round(actionability, 9) < 0.4 THEN 'Rule doesn''t provide clear action' END, CASE WHEN confidence < 0.4 THEN 'Low confidence score' END], lambda x: x IS NOT NULL), '; ') AS issues,
        array_to_string(list_filter([CASE WHEN round(clarity, 9) < 0.5 THEN 'Add specific examples or code snippets' END, CASE WHEN round(specificity, 9) < 0.4 THEN 'Add context about when and where this rule applies' END,
            CASE WHEN round(actionability, 9) < 0.4 THEN 'Use imperative verbs and provide concrete steps' END, CASE WHEN confidence < 0.4 THEN 'Need more evidence (occurrences or validation)' END], lambda x: x IS NOT NULL), '; ') AS suggestions FROM sc"""


def _overall():
    content = F.col("content")
    labels = F.concat(F.col("keywords"), F.array("tech"))
    return quality.unified(F.col("confidence"), content, classify.meta(content), F.lit(0.5), quality.technical_relevance(content, labels), quality.scene_completeness(*(F.array(c) for c in ("tech", "functional", "business"))))


OVERALL = "(greatest(0.0, least(1.0, confidence)) * 0.25 + clarity * 0.15 + specificity * 0.15 + actionability * 0.15 + 0.5 * 0.10 + technical * 0.15 + 0.05)"
QUERIES["unified_quality"] = lambda s, d: spread(a.rules(s, d)).select("rule_id", F.round(_overall(), 6).alias("overall"), F.round(quality.technical_relevance(F.col("content"), F.concat(F.col("keywords"), F.array("tech"))), 6).alias("technical_relevance"), F.round(quality.scene_completeness(*(F.array_compact(F.array(c)) for c in ("tech", "functional", "business"))), 6).alias("scene_completeness"))
ORACLE_SQL["unified_quality"] = f"WITH {SCORED} SELECT rule_id, round({OVERALL}, 6)::DOUBLE AS overall, round(technical, 6) AS technical_relevance, round(((tech IS NOT NULL)::INT + (functional IS NOT NULL)::INT + (business IS NOT NULL)::INT) / 3.0::DOUBLE, 6) AS scene_completeness FROM sc"


def _audit(s, d):
    sources = a.links(s, d).groupBy("rule_id").agg(F.collect_set("memory_id").alias("sources"))
    own = a.rules(s, d).join(sources, "rule_id", "left").withColumn("sources", F.coalesce("sources", F.array().cast("array<long>")))
    active = a.memories(s, d).filter("status = 'active'").select("memory_id")
    return stats.audit(own, active, _overall(), classify.content_category(F.col("content"), ["component", "database", "api"], ["slow", "guessing", "everything"]), 0.6)


QUERIES["rule_audit"] = _audit
ORACLE_SQL["rule_audit"] = f"""
    WITH {SCORED}, {a.MEMORIES}, {a.LINKS}, r AS (SELECT DISTINCT rule_id, memory_id FROM links), dd AS (SELECT rule_id, count(*) AS dead FROM r WHERE memory_id NOT IN (SELECT memory_id FROM memories WHERE status = 'active') GROUP BY rule_id),
    b AS (SELECT rule_id, (contains(low, 'component')::INT + contains(low, 'database')::INT + regexp_matches(low, '\\bapi\\b')::INT) AS c, (contains(low, 'slow')::INT + contains(low, 'guessing')::INT + contains(low, 'everything')::INT) AS b FROM lw)
    SELECT rule_id, 'low_quality' AS issue, 'high' AS severity, round({OVERALL} + 1e-9, 3)::DOUBLE AS metric FROM sc WHERE round({OVERALL} + 1e-9, 3) < 0.6
    UNION ALL SELECT rule_id, 'orphaned_memory', 'medium', dead::DOUBLE FROM dd JOIN rules USING (rule_id)
    UNION ALL SELECT rule_id, 'high_business_ratio', 'medium', NULL FROM b WHERE b > 0 AND b / (b + c)::DOUBLE > 0.6"""
QUERIES["audit_summary"] = lambda s, d: _audit(s, d).groupBy("issue", "severity").agg(F.count("*").alias("rules"))
ORACLE_SQL["audit_summary"] = f"SELECT issue, severity, count(*) AS rules FROM ({ORACLE_SQL['rule_audit']}) GROUP BY issue, severity"

QUERIES["cleanup_scan"] = lambda s, d: a.rules(s, d).select("rule_id", quality.cleanup_score(F.filter("keywords", lambda k: F.length(k) > 3), F.col("tech").isNotNull() | F.col("functional").isNotNull(), F.col("content"), F.col("confidence"), (2, 30, 0.6)).alias("q")).select(
    "rule_id", "q.score", F.array_join("q.issues", ",").alias("issues"), F.when(F.col("q.score") < 0.4, "delete").when(F.col("q.score") < 0.7, "optimize").otherwise("keep").alias("recommendation")
)
ORACLE_SQL["cleanup_scan"] = f"""
    WITH {a.RULES}, t AS (SELECT rule_id, len(list_filter(keywords, lambda k: length(k) > 3)) < 2 AS a, tech IS NULL AND functional IS NULL AS b, length(content) < 30 AS c, confidence < 0.6 AS d FROM rules),
    q AS (SELECT rule_id, round(greatest(0.0, 1.0 - CASE WHEN a THEN 0.15 ELSE 0 END - CASE WHEN b THEN 0.25 ELSE 0 END - CASE WHEN c THEN 0.2 ELSE 0 END - CASE WHEN d THEN 0.3 ELSE 0 END), 6)::DOUBLE AS score,
        array_to_string(list_filter([CASE WHEN a THEN 'low-keywords' END, CASE WHEN b THEN 'missing-scene' END, CASE WHEN c THEN 'weak-description' END, CASE WHEN d THEN 'low-confidence' END], lambda x: x IS NOT NULL), ',') AS issues FROM t)
    SELECT *, CASE WHEN score < 0.4 THEN 'delete' WHEN score < 0.7 THEN 'optimize' ELSE 'keep' END AS recommendation FROM q"""


def _bare_rules(s, d):
    """Every third rule has one keyword, every fifth no scene, and some keywords stand for scenes."""
    i = F.col("rule_id")
    known = F.element_at(F.array(*map(F.lit, ["react", "SQL", "node", "bolt", "jwt"])), (i % 5 + 1).cast("int"))
    words = F.when(i % 3 == 0, F.array(known)).when(i % 3 == 1, F.concat("keywords", F.array(known, F.lit("rust"), F.lit("xss")))).otherwise(F.col("keywords"))
    return a.rules(s, d).withColumns({"keywords": words, "tech": F.when(i % 2 > 0, F.col("tech")), "functional": F.when(i % 2 > 0, F.col("functional"))})


QUERIES["cleanup_optimized"] = lambda s, d: rules.optimised(_bare_rules(s, d), F.col("content"))
ORACLE_SQL["cleanup_optimized"] = f"""
    WITH {a.RULES}, w AS (SELECT rule_id, content, confidence, rule_id % 2 = 0 AS bare, CASE rule_id % 3 WHEN 0 THEN [k] WHEN 1 THEN list_concat(keywords, [k, 'rust', 'xss']) ELSE keywords END AS keywords
        FROM (SELECT *, ['react', 'SQL', 'node', 'bolt', 'jwt'][rule_id % 5 + 1] AS k FROM rules)),
    f AS (SELECT *, list_slice(list_distinct(flatten([regexp_extract_all(lower(content), p) for p in ['\\b(?:react|vue|angular|typescript|javascript|python|java|go|rust)\\b', '\\b(?:api|database|sql|nosql|redis|mongodb|postgresql)\\b', '\\b(?:async|await|promise|callback|hook|memo|effect)\\b', '\\b(?:performance|optimization|cache|memory|speed)\\b', '\\b(?:security|auth|token|jwt|oauth|xss|csrf|injection)\\b', '\\b(?:test|testing|unit|integration|e2e|mock)\\b', '\\b(?:error|exception|validation|sanitize)\\b']])), 1, 10) AS found,
        list_distinct(list_filter(list_transform(keywords, lambda k: map {{'react': 'react', 'vue': 'vue', 'angular': 'angular', 'typescript': 'typescript', 'javascript': 'javascript', 'python': 'python', 'java': 'java', 'go': 'go', 'rust': 'rust', 'node': 'nodejs', 'express': 'express', 'django': 'django', 'flask': 'flask'}}[lower(k)]), lambda x: x IS NOT NULL)) AS t,
        list_distinct(list_filter(list_transform(keywords, lambda k: map {{'api': 'api', 'sql': 'database', 'jwt': 'auth', 'xss': 'security', 'redis': 'cache', 'test': 'testing', 'error': 'error-handling', 'performance': 'performance'}}[lower(k)]), lambda x: x IS NOT NULL)) AS fn FROM w),
    n AS (SELECT rule_id, confidence, bare, len(keywords) < 2 AND len(list_distinct(list_concat(keywords, found))) > len(keywords) AS added, CASE WHEN bare AND len(t) > 0 THEN array_to_string(list_sort(t), ',') ELSE '' END AS t, CASE WHEN bare AND len(fn) > 0 THEN array_to_string(list_sort(fn), ',') ELSE '' END AS fn,
        CASE WHEN len(keywords) < 2 AND len(list_distinct(list_concat(keywords, found))) > len(keywords) THEN len(list_distinct(list_concat(keywords, found))) ELSE len(keywords) END AS n FROM f),
    b AS (SELECT *, confidence < 0.7 AND n >= 3 AND (NOT bare OR t <> '' OR fn <> '') AS boost FROM n)
    SELECT rule_id, n AS keywords, concat_ws(',', nullif(t, ''), nullif(fn, '')) AS inferred, CASE WHEN boost THEN round(least(1.0, confidence + 0.1), 6) ELSE confidence END::DOUBLE AS confidence,
        concat_ws(',', CASE WHEN added THEN 'keywords' END, CASE WHEN t <> '' OR fn <> '' THEN 'scenes' END, CASE WHEN boost THEN 'confidence' END) AS changes FROM b"""
QUERIES["generated_structure"] = lambda s, d: a.table(s, d, "documents").select("doc_id", F.round(quality.structure(
    F.col("text"), F.concat("source", F.lit(" "), "text"), F.split("text", "\\. ?"), F.col("text"), F.concat("lang", F.lit(" "), "text"), F.concat(F.when(F.col("doc_id") % 2 == 0, "# head\n").otherwise(""), F.when(F.col("doc_id") % 3 == 0, "- item\n").otherwise(""), F.col("text"))), 6).alias("score"))
ORACLE_SQL["generated_structure"] = """
    WITH t AS (SELECT doc_id, text AS d, source || ' ' || text AS r, string_split_regex(text, '\\. ?') AS s, text AS g, lang || ' ' || text AS b, CASE WHEN doc_id % 2 = 0 THEN '# head' || chr(10) ELSE '' END || CASE WHEN doc_id % 3 = 0 THEN '- item' || chr(10) ELSE '' END || text AS c FROM documents)
    SELECT doc_id, round(CASE WHEN d = '' THEN 0 WHEN contains(d, '...') OR contains(d, '…') THEN 0.05 WHEN regexp_matches(d, '[^\\x00-\\x7F]{3,}') AND NOT regexp_matches(d, '[一-龥]{3,}') THEN 0.05
            WHEN regexp_matches(d, '<[^>]+>') OR regexp_matches(d, '\\{["\\w]+:') THEN 0.1 WHEN length(d) < 50 THEN 0.1 WHEN length(d) BETWEEN 100 AND 500 THEN 0.3 ELSE 0.2 END::DOUBLE
        + CASE WHEN r = '' THEN 0 WHEN contains(r, 'Corrected') AND contains(r, 'times in') THEN 0.05 WHEN length(r) >= 50 AND NOT contains(r, '...') THEN 0.2 WHEN length(r) >= 20 THEN 0.1 ELSE 0 END
        + CASE WHEN len(s) >= 3 AND len(list_filter(s, lambda x: length(x) > 20 AND (regexp_matches(x, '\\w+\\(') OR regexp_matches(x, '`[^`]+`') OR regexp_matches(x, '(?i)\\b(check|verify|add|remove|use|call|import|export)\\b')))) > 0 THEN 0.2 WHEN len(s) >= 2 THEN 0.1 ELSE 0.05 END
        + CASE WHEN length(g) > 20 AND NOT contains(g, '...') THEN 0.15 + CASE WHEN length(b) > 20 THEN 0.05 ELSE 0 END ELSE 0 END
        + CASE WHEN regexp_matches(c, '(?m)^#{1,3}\\s+\\w+') THEN CASE WHEN regexp_matches(c, '(?m)^[*\\-]\\s+\\w+') OR regexp_matches(c, '```\\w*\\n') THEN 0.1 ELSE 0.05 END ELSE 0 END, 6)::DOUBLE AS score FROM t"""

# ---------------------------------------------------------------- filters of messages and patterns
TRIM = "trim(coalesce({}, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
QUERIES["prefilter"] = lambda s, d: mining.prefiltered(a.messages(s, d).withColumn("content", F.when(F.col("line_number") == 3, F.lit("ok.")).when(F.col("line_number") == 5, F.lit(" a ")).otherwise(F.col("content"))), [r"(?i)thble", r"eux"])
ORACLE_SQL["prefilter"] = f"""
    WITH RECURSIVE {a.MESSAGES}, m AS (SELECT session_id, line_number, role, CASE line_number WHEN 3 THEN 'ok.' WHEN 5 THEN ' a ' ELSE content END AS content FROM messages),
    u AS (SELECT session_id, line_number, {TRIM.format("content")} AS t, lower(content) AS w, row_number() OVER (PARTITION BY session_id ORDER BY line_number) AS k FROM m WHERE role = 'user'),
    o AS (SELECT *, CASE WHEN regexp_matches(t, '(?i)thble') OR contains(t, 'eux') THEN 'hint' WHEN regexp_matches(t, '(?i)^(ok|okay|好的|好|嗯|对|是的|yes|yeah|yep|👍|ok!|fine|sure|got it|noted)\\.?\\s*$') THEN 'acknowledgement' WHEN length(t) <= 2 THEN 'too_short' END AS own,
        list_distinct(list_filter(string_split(lower(t), ''), lambda c: c <> '')) AS x, list_distinct(list_filter(string_split(w, ''), lambda c: c <> '')) AS y FROM u),
    f AS (SELECT session_id, line_number, k, coalesce(own, 'kept') AS verdict, CASE WHEN coalesce(own, 'kept') IN ('hint', 'kept') THEN y END AS last FROM o WHERE k = 1
        UNION ALL SELECT o.session_id, o.line_number, o.k, v.verdict, CASE WHEN v.verdict IN ('hint', 'kept') THEN o.y ELSE f.last END
        FROM f JOIN o ON o.session_id = f.session_id AND o.k = f.k + 1,
        LATERAL (SELECT coalesce(o.own, CASE WHEN len(f.last) > 0 AND len(o.x) > 0 AND len(list_intersect(o.x, f.last)) / (len(o.x) + len(f.last) - len(list_intersect(o.x, f.last)))::DOUBLE > 0.9 THEN 'duplicate' ELSE 'kept' END) AS verdict) v)
    SELECT session_id, line_number, verdict FROM f"""
QUERIES["noise_filter"] = lambda s, d: spread(a.rules(s, d)).select("rule_id", F.array_join(classify.meta_reasons(F.col("content")), ",").alias("reasons")).withColumn("kept", F.col("reasons") == "")
ORACLE_SQL["noise_filter"] = f"WITH {a.RULES} SELECT rule_id, CASE WHEN contains(lower(content), 'you are an ai') THEN 'meta-phrase:you are an ai' ELSE '' END AS reasons, NOT contains(lower(content), 'you are an ai') AS kept FROM rules"
QUERIES["generality_discount"] = lambda s, d: a.rules(s, d).select("rule_id", classify.generality_discount(F.when(F.col("scope") == "project", F.array("project_path")), F.transform("keywords", lambda k: F.when(k == "gear", "React hooks").otherwise(k))).alias("discount"))
ORACLE_SQL["generality_discount"] = f"WITH {a.RULES} SELECT rule_id, CASE WHEN scope = 'project' OR list_contains(keywords, 'gear') THEN 1.0 ELSE 0.85 END::DOUBLE AS discount FROM rules"
QUERIES["security_messages"] = lambda s, d: spread(a.rules(s, d)).select("rule_id", classify.security_message(F.concat(F.when(F.col("rule_id") % 3 == 0, "should validate input ").otherwise(""), F.col("content")), ["never use"], ["ring", "api"]).alias("keyword"))
ORACLE_SQL["security_messages"] = f"""
    WITH {a.RULES}, t AS (SELECT rule_id, CASE WHEN rule_id % 3 = 0 THEN 'should validate input ' ELSE '' END || content AS c FROM rules), l AS (SELECT *, lower(c) AS low FROM t)
    SELECT rule_id, CASE WHEN contains(low, 'never use') THEN 'never use' WHEN (regexp_matches(c, '(?i)(validate|sanitize|escape|filter)\\s+(\\w+|input|output|data|parameter)') OR regexp_matches(c, '(?i)(jwt|token|session|auth|permission|role|access control)') OR regexp_matches(c, '(?i)(encrypt|decrypt|hash|bcrypt|crypto|salt)') OR regexp_matches(c, '(?i)\\w+\\.(escape|sanitize|validate|filter)\\(') OR regexp_matches(c, '(?i)(if|check|verify)\\s+.*\\s+(auth|permission|valid|safe)') OR regexp_matches(c, '(?i)(prepared statement|parameterized query|sql parameter|query builder)|(innerHTML|dangerouslySetInnerHTML|DOM manipulation|script tag)'))
        AND (regexp_matches(c, '(需要|应该|必须|改成|修改|添加|使用)') OR regexp_matches(c, '(?i)(need to|should|must|change to|modify|add|use|fix|prevent)') OR regexp_matches(c, '(不要|别用|避免)') OR regexp_matches(c, '(?i)(don''t|avoid|never|remove)'))
        THEN CASE WHEN contains(low, 'ring') THEN 'ring' WHEN contains(low, 'api') THEN 'api' END END AS keyword FROM l"""
QUERIES["write_gate"] = lambda s, d: spread(a.rules(s, d)).select("rule_id", classify.write_gate(F.col("content"), classify.content_category(F.col("content"), ["component", "use"], ["guessing", "everything", "slow"]).getField("allowed"), F.when(F.col("rule_id") % 2 == 0, "preference")).alias("verdict"))
_INFO = """CASE WHEN regexp_matches(t, '(?i)^(请|能不能|帮我|可以吗|麻烦|帮忙)|^(can you|could you|please|help me|would you)|^(how do|how to|how can|what should|should i)|^(给我|看看|检查|分析一下)|(能不能|可以吗|好吗|行吗)\\s*[?？]?\\s*$|this session is being continued from|summary below covers the earlier portion|^(为什么|怎么|如何|what|why|how)\\s|^(帮我看看|帮忙梳理|请帮我)|^(ok|okay|好的|收到|明白|got it|thanks|thank you)') THEN 'one-time'
    WHEN regexp_matches(t, '(我们团队|团队习惯|我更喜欢|我们约定|约定|规范|习惯|我们一般用|我们总是|以后都)|(?i)(we prefer|our team|we use|convention|we always|our practice|our convention)') THEN 'preference'
    WHEN tech AND fixes THEN 'experience' WHEN tech THEN 'fact' ELSE 'one-time' END"""
_FLAGS = """regexp_matches(t, '(需要|应该|必须|改成|修改|添加|使用|不要|避免|别用|记得|务必)|(?i)(need to|should|must|change to|modify|add|use|fix|prevent|don''t|avoid|never|remove|remember to|always)') AS fixes,
    regexp_matches(t, '[\\w]+\\(.*\\)|[\\w]+\\.\\w+|`[^`]+`|(?i)\\w+\\.(ts|js|tsx|jsx|py|java|go|rs|c|cpp|h|css|html|json|yaml|yml|md|sql)|(function|method|class|interface|type|const|let|var|import|export|async|await|return|useState|useEffect|def|public|private|static)|(query|mutation|endpoint|route|handler|middleware|schema|component|service|module)|(循环|对象|实例|函数|方法|接口|类|模块|组件|缓存|数据库|数据表|索引|线程|进程|内存|堆|栈|队列|锁|并发|异步|同步|请求|响应|服务|部署|构建|编译|测试|配置|日志|异常|错误|性能|优化|路由|中间件|消息|事件|状态|参数|变量|类型|泛型|正则|协议|端口|域名|证书|密钥|令牌|算法|编码|解码|序列化)|(GC|CPU|GPU|I/O|IO|SQL|API|JSON|XML|HTTP|HTTPS|TCP|UDP|RPC|REST|GraphQL|OAuth|JWT)') AS tech"""
ORACLE_SQL["write_gate"] = f"""
    WITH {a.RULES}, x AS (SELECT rule_id, content, lower(content) AS low, {TRIM.format("content")} AS t FROM rules), y AS (SELECT *, {_FLAGS} FROM x),
    z AS (SELECT *, CASE WHEN rule_id % 2 = 0 THEN 'preference' ELSE {_INFO} END AS kind, contains(low, 'component')::INT + contains(low, 'use')::INT AS c, contains(low, 'guessing')::INT + contains(low, 'everything')::INT + contains(low, 'slow')::INT AS b FROM y)
    SELECT rule_id, CASE WHEN kind = 'one-time' THEN 'one-time' WHEN b > 0 AND b / (b + c)::DOUBLE > 0.6 THEN 'non-code-content' WHEN regexp_matches(content, '(?i)(build failed|编译失败|构建失败|临时|temporary|for now|目前|本次|this time|一次性的)|(端口|port)\\s*\\d+|(今天|today|刚才|just now)') THEN 'not-reusable' ELSE 'keep' END AS verdict FROM z"""
QUERIES["info_class"] = lambda s, d: a.messages(s, d).select(F.concat_ws(":", "session_id", "line_number").alias("id"), "content").unionByName(a.rules(s, d).select(F.concat(F.lit("rule "), F.col("rule_id").cast("string")).alias("id"), "content")).select("id", classify.info_class(F.col("content")).alias("info_class"))
ORACLE_SQL["info_class"] = f"""
    WITH {a.MESSAGES}, {a.RULES}, x AS (SELECT session_id || ':' || line_number AS id, {TRIM.format("content")} AS t FROM messages UNION ALL SELECT 'rule ' || rule_id, {TRIM.format("content")} FROM rules), y AS (SELECT *, {_FLAGS} FROM x)
    SELECT id, {_INFO} AS info_class FROM y"""
QUERIES["labelled_validation"] = lambda s, d: a.table(s, d, "pages").select("page_id", F.concat(F.element_at(F.array(*map(F.lit, ["<command-x>", "", "/Users/me/.claude/y ", "see /Users/me/.config/"])), (F.col("page_id") % 4 + 1).cast("int")), F.col("url")).alias("t")).select("page_id", classify.labelled_content(F.col("t")).alias("valid"))
ORACLE_SQL["labelled_validation"] = "SELECT page_id, page_id % 4 IN (1, 3) AS valid FROM pages"
QUERIES["signal_validation"] = lambda s, d: a.table(s, d, "documents").select(F.explode(F.array_distinct(text.words(F.col("text")))).alias("text")).distinct().select("text", classify.valid_signal(F.col("text"), F.length("text") / 12).alias("valid"))
ORACLE_SQL["signal_validation"] = f"""
    WITH w AS (SELECT DISTINCT unnest({a.words_sql("text")}) AS text FROM documents)
    SELECT text, length(text) BETWEEN 2 AND 50 AND length(text) / 12.0::DOUBLE BETWEEN 0.5 AND 0.8 AND regexp_matches(text, '[\\w一-龥]') AND NOT regexp_matches(text, '(?i)^(is|are|the|a|an|this|that|these|those)$|^[.,!?;:]$|^[\\d\\s]+$') AS valid FROM w"""
QUERIES["memory_types"] = lambda s, d: a.memories(s, d).select("memory_id", listing.memory_type(F.col("info_class"), F.lower("content")).alias("kind"))
ORACLE_SQL["memory_types"] = f"""
    WITH {a.MEMORIES}, l AS (SELECT memory_id, info_class, lower(content) AS c FROM memories)
    SELECT memory_id, CASE WHEN info_class = 'preference' THEN 'preference' WHEN regexp_matches(c, 'security|注入|injection|vulnerability|exploit|cve|xss|csrf|密码|哈希|认证|授权|权限|token|auth|安全|泄露|敏感') THEN 'security'
        WHEN regexp_matches(c, '(?i)performance|性能|slow|optimize|优化|useMemo|useCallback|缓存|cache|瓶颈|耗时|延迟|加速|memory leak|内存泄露') THEN 'performance'
        WHEN regexp_matches(c, 'bug|error|wrong|broken|fail|错误|问题|失败|异常|崩溃|报错|修复|死循环|空指针|race condition') THEN 'anti-pattern' WHEN info_class = 'experience' THEN 'repeated-correction'
        WHEN regexp_matches(trim(c, ' '), '^(always|never|must|should|prefer|recommend|避免|不要|必须|总是|统一|约定|建议)') THEN 'preference' ELSE 'repeated-correction' END AS kind FROM l"""
QUERIES["framework_rules"] = lambda s, d: a.table(s, d, "documents").select("doc_id", listing.framework_rule(F.col("text"), F.col("source")).alias("framework"))
ORACLE_SQL["framework_rules"] = "SELECT doc_id, regexp_matches(lower(text) || ' ' || lower(source), 'hooks|useeffect|usestate|usecallback|usememo|rules of hooks|循环里调用|条件里调用|reactive|ref|computed|watch|ngoninit|ngondestroy|changedetection') AS framework FROM documents"
QUERIES["descriptions"] = lambda s, d: spread(a.rules(s, d)).select("rule_id", mining.description(F.concat(F.col("content"), F.lit("\nIn the end it should be `fixed` by all of us. Short. And so on and on")), F.when(F.col("rule_id") % 3 == 0, "preference").when(F.col("rule_id") % 3 == 1, "security").otherwise("repeated-correction")).alias("description"))
ORACLE_SQL["descriptions"] = f"""
    WITH {a.RULES}, x AS (SELECT rule_id, {TRIM.format("content || chr(10) || 'In the end it should be `fixed` by all of us. Short. And so on and on'")} AS c FROM rules),
    p AS (SELECT rule_id, c, list_filter(string_split_regex(c, '[。.!！\\n]+'), lambda s: length(trim(s, ' ')) > 10) AS s FROM x),
    k AS (SELECT *, CASE rule_id % 3 WHEN 0 THEN list_filter(s, lambda y: regexp_matches(lower(y), '我们用|我们使用|团队|约定|规范|习惯|we use|our team|convention|practice|prefer'))
        WHEN 1 THEN list_filter(s, lambda y: regexp_matches(lower(y), '应该|不应该|需要|必须|建议|改成|修改|优化|should|shouldn''t|need to|must|recommend|change to|fix|improve')) ELSE [] END AS f FROM p),
    o AS (SELECT *, array_to_string(f, '. ') AS j, trim(s[1], ' ') AS one FROM k)
    SELECT rule_id, CASE WHEN length(c) < 30 OR len(s) = 0 THEN '' WHEN len(f) > 0 THEN left(j, 150) || CASE WHEN length(j) > 150 THEN '...' ELSE '' END WHEN length(one) > 15 THEN left(one, 150) || CASE WHEN length(one) > 150 THEN '...' ELSE '' END ELSE '' END AS description FROM o"""

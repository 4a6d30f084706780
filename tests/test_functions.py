import pytest
from pyspark.sql import functions as F

from lorequarry.functions import classify, quality, scoring, text
from lorequarry.operators import conflicts, joins, memory, search


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("content", "kind"),
    [
        ("This session is being continued from a previous conversation.", "one-time"),
        ("can you look at it", "one-time"),
        ("we prefer small modules", "preference"),
        ("you should avoid calling fetch() twice", "experience"),
        ("the endpoint lives in server.ts", "fact"),
        ("", "one-time"),
        ("必须用锁", "experience"),
        ("队列里有消息", "fact"),
        ("请帮我看看这个函数", "one-time"),
        ("我们约定用驼峰", "preference"),
        ("config.yaml", "fact"),
    ],
)
def test_info_class(spark, content, kind):
    assert value(spark, classify.info_class(F.lit(content))) == kind


def test_sensitive(spark):
    assert value(spark, classify.sensitive(F.lit("connect to 192.168.1.50 on port 5432")))
    assert not value(spark, classify.sensitive(F.lit("use the refreshToken helper here")))
    assert not value(spark, classify.sensitive(F.lit(None).cast("string")))


def test_content_category(spark):
    code, business = ["useeffect", "react", "typescript"], ["marketing", "conversion", "leads", "seo"]
    of = lambda t: tuple(value(spark, classify.content_category(F.lit(t), code, business)))
    assert of("Use useEffect for side effects in React components with TypeScript") == ("code", True)
    assert of("Our marketing campaign needs better conversion rate and more leads from SEO") == ("business", False)
    assert of("") == ("general", True)


@pytest.mark.parametrize(
    ("kind", "n", "sessions", "span", "valid", "validated", "expected"),
    [("repeated-correction", 2, 2, 14.0, 2, 2, 0.755556), ("repeated-correction", 3, 1, 1 / 24, 3, 0, 0.520046)],
)
def test_pattern_confidence(spark, kind, n, sessions, span, valid, validated, expected):
    c = scoring.pattern_confidence(*(F.lit(x) for x in (kind, n, sessions, span, valid, validated, False)))
    assert value(spark, c) == pytest.approx(expected, abs=1e-6)


@pytest.mark.parametrize(
    ("votes", "expected"),
    [
        (("global", "global", None), ("global", 1.0)),
        (("project", "project", "project"), ("project", 1.0)),
        ((None, None, None), ("project", 0.0)),
        (("organization", "global", "organization"), ("organization", 0.875)),
        (("organization", "project", "project"), ("organization", 0.625)),
    ],
)
def test_scope_vote(spark, votes, expected):
    v = value(spark, scoring.scope_vote(*(F.lit(x).cast("string") for x in votes), F.lit(0.9)))
    assert (v["scope"], v["confidence"]) == expected


def test_fact_upgrade(spark):
    of = lambda *x: value(spark, scoring.fact_upgrade(*map(F.lit, x)))
    assert of(3, True, 1, False)["upgrade"] and of(3, True, 1, False)["score"] == pytest.approx(0.7)
    assert not of(3, False, 1, False)["upgrade"]


def test_decay(spark):
    rows = spark.createDataFrame(
        [(1, "active", "observed", "2023-01-01", 2, "preference", 0), (2, "active", "deprecated", "2024-12-31", None, "fact", 0), (3, "active", "observed", "2023-11-28", None, "experience", 0), (4, "active", "observed", "2023-11-28", None, "preference", 0)],
        "memory_id long, status string, state string, created_at string, ttl_days int, info_class string, recalls long",
    ).withColumn("created_at", F.col("created_at").cast("timestamp"))
    found = {r["memory_id"]: r["action"] for r in memory.decay(rows, F.lit("2025-01-01").cast("timestamp")).collect()}
    assert found == {1: "archived", 2: "archived", 3: "deprecated"}


def test_similarities(spark):
    a, b, none = F.array(F.lit("x"), F.lit("y")), F.array(F.lit("y"), F.lit("z")), F.array().cast("array<string>")
    assert value(spark, text.jaccard(a, b)) == pytest.approx(1 / 3)
    assert value(spark, text.jaccard(none, none)) == 0 and value(spark, text.jaccard_or_equal(none, none)) == 1
    assert value(spark, text.overlap(a, b)) == 0.5 and value(spark, text.overlap(a, none)) == 0
    assert value(spark, text.edit_similarity(F.lit("kitten"), F.lit("sitting"))) == pytest.approx(4 / 7)
    assert value(spark, text.bigrams(F.lit("A b ab"))) == ["ab", "ba"]
    assert value(spark, text.char_ngrams(F.lit("a"), 2)) == []
    assert value(spark, text.name_segments(F.lit("fooBar_baz-qux"))) == ["foo", "bar", "baz", "qux"]


def test_fnv1a(spark):
    assert value(spark, text.fnv1a(F.lit("a"))) == 0xE40C292C and value(spark, text.fnv1a(F.lit("foobar"))) == 0xBF9CF968


def test_paths(spark):
    of = lambda x, y: value(spark, text.path_similarity(F.lit(x), F.lit(y)))
    assert [of("a/b/c", "a/b/c"), of("a/b/c", "a/b/d"), of("a/b/c/d", "a/b/e/f"), of("a/x/y/z", "a/q/r/s"), of("a/b", "z/b"), of("", "a")] == [1.0, 0.8, 0.6, 0.4, 0.0, 0.5]


def test_segments_search_returns_only_what_matches(spark):
    rules = spark.createDataFrame([("rule-cargo", 0.9, ["cargo", "check", "workspace", "rust"]), ("rule-json", 0.8, ["json", "unterminated", "repair", "parse"]), ("rule-refactor", 0.7, ["refactor", "class"])], "rule_id string, confidence double, keywords array<string>")
    found = lambda q: [r["rule_id"] for r in search.rules_by_segments(rules, q, 10).collect()]
    assert found(["cargo", "check", "workspace"]) == ["rule-cargo"]
    assert found(["json", "unterminated", "repair"])[0] == "rule-json"
    assert found(["nothing"]) == []


def test_reference_states(spark):
    rules = spark.createDataFrame([("a", ["m1"]), ("b", ["ghost"]), ("c", ["m1", "ghost"]), ("d", [])], "rule_id string, sources array<string>")
    known = spark.createDataFrame([("m1",), ("m2",)], "memory_id string")
    assert {r["rule_id"]: r["reference_state"] for r in joins.typed_references(rules, known).collect()} == {"a": "normal", "b": "fully_orphaned", "c": "partially_orphaned", "d": "no_references"}


def test_categories_find_short_words_whole(spark):
    of = lambda t: value(spark, classify.content_category(F.lit(t), ["go", "sql"], ["market"]))["category"]
    assert of("google a market") == "business" and of("write it in go") == "code" and of("nothing") == "general"


@pytest.mark.parametrize(
    ("content", "clarity", "specificity", "actionability"),
    [
        ("使用 useEffect 钩子时，应确保依赖数组完整，避免遗漏状态依赖", 1.0, 0.65, 0.82),
        ("也许可以尽量优化一下", 0.28, 0.5, 0.5),
        ("Always use the repository layer instead of raw queries in src/api", 1.0, 0.6, 0.73),
        ("You are an AI, strictly follow the rules", 1.0, 0.0, 0.5),
    ],
)
def test_quality_of_texts(spark, content, clarity, specificity, actionability):
    t = F.lit(content)
    got = value(spark, F.struct(quality.clarity(t).alias("c"), quality.specificity(t, classify.meta(t)).alias("s"), quality.actionability(t).alias("a")))
    assert (got["c"], got["s"], got["a"]) == pytest.approx((clarity, specificity, actionability))


def test_signals_overlap_and_weigh_by_the_square(spark):
    messages = spark.createDataFrame([(1, "aaaa b"), (2, "B")], "id long, content string")
    signals = spark.createDataFrame([(1, "aa", "x", 0.5), (2, "b", "y", 0.9)], "signal_id long, text string, pattern_type string, confidence double")
    found = joins.dictionary_matches(messages, signals, ["id"], "content")
    assert {(r["id"], r["signal_id"]): r["hits"] for r in found.collect()} == {(1, 1): 3, (1, 2): 1, (2, 2): 1}
    scores = {r["id"]: (r["pattern_type"], r["confidence"]) for r in joins.message_scores(found, ["id"]).collect()}
    assert scores == {1: ("x", 0.95), 2: ("y", 0.9)}  # 0.5 * 9 / 4 and 0.9 / 4; together above the cap


def test_texts_meet_patterns_with_and_without_inner_words(spark):
    texts = spark.createDataFrame([(1, "one two, three four"), (2, "xtwo, threey"), (3, "none")], "i long, t string")
    patterns = spark.createDataFrame([("p", "ne two, th"), ("q", "o, t"), ("r", "on"), ("s", "two three")], "k string, p string")
    found = {(r["i"], r["k"]) for r in joins.containing(texts, "t", patterns, "p").collect()}
    assert found == {(1, "p"), (1, "q"), (2, "q"), (1, "r"), (3, "r")}


def test_contradictions_of_rules_and_memories(spark):
    rules = spark.createDataFrame([(1, "Always use tabs."), (2, "Never use tabs."), (3, "Never use spaces."), (4, "使用 缓存。"), (5, "避免 缓存。"), (6, "Always use tabs.")], "rule_id long, content string")
    found = {(r["a"], r["b"], r["pair"], r["rules_a"]) for r in conflicts.contradictions(rules).collect()}
    assert (1, 2, -1, 2) in found and (4, 5, 5, 1) in found and not any(b == 3 and pair == -1 for _, b, pair, _ in found)
    rows = [(1, "k", "p", "You must run tests before merging code", "run tests merging code"), (2, "k", "q", "You must not run tests on code", "run tests code"), (3, "k", "p", "must not eat", "lunch break"), (4, "z", "p", "must not run tests", "run tests code")]
    memories = spark.createDataFrame(rows, "memory_id long, kind string, project string, content string, summary string").withColumn("keywords", F.array().cast("array<string>"))
    assert [(r["a"], r["b"], r["same_project"]) for r in conflicts.memory_conflicts(memories).collect()] == [(1, 2, False)]


def test_memory_conflicts_of_copies_and_common_words(spark, monkeypatch):
    """Copies are one class, a common word is cut into parts, and each pair comes once; nothing but conflicts is staged as a pair."""
    import random

    from lorequarry.operators import conflicts
    from lorequarry.staging import staged

    pairs = {}

    def counted(df, name):
        out = staged(df, name)
        if name == "class_conflicts":
            pairs[name] = out.count()
        return out

    monkeypatch.setattr(conflicts, "staged", counted)
    monkeypatch.setattr(conflicts, "WORD_ROWS", 3)
    rnd = random.Random(4)
    words = ["cache", "index", "query", "table", "hook"]
    rows = [(i, rnd.choice("kl"), None if i % 9 == 0 else f"p{i % 2}", rnd.choice(["always use", "never", "avoid", "must not", "look at"]), sorted(rnd.sample(words, rnd.randrange(1, 4)))) for i in range(80)]
    table = spark.createDataFrame([(i, k, p, v, " ".join(w), []) for i, k, p, v, w in rows], "memory_id long, kind string, project string, content string, summary string, keywords array<string>")
    holds = lambda v: {(k, s) for k, pair in enumerate(conflicts.OPPOSING) for s, w in enumerate(pair) if w in v}
    against = lambda x, y: any((k, 1 - s) in holds(y) for k, s in holds(x))
    want = [(x[0], y[0], x[2] is None or y[2] is None or x[2] == y[2]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and against(x[3], y[3]) and 2 * len(set(x[4]) & set(y[4])) >= min(len(x[4]), len(y[4]))]
    assert sorted((r["a"], r["b"], r["same_project"]) for r in conflicts.memory_conflicts(table).collect()) == want
    assert 0 < pairs["class_conflicts"] < len(want)


def test_memory_conflicts_of_large_classes_and_texts_that_stay(spark, sf, monkeypatch):
    """A class with many members is joined in pieces, over small steps too, and the texts of memories go no further than where they are read."""
    import random

    from lorequarry.operators import conflicts
    from lorequarry.plans import queries_near
    from lorequarry.staging import staged

    plans, largest = {}, []

    def seen(df, name):
        plans[name] = df._jdf.queryExecution().optimizedPlan().toString()
        out = staged(df, name)
        if name == "subject_members":
            largest.append(max((len(r["m"]) for r in out.collect()), default=0))
        return out

    for name, value in (("staged", seen), ("MEMBERS", 4), ("WORD_ROWS", 2), ("PAIRS", 5), ("VALUES", 12)):
        monkeypatch.setattr(conflicts, name, value, raising=False)
    rnd = random.Random(8)
    words = ["cache", "index", "query", "table", "hook", "page", "byte"]
    rows = [(i, "k", rnd.choice("pq"), "always, but never" if i % 3 else "avoid, must not use", ["cache", "index"]) for i in range(60)]
    rows += [(i, rnd.choice("kl"), rnd.choice(["p", None]), rnd.choice(["always use", "never", "avoid", None]), rnd.sample(words, rnd.randrange(0, 6))) for i in range(60, 130)]
    table = spark.createDataFrame([(i, k, p, v, " ".join(w), []) for i, k, p, v, w in rows], "memory_id long, kind string, project string, content string, summary string, keywords array<string>")
    holds = lambda v: {(k, s) for k, pair in enumerate(conflicts.OPPOSING) for s, w in enumerate(pair) if w in (v or "")}
    against = lambda x, y: any((k, 1 - s) in holds(y) for k, s in holds(x))
    want = [(x[0], y[0], x[2] is None or y[2] is None or x[2] == y[2]) for x in rows for y in rows if x[0] < y[0] and x[1] == y[1] and x[4] and y[4] and against(x[3], y[3]) and 2 * len(set(x[4]) & set(y[4])) >= min(len(x[4]), len(y[4]))]
    assert sorted((r["a"], r["b"], r["same_project"]) for r in conflicts.memory_conflicts(table).collect()) == want and len(want) > 1000
    assert 1 < largest[0] < 20
    queries_near.QUERIES["memory_conflicts"](spark, sf)
    assert plans["stances"].index("Join LeftOuter") < plans["stances"].index("Contains(")

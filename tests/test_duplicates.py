"""Components and leaders on large and odd graphs, and duplicates whose sets are empty."""

import random

import pytest

from lorequarry.operators import duplicates, graphs, leaders


def plain_leaders(order, pairs, most=None):
    near = {frozenset(p) for p in pairs}
    leader = {}
    for k, i in enumerate(order):
        if i not in leader:
            free = [j for j in order[k + 1 :] if j not in leader and frozenset((i, j)) in near]
            leader |= {j: i for j in [i, *free[: None if most is None else most - 1]]}
    return leader


@pytest.mark.parametrize("task_edges,most", [(10, None), (10, 3), (60, None)])
def test_leaders_of_large_components(spark, monkeypatch, task_edges, most):
    """Components that no task takes whole: a chain, a dense part, many small ones; the order isn't that of ids."""
    monkeypatch.setattr(graphs, "TASK_EDGES", task_edges)
    rnd = random.Random(task_edges)
    pairs = [(i, i + 1) for i in range(40)] + [(a, b) for a in range(100, 118) for b in range(a + 1, 118) if rnd.random() < 0.3] + [(200 + 2 * i, 201 + 2 * i) for i in range(12)]
    seeds = {i: rnd.randrange(4) if i >= 100 else 0 for i in sorted({x for p in pairs for x in p} | {999})}
    nodes = spark.createDataFrame(list(seeds.items()), "id long, seed long")
    got = graphs.leader_clusters(nodes, spark.createDataFrame(pairs, "a long, b long"), ["seed"], most)
    assert {r["id"]: r["leader"] for r in got.collect()} == plain_leaders(sorted(seeds, key=lambda i: (seeds[i], i)), pairs, most)


def test_chain_of_a_hundred_thousand_rows(spark):
    """A chain in the order of ids is settled in a few jobs: every second row leads."""
    n = 100_000
    rows = spark.range(n).select("id")
    pairs = spark.range(n - 1).selectExpr("id as a", "id + 1 as b")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    try:
        got = graphs.leader_clusters(rows, pairs, [])
        assert got.filter("leader <> id - id % 2").count() == 0 and got.count() == n
        assert len(tracker.getJobIdsForGroup("chain")) < 40
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_components(spark):
    rnd = random.Random(5)
    order = list(range(60))
    rnd.shuffle(order)
    pairs = list(zip(order, order[1:], strict=False)) + [(100, 101), (103, 101), (200, 200)] + [(300 + i, 300) for i in range(1, 20)]
    got = {r["id"]: r["component"] for r in graphs.components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {**dict.fromkeys(range(60), 0), 100: 100, 101: 100, 103: 100, **dict.fromkeys(range(300, 320), 300)}
    assert graphs.components(spark.createDataFrame([], "a long, b long")).collect() == []


RULE = "rule_id long, kind string, scope string, project_path string, keywords array<string>, tech array<string>, functional array<string>, business array<string>, description string, confidence double"


def test_rules_without_keywords_are_duplicates(spark):
    """Two of one scene are one group; none with keywords joins them; another scene stays apart."""
    rules = [
        (1, "k", "global", None, [], ["react"], ["ui"], [], "use hooks", 0.5),
        (2, "k", "global", None, [], ["react"], ["ui"], [], "check effects", 0.7),
        (3, "k", "global", None, None, ["react"], ["ui"], [], "again", 0.7),
        (4, "k", "global", None, ["memo"], ["react"], ["ui"], [], "use hooks", 0.7),
        (5, "k", "global", None, [], ["sql"], ["db"], ["x"], "other thing", 0.7),
    ]
    table = spark.createDataFrame(rules, RULE)
    groups = duplicates.duplicate_groups(table)
    got = {m: r["leader"] for r in groups.collect() for m in r["members"]}
    assert got == {1: 1, 2: 1, 3: 1, 4: 4, 5: 5}
    merged = {r["leader"]: r for r in duplicates.merged_rules(table, groups).collect()}
    assert merged[1]["members"] == 3 and merged[1]["keywords"] == "" and merged[1]["confidence"] == pytest.approx(0.683333)


def test_groups_of_rules_without_pairs(spark, monkeypatch):
    """Where most rules of a block are alike no pairs are made; where few are, pairs give the same; each is held against a loop over pairs."""
    rnd = random.Random(5)
    some = lambda words: [w for w in words if rnd.random() < 0.7]
    rules = [
        (i, rnd.choice("kk-") if i % 50 else None, rnd.choice(["global", "project"]), rnd.choice(["/a", "/B/", None]), rnd.choice([some("xy"), some("xyz"), None]), rnd.choice([["T"], ["t"], ["u"], None, []]),
         [rnd.choice("fg")], [rnd.choice("bc")], rnd.choice(["red bolt", "red nut", "the", "", None]), 0.5)
        for i in range(300)
    ]
    table = spark.createDataFrame(rules, RULE)
    known = duplicates.rule_classes(table)
    pairs = [(r["a"], r["b"]) for r in duplicates.class_pairs(known, 0.75).collect()]
    want = plain_leaders(sorted(r["class_id"] for r in known.collect()), pairs)
    assert len(pairs) > 200
    made, plain = [], duplicates.class_pairs
    monkeypatch.setattr(duplicates, "class_pairs", lambda *a: made.append(1) or plain(*a))
    assert {r["class_id"]: r["leader"] for r in duplicates.duplicate_groups(table).collect()} == want and not made
    monkeypatch.setattr(leaders, "PIECE_ROWS", 10)
    assert {r["class_id"]: r["leader"] for r in duplicates.duplicate_groups(table).collect()} == want


def contents(spark, rows):
    return spark.createDataFrame(rows, "content_id long, session_id long, pattern_type string, signals array<string>, length long, confidence double")


def test_contents_without_signals_are_alike(spark):
    rows = [(1, 1, "p", [], 100, 0.5), (2, 1, "p", None, 80, 0.9), (3, 2, "q", [], 100, 0.5), (4, 2, "p", ["a"], 100, 0.5), (5, 2, "p", [], 0, 1.5), (6, 3, "p", [], 0, 0.5)]
    got = {r["content_id"]: r["leader"] for r in duplicates.labelled_clusters(contents(spark, rows)).collect()}
    # 5 has no length and a confidence that is wholly another: the score is .7 and not above it
    assert got == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 1}


def test_signals_of_a_cluster_are_a_running_intersection(spark):
    rows = [(1, 1, "p", ["a", "b", "c"], 10, 0.5), (2, 1, "p", ["a", "b"], 10, 0.5), (3, 2, "p", ["b", "c"], 10, 0.5), (4, 2, "p", ["a", "c"], 10, 0.5), (5, 2, "p", None, 10, 0.6), (6, 3, "q", [], 1, 0.1)]
    table = contents(spark, rows)
    led = spark.createDataFrame([(1, 1), (2, 1), (3, 1), (4, 1), (5, 1), (6, 6)], "content_id long, leader long")
    got = {r["leader"]: (r["signals"], r["occurrences"], r["sessions"]) for r in duplicates.labelled_records(table, led).collect()}
    assert got == {1: (["b"], 5, 2), 6: ([], 1, 1)}


def test_containment_in_both_plans(spark, monkeypatch):
    """Patterns that fit a broadcast and patterns that don't give the pairs of a loop; empty and null ones are in none."""
    from lorequarry.operators import joins

    rnd = random.Random(8)
    texts = [(i, None if i == 3 else " ".join(rnd.choices(["Alpha", "beta", "gamma.delta", "é", "x"], k=rnd.randrange(9)))) for i in range(40)]
    patterns = [(k, p) for k, p in enumerate(["alpha", "Alpha b", "a g", "gamma.delta é", "x", "", None, "beta x beta", "beta x beta", "ta gamma.delta A"])]
    want = sorted((i, k) for i, t in texts for k, p in patterns if t and p and p in t)
    tables = spark.createDataFrame(texts, "i long, body string"), "body", spark.createDataFrame(patterns, "k long, head string"), "head"
    assert sorted((r["i"], r["k"]) for r in joins.containing(*tables).collect()) == want
    monkeypatch.setattr(joins, "fits", lambda df: False)
    assert sorted((r["i"], r["k"]) for r in joins.containing(*tables).collect()) == want


def test_uncovered_patterns_of_odd_tables(spark):
    from lorequarry.operators import joins

    patterns = spark.createDataFrame([(1, "Use hooks always"), (2, ""), (3, None), (4, "other"), (5, "hooks")], "id long, pattern string")
    free = lambda rules: {r["id"] for r in joins.uncovered(patterns, spark.createDataFrame([(r,) for r in rules], "rule_text string"), "id", 5).collect()}
    assert free(["please use hooks"]) == {3, 4} and free([""]) == {3} and free([None]) == free([]) == {1, 2, 3, 4, 5}


@pytest.mark.parametrize("rows_a_piece,part", [(1000, 0.4), (20, 0.4), (20, 1.0), (20, 0.02)])
@pytest.mark.parametrize("most", [None, 3])
def test_leaders_without_pairs(spark, monkeypatch, rows_a_piece, part, most):
    """Pieces of any size, dense and sparse blocks, give the leaders of a loop."""
    import numpy as np

    from lorequarry.operators import leaders

    monkeypatch.setattr(leaders, "PIECE_ROWS", rows_a_piece)
    rnd = random.Random(int(part * 100) + rows_a_piece)
    rows = [(rnd.choice("xyy"), i, rnd.randrange(5), rnd.randrange(int(1 / part * 3))) for i in range(150)] + [(None, 200, 0, 0)]
    close = 1 if part > 0.1 else 0

    def prepare(table):
        v = table.column("v").to_numpy()
        return lambda i, others: np.abs(v[others] - v[i]) <= close

    table = spark.createDataFrame(rows, "block string, id long, seed long, v long")
    pairs = lambda some: some.alias("p").join(some.alias("q"), "block").where(f"p.id < q.id and abs(p.v - q.v) <= {close}").selectExpr("p.id as a", "q.id as b")
    got = leaders.leader_clusters(table, ["block"], ["seed"], prepare, pairs, most)
    order = [r for r in sorted(rows, key=lambda r: (r[2], r[1]))]
    alike = [(p[1], q[1]) for p in rows for q in rows if p[1] < q[1] and p[0] == q[0] and p[0] and abs(p[3] - q[3]) <= close]
    assert {r["id"]: r["leader"] for r in got.collect()} == plain_leaders([r[1] for r in order], alike, most)


def test_like_contents_are_never_paired(spark, monkeypatch):
    """Four thousand contents that are all alike meet their leader only."""
    from lorequarry.operators import near

    def none(*_):
        raise AssertionError("pairs were made")

    monkeypatch.setattr(near, "similar", none)
    rows = contents(spark, [(i, i // 9, "p", ["a", "b"], 100 + i % 7, 0.5) for i in range(4000)])
    assert {r["leader"] for r in duplicates.labelled_clusters(rows).collect()} == {0}


def compared(monkeypatch):
    """How many rows near.similar is given, one number for each call."""
    from lorequarry.operators import near

    seen, similar = [], near.similar
    monkeypatch.setattr(near, "similar", lambda rows, *other: (seen.append(rows.count()), similar(rows, *other))[1])
    return seen


def test_rules_of_one_text_are_compared_once(spark, monkeypatch):
    seen = compared(monkeypatch)
    rules = [(i, "k", "global", None, ["memo", "hook"], [f"t{i}"], ["ui"], [f"b{i}"], "use hooks", 0.5) for i in range(30)] + [(99, "k", "global", None, ["sql"], ["t1"], ["ui"], ["b1"], "other", 0.5)]
    pairs = duplicates.rule_pairs(spark.createDataFrame(rules, RULE)).collect()
    assert sorted((r["a"], r["b"], r["similarity"], r["action"]) for r in pairs) == [(a, b, 0.8, "merge") for a in range(30) for b in range(a + 1, 30)] and seen == [2]


PATTERN = "pattern_id long, pattern_type string, keywords array<string>, description string, context string, confidence double"


def test_patterns_of_one_text_are_compared_once(spark, monkeypatch):
    """Copies and other contexts of one text are no rows of the comparison; all their pairs are there."""
    seen = compared(monkeypatch)
    rows = [(i, "p", ["memo"], "use hooks now", ["alpha", "beta"][i % 2], 0.5) for i in range(20)] + [(99, "p", ["sql"], "another thing", "alpha", 0.5)]
    got = sorted((r["a"], r["b"], r["similarity"]) for r in duplicates.pattern_pairs(spark.createDataFrame(rows, PATTERN), 0.7).collect())
    assert got == [(a, b, 1.0 if (a - b) % 2 == 0 else 0.9) for a in range(20) for b in range(a + 1, 20)] and seen == [2, 2]


def test_clusters_of_like_patterns_need_no_pairs(spark, monkeypatch):
    seen = compared(monkeypatch)
    rows = spark.createDataFrame([(i, "p", ["memo"], "use hooks now", None, 0.5) for i in range(200)], PATTERN)
    assert {r["pattern_id"]: r["leader"] for r in duplicates.pattern_clusters(rows).collect()} == {i: i - i % 10 for i in range(200)} and seen == []


def test_pattern_pairs_of_large_classes(spark, sf, monkeypatch):
    """A class with many members is joined in pieces and gives the rows of a loop; similarities are rounded for classes, not for rows."""
    from lorequarry.plans import queries_near
    from lorequarry.staging import staged

    tables = {}

    def seen(df, name):
        tables[name] = staged(df, name)
        return tables[name]

    monkeypatch.setattr(duplicates, "staged", seen)
    monkeypatch.setattr(duplicates, "MEMBERS", 4, raising=False)
    rows = [(i, "t", ["red", "blue", "green"][: 2 + i % 2], "paint the house", None, 0.5) for i in range(30)]
    got = sorted((r["a"], r["b"], r["similarity"]) for r in duplicates.pattern_pairs(spark.createDataFrame(rows, PATTERN), 0.7, 3).collect())
    assert got == [(i, j, 0.9 if i % 2 == j % 2 else 0.767) for i in range(30) for j in range(i + 1, 30)]
    assert sorted(r["pieces"] for r in tables["large_classes"].collect()) == [4, 4]
    plan = queries_near.QUERIES["pattern_pairs"](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "round(" not in plan

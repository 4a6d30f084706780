import collections
import math
import random

import pytest

from pyspark.sql import functions as F

from lorequarry.operators import duplicates, graphs, near
from lorequarry.plans import catalog, queries_near, queries_quality
from lorequarry.staging import staged


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_query_equals_its_sql(name, same_as_sql, sf):
    same_as_sql(catalog.QUERIES[name], catalog.ORACLE_SQL[name], sf)


def test_every_sql_has_a_query():
    assert set(catalog.ORACLE_SQL) <= set(catalog.QUERIES)


def test_entry_works_without_the_subpackage(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(catalog.QUERIES) <= set(entry.queries())


def plain_leaders(ids, near, most=None):
    """Leaders in the order of ids, by a loop; near(a, b) tells whether two are alike."""
    leader = {}
    for k, i in enumerate(ids):
        if i in leader:
            continue
        free = [j for j in ids[k + 1 :] if j not in leader and near(i, j)]
        leader |= {j: i for j in [i, *free[: None if most is None else most - 1]]}
    return leader


@pytest.mark.parametrize("most", [None, 2, 4])
def test_leaders_against_a_plain_loop(spark, most):
    rnd = random.Random(most)
    for n, part in ((40, 0.08), (60, 0.3), (30, 1.0)):
        pairs = {(a, b) for a in range(n) for b in range(a + 1, n) if rnd.random() < part}
        order = {i: rnd.randrange(5) for i in range(n)}
        nodes = spark.createDataFrame([(i, order[i]) for i in range(n)], "id long, seed long")
        got = graphs.leader_clusters(nodes, spark.createDataFrame(sorted(pairs), "a long, b long"), ["seed"], most)
        want = plain_leaders(sorted(range(n), key=lambda i: (order[i], i)), lambda a, b: (min(a, b), max(a, b)) in pairs, most)
        assert {r["id"]: r["leader"] for r in got.collect()} == want


def test_parts_and_levels_lose_no_pair(spark, monkeypatch):
    """Small parts, many levels and hot blocks give the pairs of a loop, and the nearest rows too."""
    monkeypatch.setattr(near, "PART_ROWS", 7)
    monkeypatch.setattr(near, "PART_ITEMS", 60)
    monkeypatch.setattr(near, "COLUMNS", 5)
    rnd = random.Random(1)
    sets = {i: sorted({rnd.randrange(14) for _ in range(rnd.choice([1, 2, 5, 9, 14]))}) for i in range(90)}
    block = {i: "hot" if i % 3 else "b" for i in sets}
    rows = staged(spark.createDataFrame([(block[i], i, s) for i, s in sets.items()], "block string, id long, items array<long>"), "rows")
    like = lambda a, b: len(set(sets[a]) & set(sets[b])) / len(set(sets[a]) | set(sets[b]))
    for threshold in (0.3, 0.8):
        got = sorted((r["a"], r["b"]) for r in near.similar(rows, ["block"], threshold).collect())
        assert got == [(a, b) for a in sets for b in sets if a < b and block[a] == block[b] and like(a, b) >= threshold]
    got = {}
    for r in near.nearest(rows.filter("id % 4 = 0"), rows, ["block"], 3).collect():
        got.setdefault(r["query_id"], []).append((r["rank"], r["row_id"]))
    for q in range(0, 90, 4):
        best = sorted((i for i in sets if i != q and block[i] == block[q]), key=lambda i: (-round(like(q, i), 6), i))[:3]
        assert [i for _, i in sorted(got[q])] == best


def test_message_clusters_against_a_plain_loop(spark, sf):
    """Tf-idf within the session, path and topics, seeds by length, twenty at most."""
    rows = {r["id"]: r for r in queries_near._user_messages(spark, sf).collect()}
    sessions = {}
    for i, r in rows.items():
        sessions.setdefault(r["session_id"], []).append(i)
    want = {}
    for ids in sessions.values():
        df = collections.Counter(w for i in ids for w in set(rows[i]["words"]))
        vectors = {}
        for i in ids:
            v = {w: n * math.log(len(ids) / df[w]) for w, n in collections.Counter(rows[i]["words"]).items()}
            size = math.sqrt(sum(x * x for x in v.values()))
            vectors[i] = {w: x / size for w, x in v.items()} if size else {}

        def near_enough(a, b):
            cosine = sum(x * vectors[b].get(w, 0) for w, x in vectors[a].items())
            path = 1.0 if rows[a]["path"] == rows[b]["path"] else 0.6 if a != b else 1.0
            boost = max((min(x, y) / max(x, y) for x, y in zip(rows[a]["topics"], rows[b]["topics"]) if x and y), default=0)
            return (cosine > 0 or boost > 0) and cosine * 0.6 + path * 0.2 + boost * 0.2 >= 0.25 - 1e-9

        want |= plain_leaders(sorted(ids, key=lambda i: (-rows[i]["length"], i)), near_enough, 20)
    got = {r["session_id"] * 1000 + r["line_number"]: r["session_id"] * 1000 + r["leader"] for r in catalog.QUERIES["message_clusters"](spark, sf).collect()}
    assert got == want


def test_memory_clusters_hold_each_text_with_its_copy(spark, sf):
    got = {r["memory_id"]: r["leader"] for r in catalog.QUERIES["memory_clusters"](spark, sf).collect()}
    assert all(got[i] == got[i + 100000] for i in got if i < 100000) and len(set(got.values())) > 5


def test_vector_clusters_against_a_plain_loop(spark, sf):
    import numpy as np

    rows = spark.read.parquet(f"{sf}/embeddings.parquet").orderBy("vec_id").collect()
    got = {r["vec_id"]: r["leader"] for r in catalog.QUERIES["embedding_clusters"](spark, sf).collect()}
    vec = {r["vec_id"]: np.array(r["embedding"], float) / np.linalg.norm(np.array(r["embedding"], float)) for r in rows}
    want = {}
    for label in {r["label"] for r in rows}:
        want |= plain_leaders(sorted((r["vec_id"] for r in rows if r["label"] == label), reverse=True), lambda a, b: round(float(vec[a] @ vec[b]), 9) >= 0.5, 20)
    assert got == want


def test_partitions_do_not_change_results(spark, sf):
    name = "token_jaccard_pairs"
    a = sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect()))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "13")
    try:
        assert sorted(map(tuple, catalog.QUERIES[name](spark, sf).collect())) == a
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)


@pytest.mark.parametrize("threshold", [0.5, 0.55, 0.8])
def test_rare_items_lose_no_pair(spark, monkeypatch, threshold):
    """Sets that meet by their rare items give the pairs of a loop, over small steps and batches; no tile is made."""
    for name, value in (("LEAST_ROWS", 0), ("PAIRS", 50), ("ORDER_ROWS", 100), ("CANDIDATES", 1000)):
        monkeypatch.setattr(near, name, value, raising=False)
    rnd = random.Random(3)
    sets = {}
    for i in range(400):
        size = rnd.choice([1, 2, 3, 8, 30, 120])
        sets[i] = {int(4000 * rnd.random() ** 3) for _ in range(size)} if i % 3 or not i else {x for x in sets[rnd.randrange(i)] if rnd.random() < 0.9} | {rnd.randrange(4000)}
    block = {i: "b" if i % 7 == 0 else "hot" for i in sets}
    rows = staged(spark.createDataFrame([(block[i], i, sorted(s)) for i, s in sets.items()], "block string, id long, items array<long>"), "rows")
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    found = near.similar(rows, ["block"], threshold)
    got = sorted((r["a"], r["b"], round(r["score"], 5)) for r in found.collect())
    want = [(a, b, round(like(a, b), 5)) for a in sets for b in sets if a < b and block[a] == block[b] and like(a, b) >= threshold]
    assert got == want and len(want) > 30
    assert "FlatMapGroupsInArrow" not in found._jdf.queryExecution().executedPlan().toString()


def test_rows_of_a_large_block_go_to_few_parts(spark):
    """40,000 rows of a block are eight parts, not forty; more than 64,000 grow again."""
    rows = spark.range(40_000).selectExpr("'b' as block", "id", "array(id) as items")
    assert [r["parts"] for r in near._parts(rows, ["block"], F.lit(0)).collect()] == [8]
    assert [r["parts"] for r in near._parts(spark.range(100_000).selectExpr("'b' as block", "id", "array(id) as items"), ["block"], F.lit(0)).collect()] == [13]


@pytest.mark.parametrize("weighted", [False, True])
def test_products_of_rare_and_frequent_items(monkeypatch, weighted):
    """Items multiplied in a few columns at a time and those counted pair by pair add up to all."""
    import numpy as np
    import pyarrow as pa

    for name, value in (("COLUMNS", 5), ("CELLS", 20), ("AT_ONCE", 30)):
        monkeypatch.setattr(near, name, value, raising=False)
    rng = np.random.default_rng(1)
    sides = []
    for n in (40, 23):
        items = [sorted(set((300 * rng.random(rng.integers(0, 60)) ** 3).astype(int).tolist())) for _ in range(n)]
        weights = [rng.random(len(s)).tolist() for s in items]
        sides.append((pa.table({"items": pa.array(items, pa.list_(pa.int64())), "weights": pa.array(weights, pa.list_(pa.float64()))}), [dict(zip(s, w if weighted else [1] * len(s), strict=True)) for s, w in zip(items, weights, strict=True)]))
    want = [[sum(w * q.get(i, 0) for i, w in p.items()) for q in sides[1][1]] for p in sides[0][1]]
    assert np.allclose(near._products(sides[0][0], sides[1][0], weighted), want)


def test_quality_of_rules_in_code_and_in_many_tasks(spark, sf):
    """No lambda looks at a text again for each of its words, and a small file of rules is more than one task."""
    found = queries_quality.QUERIES["rule_quality"](spark, sf)
    assert "lambdafunction" not in found._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]
    assert found.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions"))
    reasons = queries_quality.QUERIES["noise_filter"](spark, sf)
    assert "lambdafunction" not in reasons._jdf.queryExecution().optimizedPlan().toString().split("Repartition")[0]


@pytest.mark.parametrize("same_size", [False, True])
def test_rare_items_are_counted_where_they_meet(spark, monkeypatch, same_size):
    """Pairs of several small parts are those of a loop, with what they carry; a pair leaves a task once, and no sooner than it shares what is asked for."""
    tables = {}

    def seen(df, name):
        tables[name] = staged(df, name)
        return tables[name]

    for name, value in (("staged", seen), ("LEAST_ROWS", 0), ("PAIRS", 40), ("STEP_ITEMS", 25), ("RARE_ROWS", 30), ("RARE_ITEMS", 400), ("ORDER_ROWS", 100), ("CANDIDATES", 1000)):
        monkeypatch.setattr(near, name, value, raising=False)
    rnd = random.Random(5)
    sets = {}
    for i in range(300):
        size = 12 if same_size else rnd.choice([1, 2, 5, 40])
        sets[i] = {int(2000 * rnd.random() ** 2) for _ in range(size)} if i % 3 or not i else {x for x in sets[rnd.randrange(i)] if rnd.random() < 0.9} | {rnd.randrange(2000)}
    block = {i: "b" if i % 7 == 0 else "hot" for i in sets}
    rows = staged(spark.createDataFrame([(block[i], i, sorted(s), 3 * i) for i, s in sets.items()], "block string, id long, items array<long>, copies long"), "rows")
    like = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    got = sorted((r["a"], r["b"], round(r["score"], 5), r["copies_a"], r["copies_b"]) for r in near.similar(rows, ["block"], 0.6, carried=["copies"]).collect())
    assert got == [(a, b, round(like(a, b), 5), 3 * a, 3 * b) for a in sets for b in sets if a < b and block[a] == block[b] and like(a, b) >= 0.6] and len(got) > 20
    met = [(min(r["a"], r["b"]), max(r["a"], r["b"])) for r in tables["candidates"].collect()]
    assert len(met) == len(set(met)) < 10 * len(got)
    assert max(r["parts"] for r in tables["parts"].collect()) > 2


def test_pairs_of_bigrams_move_no_more_once_made(spark, sf):
    """What stands beside a pair comes with its rows into the tile, so no join follows; staged tables leave no shuffle behind."""
    plan = catalog.QUERIES["bigram_jaccard_pairs"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "FlatMapGroupsInArrow" in plan and "Join" not in plan.split("FlatMapGroupsInArrow")[0]
    files = lambda: spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().size()
    before = files()
    staged(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counted").count()
    staged(spark.range(1000).groupBy((F.col("id") % 10).alias("k")).count(), "counted")
    assert files() <= before + 4


def test_rows_of_small_blocks_go_to_one_part(spark):
    """Beside nine others a block of 4000 rows is one part, as there are tasks enough."""
    rows = spark.range(40_000).selectExpr("id % 10 as block", "id", "array(id) as items")
    assert {r["parts"] for r in near._parts(rows, ["block"], F.lit(0)).collect()} == {4}
    rows = spark.range(40_000).selectExpr("id % 40 as block", "id", "array(id, id + 1, id + 2) as items")
    assert {r["parts"] for r in near._parts(rows, ["block"], F.lit(0)).collect()} == {1}

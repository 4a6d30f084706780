"""Joins in time and order, numbered lines, and state over batches, against loops."""

import collections
import datetime
import json
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.functions import text
from lorequarry.operators import clustering, duplicates, joins, mining
from lorequarry.plans import queries_near
from lorequarry.sources import transcripts
from lorequarry.staging import staged
from lorequarry.streaming import incremental


@pytest.mark.parametrize("parts", [1, 7, 40])
def test_nearest_in_time_of_a_hot_key(spark, parts):
    """One key has most rows and reaches over many ranges; equal times on both sides of a border, keys of one side only, nulls."""
    rnd = random.Random(parts)
    at = lambda m: datetime.datetime(2024, 1, 1) + datetime.timedelta(minutes=m)
    rows = lambda n, lo, spread: [(rnd.choice(["hot"] * 8 + ["b", "c"]), i, at(rnd.randrange(spread))) for i in range(lo, lo + n)]
    left, right = rows(150, 0, 60), rows(60, 1000, 300) + [("only", 5000, at(1)), ("hot", 7000, None), (None, 7001, at(1))]
    left += [("alone", 900, at(3)), (None, 901, at(3)), ("hot", 902, None)]
    kind = "key string, {0} long, {1} timestamp"
    got = joins.nearest_before_or_after(spark.createDataFrame(left, kind.format("l", "lt")), spark.createDataFrame(right, kind.format("r", "rt")), "key", "l", "r", "lt", "rt", parts)
    want = {}
    for key, i, t in left:
        found = [(abs(int((t - u).total_seconds() * 1_000_000)), r) for k, r, u in right if k == key and u and t and k]
        if found:
            want[i] = min(found)[::-1]
    assert {r["l"]: (r["r"], r["micros_away"]) for r in got.collect()} == want


def test_edits_around_a_correction(spark):
    said = [("s", 20, "wrong in src/app.ts:4"), ("s", 40, "no file here"), ("s", 60, "on lib.py"), ("t", 20, "app.ts")]
    calls = [
        ("s", 9, "Read", "/w/app.ts", "far", ""), ("s", 10, "Read", "/w/app.ts", "c1", ""), ("s", 15, "Read", "/w/app.ts", "c2", ""), ("s", 18, "Read", "/w/app.ts", "none", ""), ("s", 19, "Read", "/w/other.ts", "c3", ""),
        ("s", 19, "Edit", "/w/app.ts", "early", "before it"), ("s", 25, "Edit", "/w/app.ts", "e2", "second"), ("s", 20, "Write", "/w/app.ts", "e1", "first"), ("s", 70, "Edit", "/w/lib.py", "late", "too late"),
    ]
    gave = [("s", 12, "c1", "old one"), ("s", 20, "c2", "held"), ("s", 16, "c3", "not its own"), ("s", 24, "none", "six lines on"), ("t", 15, "c2", "elsewhere"), ("s", 14, "far", "far")]
    args = (
        spark.createDataFrame(said, "session_id string, line_number long, context string"), spark.createDataFrame(calls, "session_id string, line_number long, tool_name string, file_path string, call_id string, content string"),
        spark.createDataFrame(gave, "session_id string, line_number long, call_id string, content string"),
    )
    got = {(r["session_id"], r["line_number"]): (r["file_name"], r["before"], r["after"]) for r in joins.edits_around(*args).collect()}
    assert got == {("s", 20): ("app.ts", "held", "first"), ("s", 60): ("lib.py", None, None), ("t", 20): ("app.ts", None, None)}
    assert joins.edits_around(args[0].limit(0), *args[1:]).collect() == []


def test_lines_of_files_in_many_splits(spark, tmp_path):
    """Files in splits of a hundred bytes keep the numbers of their lines, empty and broken ones counted."""
    want = {}
    for name, n in (("a.jsonl", 400), ("b.jsonl", 3), ("empty.jsonl", 0), ("deep/a.jsonl", 57)):
        lines = [json.dumps({"i": i, "pad": "x" * (i * 7 % 90)}) if i % 11 else ["", "{broken"][i % 2] for i in range(n)]
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text("\n".join(lines) + ("\n" if lines else ""))
        want |= {(name, k + 1): line for k, line in enumerate(lines)}
    before = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "300")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        found = transcripts.numbered(spark, str(tmp_path), "*.jsonl")
        assert spark.read.option("recursiveFileLookup", True).text(str(tmp_path)).selectExpr("spark_partition_id() as p").distinct().count() > 20
        got = {(r["path"].split(f"{tmp_path.name}/")[1], r["line_number"]): r["line"] for r in found.collect()}
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    assert got == want


def test_pattern_clusters_against_a_loop(spark, sf):
    rows = queries_near._patterns(spark, sf).filter("pattern_id < 90").collect()
    split = lambda t: {w for w in re.split(r"[^\w+#.\-]+", (t or "").lower()) if len(w) >= 3}
    jaccard = lambda a, b: 1.0 if not a and not b else len(a & b) / len(a | b)

    def like(p, q):
        context = jaccard(split(p["context"]), split(q["context"])) * 0.1 if p["context"] and q["context"] else 0
        return round(jaccard(set(p["keywords"]), set(q["keywords"])) * 0.4 + jaccard(split(p["description"]), split(q["description"])) * 0.3 + 0.2 + context, 9)

    leader, order = {}, sorted(rows, key=lambda r: (-r["confidence"], r["pattern_id"]))
    for k, seed in enumerate(order):
        if seed["pattern_id"] not in leader:
            free = [r["pattern_id"] for r in order[k + 1 :] if r["pattern_id"] not in leader and r["pattern_type"] == seed["pattern_type"] and like(seed, r) >= 0.4][:3]
            leader |= dict.fromkeys([seed["pattern_id"], *free], seed["pattern_id"])
    table = spark.createDataFrame(rows, queries_near._patterns(spark, sf).schema)
    got = {r["pattern_id"]: r["leader"] for r in duplicates.pattern_clusters(table, most=4).collect()}
    assert got == leader and max(collections.Counter(got.values()).values()) == 4


# ---------------------------------------------------------------- state over batches
def plain_clusters(batches, threshold):
    """Batches of (id, unit vector); a row joins the nearest known centroid, else a leader among the free rows of its batch."""
    centroids, out = [], {}
    for batch in batches:
        known, free = list(centroids), []
        for i, v in batch:
            best = max(((round(float(v @ c), 6), -k) for k, c in enumerate(known)), default=(-9.0, 0))
            if known and best[0] >= threshold:
                out[i] = -best[1]
            else:
                free.append((i, v))
        taken = set()
        for k, (i, v) in enumerate(free):
            if i in taken:
                continue
            for j, u in free[k:]:
                if j not in taken and (j == i or round(float(v @ u), 9) >= threshold):
                    taken.add(j)
                    out[j] = len(centroids)
            centroids.append(v)
    return out


def test_clusters_over_batches_equal_a_loop(spark, tmp_path):
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(6, 8))
    x = centres[rng.integers(0, 6, 90)] + 0.4 * rng.normal(size=(90, 8))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    batches = [[(i, x[i]) for i in part] for part in (range(0, 30), range(30, 75), range(75, 90))]
    schema = "id long, items array<long>, weights array<double>"
    for k, batch in enumerate(batches):
        spark.createDataFrame([(i, list(range(8)), v.tolist()) for i, v in batch], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    for _ in range(2):  # a second run finds nothing new and changes nothing
        incremental.cluster_stream(stream, str(tmp_path / "out"), str(tmp_path / "c"), 0.7).trigger(availableNow=True).start().awaitTermination()
        got = {r["id"]: r["centroid"] for r in spark.read.parquet(str(tmp_path / "out/assigned")).collect()}
        assert got == plain_clusters(batches, 0.7) and None not in got.values()
    known = spark.read.parquet(str(tmp_path / "out/centroids/epoch=1"))
    again, _ = clustering.cluster_batch(staged(spark.createDataFrame([(i, list(range(8)), v.tolist()) for i, v in batches[2]], schema), "rows"), known, 0.7, known.count())
    assert {r["id"]: r["centroid"] for r in again.collect()} == {i: got[i] for i, _ in batches[2]}


def test_sessions_over_time(spark, tmp_path):
    """Patterns are merged over batches, lines that come again change nothing, a timer closes what is idle, and later lines begin anew."""
    incremental.use_state_store(spark)
    at = lambda h: datetime.datetime(2024, 1, 1) + datetime.timedelta(hours=h)
    batches = [
        [("a", 1, at(0), "p"), ("a", 2, at(0), None), ("a", 3, at(1), "q"), ("b", 1, at(0), "p")],
        [("a", 2, at(0), None), ("a", 3, at(1), "q"), ("a", 4, at(2), "p"), ("a", 4, at(2), "p"), ("b", 1, at(0), "p")],
        [("c", 1, at(60), "z")],  # the watermark passes a's and b's timers
        [("c", 2, at(61), None), ("a", 5, at(61), "p")],
    ]
    schema = "session_id string, line_number long, ts timestamp, pattern string"
    for batch in batches:
        spark.createDataFrame(batch, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    out = {}

    def keep(df, epoch):
        out[epoch] = {(r["session_id"], r["pattern"], r["n"], r["first_line"], r["last_line"], r["closed"]) for r in df.collect()}

    made = incremental.session_patterns(stream, idle="24 hours", delay="1 hour")
    made.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    rows = [out[k] for k in sorted(out)]
    assert rows[0] == {("a", "p", 1, 1, 1, False), ("a", "q", 1, 3, 3, False), ("a", None, 0, 0, 3, False), ("b", "p", 1, 1, 1, False), ("b", None, 0, 0, 1, False)}
    assert rows[1] == {("a", "p", 2, 1, 4, False), ("a", None, 0, 0, 4, False)}
    closed = {r for part in rows for r in part if r[5]}
    assert {("a", "p", 2, 1, 4, True), ("a", "q", 1, 3, 3, True), ("a", None, 0, 0, 4, True), ("b", "p", 1, 1, 1, True), ("b", None, 0, 0, 1, True)} == closed
    assert {r for part in rows[2:] for r in part if r[0] == "a" and not r[5]} == {("a", "p", 1, 5, 5, False), ("a", None, 0, 0, 5, False)}


def test_vectors_of_grams_in_both_plans(spark, sf, monkeypatch):
    docs = spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 40").select("doc_id", "text").unionByName(spark.createDataFrame([(900, None), (901, ""), (902, "a")], "doc_id long, text string"))
    one = {(r["doc_id"], r["slot"]): r["weight"] for r in clustering.hashed_terms(docs, "doc_id", "text").collect()}
    monkeypatch.setattr(clustering, "fits", lambda df: False)
    two = {(r["doc_id"], r["slot"]): r["weight"] for r in clustering.hashed_terms(docs, "doc_id", "text").collect()}
    assert one == pytest.approx(two) and len(one) > 1000 and not any(i >= 900 for i, _ in one)


def test_common_keywords_count_members_once(spark):
    """A member with several rows counts once for a word; where each has one row, no row of a word and a member moves."""
    rows = [("a", 1, "red nut"), ("a", 1, "red red"), ("a", 2, "red"), ("a", None, "nut"), (None, 3, "nut"), ("b", 1, "gear gear"), ("b", 4, None)]
    table = spark.createDataFrame(rows, "c string, m long, t string")
    found = lambda df: mining.common_keywords(df, "c", "m", text.words(F.col("t")), 0.5)
    assert sorted(map(tuple, found(table).collect())) == [("a", "nut", 1), ("a", "red", 2), ("b", "gear", 1)]
    once = found(table.filter("not t = 'red red'"))
    assert sorted(map(tuple, once.collect())) == [("a", "nut", 1), ("a", "red", 2), ("b", "gear", 1)]
    assert "distinct" not in once._jdf.queryExecution().optimizedPlan().toString().lower().replace("array_distinct", "")


def test_grams_of_a_text_are_counted_once(monkeypatch):
    """Pairs and triples, in one counter; adding two of them goes through every gram again."""
    monkeypatch.setattr(collections.Counter, "__add__", None)
    for t in ("", "a", "ab", "abab", "aaaa\u4e2d"):
        assert clustering._grams(t) == collections.Counter([t[i : i + n] for n in (2, 3) for i in range(len(t) - n + 1)])

"""The automaton, the vector index and the text index against loops."""

import collections
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorequarry.operators import automaton, fulltext, near, search, vectors
from lorequarry.plans import queries_memory


# ---------------------------------------------------------------- automaton
def plain_occurrences(texts, words, radius):
    rows = collections.Counter()
    for key, text in texts:
        text = text or ""
        for name, word in words:
            if word:
                for m in re.finditer(f"(?={re.escape(word.lower())})", text.lower()):
                    lo, hi = max(0, m.start() - radius), m.start() + len(word) + radius
                    rows[key, name, m.start(), ("..." if lo else "") + text[lo:hi] + ("..." if hi < len(text) else "")] += 1
    return rows


@pytest.mark.parametrize("limit", [16 << 20, 200])
def test_occurrences_against_a_loop(spark, monkeypatch, limit):
    """One part of the dictionary, and a dictionary of many parts."""
    monkeypatch.setattr(automaton, "BROADCAST_BYTES", limit)
    monkeypatch.setattr(automaton, "ROWS", 50)
    rnd = random.Random(2)
    texts = [(i, "".join(rnd.choice("abÉ .\n") for _ in range(rnd.choice([0, 5, 60, 400])))) for i in range(40)] + [(40, None), (41, "aaaa"), (41, "aaaa")]
    words = [("one", "a"), ("two", "ab"), ("again", "AB"), ("éa", "éa"), ("none", ""), ("null", None), ("a.", "a."), ("bab", "bab"), ("far", "zzz")]
    messages = spark.createDataFrame(texts, "doc long, body string")
    signals = spark.createDataFrame(words, "signal_id string, text string")
    got = automaton.occurrences(messages, signals, ["doc"], "body", 7)
    want = plain_occurrences(texts, words, 7)
    assert got.columns == ["doc", "signal_id", "start", "context"] and collections.Counter(map(tuple, got.collect())) == want
    hits = collections.Counter()
    for (doc, name, _, _), n in want.items():
        hits[doc, name] += n
    counted = automaton.counts(messages.filter("doc < 41"), signals, ["doc"], "body").collect()
    assert {(r["doc"], r["signal_id"]): r["hits"] for r in counted} == {k: n for k, n in hits.items() if k[0] < 41}
    assert automaton.occurrences(messages.limit(0), signals, ["doc"], "body").count() == automaton.occurrences(messages, signals.limit(0), ["doc"], "body").count() == 0


def test_fifty_thousand_words_in_all_documents(spark, sf):
    """Every word that is found in a text is one of its strings, and all are found."""
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"].lower() for r in docs.collect() if r["text"]}
    own = {w for t in texts.values() for w in re.findall("[a-z]{7,}", t)}
    rnd = random.Random(1)
    words = sorted(own | {"".join(rnd.choice("abcdefgh") for _ in range(7)) for _ in range(50_000)})
    assert len(words) > 50_000
    got = automaton.counts(docs, spark.createDataFrame([(w, w) for w in words], "text string, word string"), ["doc_id"], "text").collect()
    want = collections.Counter()
    sizes, known = sorted({len(w) for w in words}), set(words)
    for i, t in texts.items():
        for n in sizes:
            want.update((i, t[k : k + n]) for k in range(len(t) - n + 1) if t[k : k + n] in known)
    assert {(r["doc_id"], r["word"]): r["hits"] for r in got} == want


def test_parts_of_a_dictionary_in_one_scan(spark, monkeypatch):
    """A dictionary that is sent in parts is met in one scan of the texts, and in more only beyond what a worker may hold; nothing is lost."""
    texts = [(i, f"word{i} and Word{i + 1} here") for i in range(30)]
    words = [(f"w{i}", f"word{i}") for i in range(25)] + [("again", "WORD3"), ("none", "")]
    messages, signals = spark.createDataFrame(texts, "doc long, body string"), spark.createDataFrame(words, "signal_id string, text string")
    want = plain_occurrences(texts, words, 7)
    monkeypatch.setattr(automaton, "BROADCAST_BYTES", 200)
    for limit, least, most in ((1 << 20, 1, 1), (1000, 2, 9)):
        monkeypatch.setattr(automaton, "SCAN_BYTES", limit)
        got = automaton.occurrences(messages, signals, ["doc"], "body", 7)
        assert least <= got._jdf.queryExecution().analyzed().toString().count("MapInArrow") <= most
        assert collections.Counter(map(tuple, got.collect())) == want


def test_vocabulary_in_documents(spark, sf):
    found = queries_memory.QUERIES["vocabulary_occurrences"](spark, sf)
    words = {w for r in spark.read.parquet(f"{sf}/conversations.parquet").select("text").collect() for w in re.findall("[a-z]{6,}", (r["text"] or "").lower())}
    texts = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").filter("doc_id < 12").collect()]
    assert collections.Counter(tuple(r) for r in found.filter("doc_id < 12").collect()) == plain_occurrences(texts, [(w, w) for w in words], 10)


# ---------------------------------------------------------------- vectors
def clustered(n, dims, seed):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dims))
    x = centres[rng.integers(0, 12, n)] + 0.25 * rng.normal(size=(n, dims))
    x[n // 3 : 2 * n // 3] = x[0]  # a third of all rows are copies
    return x


def plain_nearest(x, ids, queries, k):
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for q in queries:
        s = np.round(unit @ unit[q], 6)
        out[ids[q]] = [ids[i] for i in sorted(range(len(ids)), key=lambda i: (-s[i], ids[i])) if i != q][:k]
    return out


def test_vector_index_against_all_pairs(spark, monkeypatch):
    """Exact search loses nothing; searching a few lists finds nine in ten; each row is in one list, and the bound spares lists."""
    monkeypatch.setattr(near, "PART_ROWS", 60)
    monkeypatch.setattr(vectors, "SAMPLE_ROWS", 300)
    x = clustered(900, 16, 0)
    ids = [i * 7 + 3 for i in range(len(x))]
    table = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)] + [(-1, None), (-2, [])], "vec long, v array<float>")
    index = vectors.VectorIndex(table, "vec", "v", lists=30)
    assert index.rows.count() == len(x) == index.rows.select("id").distinct().count()
    asked = list(range(0, len(x), 20))
    want = plain_nearest(x.astype(np.float32).astype(float), ids, asked, 10)
    queries = index.rows.join(spark.createDataFrame([(ids[q],) for q in asked], "id long"), "id")
    found = collections.defaultdict(list)
    for r in index.nearest(queries, 10).orderBy("query_id", "rank").collect():
        found[r["query_id"]].append(r["row_id"])
    assert dict(found) == want
    few = collections.defaultdict(set)
    for r in index.nearest(queries, 10, probes=4).collect():
        few[r["query_id"]].add(r["row_id"])
    loose = [q for q in asked if not len(x) // 3 <= q < 2 * len(x) // 3 and q]  # copies have many rows of one score
    recall = sum(len(few[ids[q]] & set(want[ids[q]])) for q in loose) / (10 * len(loose))
    print("recall of 4 of 30 lists:", recall)
    assert recall >= 0.9
    far = index._probed(queries.withColumn("r", F.lit(0.3)), None)
    assert far.count() < 0.5 * len(asked) * 30


def test_queries_for_many_lists_leave_in_small_batches(spark, monkeypatch):
    """A query goes to every list where nothing is spared; no batch holds all copies of a batch's queries."""
    rng = np.random.default_rng(3)
    index = vectors.VectorIndex(spark.createDataFrame([(i, rng.normal(size=32).tolist()) for i in range(400)], "id long, v array<double>"), "id", "v", lists=40)
    monkeypatch.setattr(vectors, "AT_ONCE", 640)
    asked = index.rows.select("id", "items", "weights", F.lit(None).cast("double").alias("r"))
    wanted, taken = index._probed(asked, None).count(), []
    with monkeypatch.context() as m:
        m.setattr(type(asked), "mapInArrow", lambda self, run, schema: taken.append(run))
        index._probed(asked, None)
    made = [b.num_rows for b in taken[0](iter(asked.toArrow().combine_chunks().to_batches()))]
    assert sum(made) == wanted > 400 * 20 and max(made) <= vectors.AT_ONCE // 32


def test_recall_on_the_embeddings(spark, sf):
    table = spark.read.parquet(f"{sf}/embeddings.parquet")
    index = vectors.VectorIndex(table, "vec_id", "embedding")
    queries = index.rows.filter("id % 20 = 0")
    exact = {(r["query_id"], r["row_id"]) for r in index.nearest(queries, 10).collect()}
    rows = sorted(table.collect(), key=lambda r: r["vec_id"])
    x, ids = np.array([r["embedding"] for r in rows], float), [r["vec_id"] for r in rows]
    want = plain_nearest(x, ids, [k for k, i in enumerate(ids) if i % 20 == 0], 10)
    assert exact == {(q, r) for q, found in want.items() for r in found}
    lists = len(index.centroids)
    most = {(r["query_id"], r["row_id"]) for r in index.nearest(queries, 10, probes=3 * lists // 4).collect()}
    print("recall of three quarters of the lists:", len(most & exact) / len(exact))
    assert len(most & exact) >= 0.9 * len(exact)


def test_vector_index_of_odd_tables(spark):
    empty = vectors.VectorIndex(spark.createDataFrame([], "id long, v array<double>"), "id", "v")
    assert empty.nearest(empty.rows, 3).collect() == []
    one = vectors.VectorIndex(spark.createDataFrame([(1, [0.0, 0.0]), (2, [1.0, 0.0]), (3, [1.0, 0.0])], "id long, v array<double>"), "id", "v")
    got = {(r["query_id"], r["row_id"]): r["score"] for r in one.nearest(one.rows, 1).collect()}
    assert got == {(1, 2): 0.0, (2, 3): 1.0, (3, 2): 1.0}


# ---------------------------------------------------------------- full text
def plain_scores(texts):
    words = {i: [w for w in re.split(r"[^\w+#.\-]+", t.lower()) if w] for i, t in texts.items()}
    df = collections.Counter(w for ws in words.values() for w in set(ws))
    mean = sum(map(len, words.values())) / len(words)
    impact = lambda i, w: np.log((len(words) - df[w] + 0.5) / (df[w] + 0.5) + 1) * (tf := words[i].count(w)) * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len(words[i]) / mean))
    return words, impact


def test_text_index_against_a_loop(spark, monkeypatch):
    monkeypatch.setattr(fulltext, "BLOCK", 5)
    rnd = random.Random(4)
    vocabulary = ["common", "com", "comet", "rare", "red", "bolt", "a", "zz-top", "ré"]
    texts = {i: " ".join(rnd.choices(vocabulary, [9, 1, 1, 0.2, 3, 3, 5, 1, 1], k=rnd.choice([0, 1, 4, 30]))) for i in range(150)}
    texts[200], texts[201] = "", "rare " * 40
    rows = spark.createDataFrame([*texts.items(), (300, None)], "id long, body string")
    texts[300] = ""
    words, impact = plain_scores(texts)
    index = fulltext.TextIndex.open(spark, fulltext.TextIndex.build(rows, "id", "body").folder)
    for query, k in (("rare", 3), ("Rare common, a", 10), ("common", 400), ("rare bolt zz-top nowhere", 7), ("nowhere", 3), ("", 3)):
        terms = {w for w in re.split(r"[^\w+#.\-]+", query.lower()) if w}
        scores = {i: round(sum(impact(i, w) for w in terms if w in ws), 6) for i, ws in words.items() if terms & set(ws)}
        want = sorted(scores.items(), key=lambda x: (-x[1], x[0]))[:k]
        assert [(r["id"], pytest.approx(r["score"], abs=2e-6)) for r in index.top(query, k).collect()] == want
    has_run = lambda ws, run: any(ws[p : p + len(run)] == run for p in range(len(ws)))
    for clauses in (["rare"], ["red bolt"], ["red bolt red", "com*"], ["a a"], ["com*", "rare"], ["nowhere"], ["red nowhere"], ["*"], [""], ["RED", "bolt"]):
        want = {}
        for i, ws in words.items():
            parts = []
            for c in clauses:
                run = [w for w in re.split(r"[^\w+#.\-]+", c.lower()) if w]
                if c.endswith("*"):
                    parts.append(sum(impact(i, w) for w in set(ws) if c[:-1] and w.startswith(c[:-1])))
                else:
                    parts.append(sum(impact(i, w) for w in set(run)) if run and has_run(ws, run) else 0)
            if all(parts):
                want[i] = pytest.approx(round(sum(parts), 6), abs=2e-6)
        assert {r["id"]: r["score"] for r in index.match(*clauses).collect()} == want, clauses


def test_search_reads_the_buckets_and_levels_of_its_terms_only(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    index = fulltext.TextIndex.build(docs, "doc_id", "text")
    own = index._within(index.blocks, ["than"])
    files = {f for f in index.blocks.inputFiles()}
    assert 0 < len(own.select("term", F.input_file_name().alias("f")).select("f").distinct().collect()) < len(files) / 4
    plan = own._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(bucket" in plan or "PartitionFilters: [bucket" in plan or "bucket#" in plan.split("PartitionFilters")[1][:80]
    levels = []
    scored = fulltext.TextIndex._scored
    try:
        fulltext.TextIndex._scored = lambda self, terms, chosen: levels.append(chosen) or scored(self, terms, chosen)
        index.top("than", 3).collect()
    finally:
        fulltext.TextIndex._scored = scored
    every = index._within(index.levels, ["than"]).count()
    assert len(levels[1]) < every  # the levels of small impact stay unread


def test_text_index_of_an_empty_table(spark):
    index = fulltext.TextIndex.build(spark.createDataFrame([], "id long, body string"), "id", "body")
    assert index.top("a", 3).collect() == index.match("a").collect() == index.match("a b").collect() == []


def test_searched_texts_reach_python_once(spark):
    """Only the text without white space goes to the workers that count its pairs, and comes back from none."""
    rows = spark.createDataFrame([(1, "Ab  aB\ncd"), (2, None), (3, "x")], "id long, body string")
    counted = search.pair_counts(rows, "body", ["ab", "ba", "zz"])
    assert counted.columns == ["id", "_pairs", "_shared"]
    assert sorted(map(tuple, counted.collect())) == [(1, 4, 2), (2, 0, 0), (3, 0, 0)]


def test_postings_are_made_where_texts_are_read(spark):
    texts = spark.createDataFrame([(1, ["a", "b", "a"]), (2, []), (3, ["b"])], "id long, words array<string>")
    made = fulltext.TextIndex._postings(texts)
    assert "Exchange" not in made._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, made.collect())) == [(1, 3, "a", [0, 2]), (1, 3, "b", [1]), (3, 1, "b", [0])]

"""The pipeline against the same stages by brute force."""

import collections
import zlib

import numpy as np
from pyspark.sql import functions as F
from test_operators import brute_components, brute_measures, library_tokenizer

import corpus_pipeline
from lorequarry.llm import quality_classifier, quality_rules


def test_stages(spark, sf):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "exact_dedup", "near_dedup", "best_fit_packing"]
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    verdict = {r["doc_id"]: r["kept"] for r in quality_rules.host_rules(docs).collect()}
    graded = quality_classifier.ratings_of(spark.read.parquet(f"{sf}/labels.parquet"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    want = {}
    for i, t in texts.items():
        n, _, _, _, repeats = brute_measures(t)
        if n >= 50 and 100 * repeats <= 50 * n and verdict[i]:
            want[i] = t
    first = corpus_pipeline.rules(spark, docs, sf)
    assert first.columns == docs.columns and {r["doc_id"] for r in first.collect()} == set(want)
    kept = {r["doc_id"] for r in quality_classifier.classify(first, graded).collect() if r["kept"]}
    second = corpus_pipeline.classifier(spark, first, sf)
    assert {r["doc_id"] for r in second.collect()} == kept
    groups = collections.defaultdict(list)
    for i in kept:
        groups["".join(texts[i].split())].append((-len(texts[i]), i))
    alone = {min(g)[1] for g in groups.values()}
    third = corpus_pipeline.exact(spark, second, sf)
    assert {r["doc_id"] for r in third.collect()} == alone
    components = brute_components({i: texts[i] for i in alone})
    fourth = corpus_pipeline.near(spark, third, sf)
    stay = {i for i, (_, root) in components.items() if root == i}
    assert fourth.columns == docs.columns and {r["doc_id"] for r in fourth.collect()} == stay
    encode, pieces = library_tokenizer(), set()
    for i in stay:
        ids = np.array([*encode(texts[i]), 0], "<u4")
        cuts = [0, *range((len(ids) - 1) % 2048 + 1, len(ids) + 1, 2048)]
        pieces |= {(i, k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))}
    final = corpus_pipeline.run(spark, sf).collect()
    assert {tuple(r)[:5] for r in final} == pieces and len(final) == len(pieces)
    places = collections.defaultdict(list)
    for r in final:
        places[r["sequence_id"]].append((r["offset"], r["length"]))
    for slots in places.values():
        ends = 0
        for offset, length in sorted(slots):
            assert offset == ends
            ends += length
        assert ends <= 2048


def test_stages_take_odd_tables(spark, sf, tmp_path):
    """Nulls, repeated rows, clashing columns and an empty table go through every stage."""
    from test_operators import CLASH, LONG
    from pyspark.sql import functions as F

    good = " ".join(f"word{i}" for i in range(80))
    rows = [(1, None), (2, ""), (3, good), (3, good), (4, good + " "), (5, LONG), (None, good + " more"), (6, " ".join(f"other{i}" for i in range(90)))]
    docs = spark.createDataFrame([(i, t, None, None, 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit("x") for c in CLASH})
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    for table in (docs, docs.limit(0)):
        at = table
        for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, at, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == docs.columns
            at = out
        left = at.select("doc_id").distinct().collect()
        assert len(left) <= 4 and (table is docs) == bool(left)


def test_a_verdict_decides_on_its_row_only(spark, tmp_path):
    """Rejected rows with a null or a repeated id leave the clean rows of that id."""
    good = [" ".join(f"{w}{i}" for i in range(80)) for w in ("alpha", "beta", "gamma")]
    rows = [(None, "short"), (None, good[0]), (1, "short"), (1, good[1]), (2, good[2]), (2, None)]
    docs = spark.createDataFrame([(i, t, str(k)) for k, (i, t) in enumerate(rows)], "doc_id long, text string, source string")
    left = corpus_pipeline.rules(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r["text"] for r in left.collect()) == good
    poor, fine = [t + " bad" for t in good], [t + " fine" for t in good]
    rated = [(100 + i, " ".join(f"{k}x{j}" for j in range(60)) + (" bad" if i % 2 else " fine"), "s") for i, k in enumerate(range(400))]
    rows = [(None, poor[0], "s"), (None, fine[0], "s"), (1, poor[1], "s"), (1, fine[1], "s"), *rated]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    spark.createDataFrame([(100 + i, 1 - i % 2, 0) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    left = {r["text"] for r in corpus_pipeline.classifier(spark, docs, str(tmp_path)).collect()}
    assert set(fine[:2]) <= left and not left & set(poor)
    far = [" ".join(f"{w}{i}" for i in range(80)) for w in ("delta", "eps")]
    docs = spark.createDataFrame([(5, far[0]), (7, far[0] + " more"), (7, far[1]), (-1, good[0]), (-1, good[1])], "doc_id long, text string").withColumn("source", F.lit("s"))
    left = corpus_pipeline.near(spark, docs, str(tmp_path))
    assert left.columns == docs.columns and sorted(r["text"] for r in left.collect()) == sorted([*far, *good[:2]])

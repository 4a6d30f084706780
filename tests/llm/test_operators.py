"""Each operator against a brute-force version, and the same odd table through all of them."""

import base64
import bisect
import collections
import hashlib
import itertools
import math
import random
import re
import struct
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
import zstandard
from pyspark.sql import functions as F

from lorequarry import staging
from lorequarry.llm import bpe, common, exact_dedup, language_id, license_scan, near_dedup, packing, prefix_trie, pretokens, quality_classifier, quality_rules, queries, sharding, spelling, token_counts, token_output

MULTI, JSON = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json")
WORD = public_tokenizers.path("word_bpe_49k.json")
LONG = " ".join(f"word{i % 977}" for i in range(20_000)) + "a" * 3000
ODD = [(1, None), (2, ""), (3, " \n\t"), (4, "alpha beta gamma delta epsilon zeta"), (4, "alpha beta gamma delta epsilon zeta"), (5, "alpha  beta gamma delta epsilon zeta"), (6, LONG), (None, "no id here"), (7, "Don't 'tis ''s\r\n é 😀 ␀ \x1c"), (8, "under the MIT License\ncc-by-nc")]
CLASH = ["kept", "n_words", "hash", "norm", "bucket", "label", "features", "_part", "_id", "host", "bands", "ids"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with the names that operators use."""
    rows = spark.createDataFrame([(i, t, "en", "h" if i != 2 else None) for i, t in ODD], "doc_id long, text string, lang string, source string")
    return rows.withColumns({c: F.lit("x") for c in CLASH})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet")


@pytest.fixture(scope="module")
def texts(docs):
    return {r["doc_id"]: r["text"] or "" for r in docs.collect()}


OPERATORS = {
    "bpe": lambda d: bpe.encode_documents(d, MULTI, with_ids=True),
    "language": language_id.identify,
    "sharding": sharding.assign_shards,
    "rules": quality_rules.host_rules,
    "classifier": lambda d: quality_classifier.classify(d, d.sparkSession.createDataFrame([(4, 2), (8, 0)], "doc_id long, grade int")),
    "exact": exact_dedup.exact_dedup,
    "near": near_dedup.near_dedup,
    "license": license_scan.license_scan,
    "counts": lambda d: token_counts.count_tokens(d, WORD),
    "tokens": lambda d: token_output.read_tokens(*token_output.write_tokens(d, JSON, 2)),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_odd_rows_all_come_back(name, odd):
    found = OPERATORS[name](odd).collect()
    assert collections.Counter(r["doc_id"] for r in found) == collections.Counter(i for i, _ in ODD)


@pytest.mark.parametrize("name", [*OPERATORS, "packing"])
def test_empty_table(name, odd):
    run = OPERATORS.get(name, lambda d: packing.pack_documents(d, JSON))
    assert run(odd.limit(0)).collect() == []


# ---------------------------------------------------------------- tokenizers
def tiktoken_encoder():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(MULTI, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def library_tokenizer():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(JSON)
    t.encode_special_tokens = True
    return lambda text: t.encode(text, add_special_tokens=False).ids


def strange_texts():
    rnd = random.Random(3)
    out = ["", "a" * 1000, "ab" * 700, " Ᲊx \x1c\x85  ", "՘q", "😀" * 400, "don't 'tis 's' 're're ''s !'s '", "'", "'r", "\n's", "a'll'd", "  ", "a  ", "a \n b", "it's\n\n\tok  go", "<|endoftext|>"]
    out += ["".join(chr(rnd.choice([rnd.randrange(32, 127), rnd.randrange(0x20, 0xD7FF), rnd.randrange(0xE000, 0x10FFFF)])) for _ in range(rnd.randrange(200))) for _ in range(60)]
    return out + ["".join(rnd.choice(" '  \n\tstrevmlda1!é　") for _ in range(rnd.randrange(60))) for _ in range(800)]


def test_encoders_equal_their_libraries():
    pairs, encoder = bpe.byte_pairs(MULTI)
    for own, reference in ((encoder, tiktoken_encoder().encode_ordinary), (pretokens.library_encoder(JSON), library_tokenizer())):
        data = strange_texts()
        ids, ends = own.encode(pa.array(data, pa.large_string()))
        for k, t in enumerate(data):
            assert ids[ends[k] : ends[k + 1]].tolist() == reference(t), t
    flat, _ = pairs.tokens.gather(encoder.encode(pa.array(data, pa.large_string()))[0].astype(np.int64))
    assert flat.tobytes().decode() == "".join(data)


def test_encoder_with_a_full_table():
    pairs, _ = bpe.byte_pairs(MULTI)
    small, big = pretokens.Encoder(pairs.encode_many, bits=6), pretokens.Encoder(pairs.encode_many)
    for part in range(0, 400, 40):
        data = pa.array(strange_texts()[part : part + 40], pa.large_string())
        assert [x.tolist() for x in small.encode(data)] == [x.tolist() for x in big.encode(data)]


def thue_morse(n):
    """A text and its complement that sums of symbols times powers can't tell apart."""
    text = "a"
    while len(text) < n:
        text += text.translate(str.maketrans("ab", "ba"))
    return text, text.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [32, 1024, 2048])
def test_texts_with_equal_sums_stay_apart(n):
    a, b = thue_morse(n)
    for own, reference in ((bpe.byte_pairs(MULTI)[1], tiktoken_encoder().encode_ordinary), (pretokens.library_encoder(JSON), library_tokenizer())):
        ids, ends = own.encode(pa.array([a, b, a], pa.large_string()))
        assert [ids[ends[k] : ends[k + 1]].tolist() for k in range(3)] == [reference(t) for t in (a, b, a)]
    buffers = common.utf8(pa.array([a + "\n" + b + "\n" + a], pa.large_string()))
    assert quality_rules.measures(*buffers)["n_dup_lines"].tolist() == [1]
    _, x = near_dedup.shingle_hashes(*common.utf8(pa.array([a, b], pa.large_string())))
    assert x[0] != x[1]


def test_pieces_of_one_hash_keep_their_ids(monkeypatch):
    """All pieces of one length share a hash here, so only the comparison of bytes tells them apart."""
    monkeypatch.setattr(pretokens, "span_hashes", lambda data, lo, hi: (hi - lo).astype(np.uint64) << np.uint64(50))
    pairs, _ = bpe.byte_pairs(MULTI)
    own, reference = pretokens.Encoder(pairs.encode_many), tiktoken_encoder().encode_ordinary
    for part in range(0, 400, 100):
        data = strange_texts()[part : part + 100]
        ids, ends = own.encode(pa.array(data, pa.large_string()))
        assert [ids[ends[k] : ends[k + 1]].tolist() for k in range(len(data))] == [reference(t) for t in data]


def test_comparison_of_bytes():
    table = pretokens.PieceTable(6)
    pieces = [b"", b"a", b"12345678", b"123456789", b"1234567890abcdefg"]
    table.add(np.arange(1, 6, dtype=np.uint64) << np.uint64(58), pieces, [np.array([k], np.uint32) for k in range(5)])
    raw = np.frombuffer(b"1234567890abcdefgX123456789Y1234567890abcdefh", np.uint8)
    view = common.lanes(raw)
    cases = [(4, 0, 17, True), (4, 28, 17, False), (3, 0, 9, True), (3, 18, 9, True), (3, 1, 9, False), (2, 0, 8, True), (2, 0, 9, False), (0, 5, 0, True), (1, 10, 1, True), (1, 11, 1, False)]
    entry, lo, n, want = (np.array(x) for x in zip(*cases))
    assert table.same(entry, view, lo, n).tolist() == want.tolist()


def test_op1(spark, sf, texts):
    reference = tiktoken_encoder()
    for r in queries.op1_byte_bpe(spark, sf).collect():
        ids = reference.encode_ordinary(texts[r["doc_id"]])
        assert r["n_tokens"] == len(ids) and r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest()


def test_op8(spark, sf, texts):
    encode, at = library_tokenizer(), 0
    found = {r["doc_id"]: r for r in queries.op8_token_output(spark, sf).collect()}
    for i in sorted(texts):
        ids = [*encode(texts[i]), 2]
        assert tuple(found[i])[1:] == (at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)


def test_codes_round_trip():
    rng = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        ranks = (rng.integers(0, 2**32, n) >> rng.integers(0, 32, n)).astype(np.uint32)
        assert token_output.unpack(*token_output.pack(ranks), n).tolist() == ranks.tolist()


# ---------------------------------------------------------------- packing and sharding
def test_plans_are_valid_and_tight():
    rng = np.random.default_rng(1)
    for _ in range(40):
        capacity = int(rng.integers(8, 300))
        histogram = np.zeros(capacity + 1, np.int64)
        histogram[1:] = rng.integers(0, 30, capacity) * (rng.random(capacity) < 0.5)
        histogram[int(rng.integers(1, capacity + 1))] += 1000
        got, sequences = np.zeros(capacity + 1, np.int64), 0
        for n, slots in packing.plan(histogram, capacity, int(rng.integers(1, 100))):
            assert sum(a * b for a, b in slots) <= capacity
            sequences += n
            for length, k in slots:
                got[length] += n * k
        assert (got == histogram).all()


@pytest.mark.parametrize("capacity", [2048, 64])
def test_packing(odd, docs, texts, capacity):
    encode = library_tokenizer()
    for table, rows in ((docs, list(texts.items())), (odd, [(i, t or "") for i, t in ODD])):
        got = collections.defaultdict(list)
        places, total = collections.defaultdict(list), 0
        for r in packing.pack_documents(table, JSON, capacity=capacity).collect():
            got[r["doc_id"]].append((r["piece"], r["start"], r["length"], r["ids_crc32"]))
            places[r["sequence_id"]].append((r["offset"], r["length"]))
        want = collections.defaultdict(list)
        for i, t in rows:
            ids = np.array([*encode(t), 0], "<u4")
            total += len(ids)
            cuts = [0, *range((len(ids) - 1) % capacity + 1, len(ids) + 1, capacity)]
            want[i] += [(k, a, b - a, zlib.crc32(ids[a:b].tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
        assert {k: sorted(v) for k, v in got.items()} == {k: sorted(v) for k, v in want.items()}
        for slots in places.values():
            at = 0
            for offset, length in sorted(slots):
                assert offset == at
                at += length
            assert at <= capacity
        assert len(places) <= 1.03 * total / capacity + 2


def test_sharding(spark, sf, docs, texts):
    rows = queries.op3_sharding(spark, sf).collect()
    by = collections.defaultdict(list)
    for r in rows:
        by[r["shard"]].append(r["slot"])
        raw = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"], r["law"], r["grown_shard"]) == (len(raw) + 1, zlib.crc32(raw), "rows", None)
    assert all(sorted(s) == list(range(len(s))) for s in by.values())
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    again = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(docs.repartition(7)).collect()}
    assert again == {r["doc_id"]: r["shard"] for r in rows}


def plain_ring(keys, shards, nodes, bounds):
    """Key by key: to the owner of its arc while there is room, the others afterwards clockwise to the first with room."""
    ring = sharding.Ring(shards, nodes)
    spots = sorted(zip(ring.at.tolist(), ring.owner.tolist()))
    places = [at for at, _ in spots]
    of = lambda at: bisect.bisect_left(places, at) % len(spots)
    room, taken, late = list(bounds), {}, []
    for key, at in sorted(keys, key=lambda k: (of(k[1]), k[1] if k[1] > places[-1] or of(k[1]) else k[1] + 2**64, k[0])):
        shard = spots[of(at)][1]
        if room[shard]:
            room[shard] -= 1
            taken[key] = shard
        else:
            late.append((key, of(at)))
    for key, arc in late:
        while True:
            arc = (arc + 1) % len(spots)
            if room[spots[arc][1]]:
                room[spots[arc][1]] -= 1
                taken[key] = spots[arc][1]
                break
    return taken


@pytest.mark.parametrize("headroom", [0.0, 0.2])
def test_sharding_against_a_plain_ring(spark, headroom):
    ids = list(range(0, 3000, 7)) + [-5, 2**40]
    signed = lambda x: x - 2**64 if x >= 2**63 else x
    keys = [(i, signed(xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42))) for i in ids]
    rows = spark.createDataFrame([(i, "x") for i in ids], "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: r["shard"] for r in sharding.assign_shards(rows, shards=5, virtual_nodes=3, headroom=headroom).collect()}
    bounds = sharding.bounds_of(len(ids), 5, headroom).tolist()
    assert collections.Counter(got.values()) == collections.Counter(plain_ring(keys, 5, 3, bounds).values())
    assert sum(got[i] != s for i, s in plain_ring(keys, 5, 3, bounds).items()) <= 0.02 * len(ids)  # keys of the first arc may wrap around


def test_headroom_limits_movement(spark):
    rows = spark.range(4000).select(F.col("id").alias("doc_id"), F.lit("x").alias("text"))
    one, two = ({r["doc_id"]: r["shard"] for r in sharding.assign_shards(rows, shards=n, headroom=0.25).collect()} for n in (8, 9))
    assert max(collections.Counter(one.values()).values()) <= 625
    assert sum(one[k] != two[k] for k in one) < 0.3 * len(one)  # a hash modulo would move eight ninths


# ---------------------------------------------------------------- quality
def brute_measures(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    windows = collections.Counter(zip(w, w[1:], w[2:], strict=False))
    covered = {i + k for i, x in enumerate(zip(w, w[1:], w[2:], strict=False)) if windows[x] > 1 for k in range(3)}
    seen, repeated = set(), 0
    for line in t.split("\n"):
        if re.search(r"[^\x20\x09-\x0D]", line):
            repeated += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), repeated, len(covered)


def test_rules(spark, sf, texts):
    for r in queries.op4_host_rules(spark, sf).collect():
        n, chars, symbols, lines, repeats = brute_measures(texts[r["doc_id"]])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (n, chars, symbols, lines, repeats)
        failed = n < 50 or 100 * repeats > 50 * n
        assert r["base_failed"] == failed and not (failed and r["kept"])


def test_host_verdicts_by_a_plain_beta_prior(spark, sf, docs, texts):
    sources = {r["doc_id"]: r["source"] for r in docs.collect()}
    failed, base = {}, {}
    for i, t in texts.items():
        n, _, symbols, repeated, repeats = brute_measures(t)
        lines = sum(bool(x.strip(" \t\n\x0b\x0c\r")) for x in t.split("\n"))
        base[i] = n < 50 or 100 * repeats > 50 * n
        failed[i] = base[i] or 100 * symbols > 10 * n or 100 * repeated > 30 * lines
    hosts = collections.defaultdict(list)
    for i, host in sources.items():
        hosts[host].append(failed[i])
    rates = [sum(h) / len(h) for h in hosts.values()]
    mean = sum(rates) / len(rates)
    spread = sum((r - mean) ** 2 for r in rates) / len(rates) - mean * (1 - mean) * sum(1 / len(h) for h in hosts.values()) / len(hosts)
    strength = min(max(mean * (1 - mean) / max(spread, 1e-4 * mean * (1 - mean)) - 1, 2.0), 1e4)
    for r in queries.op4_host_rules(spark, sf).collect():
        host = hosts[sources[r["doc_id"]]]
        rate = (sum(host) + mean * strength) / (len(host) + strength)
        assert r["host_rate"] == pytest.approx(rate, abs=1e-9) and r["host_docs"] == len(host)
        assert r["kept"] == (not base[r["doc_id"]] and rate <= 0.5)


def test_bad_hosts_go_and_small_ones_are_shrunk(spark):
    good, bad = " ".join(f"w{i}" for i in range(80)), "x"
    rows = [(i, bad if i % 10 else good, "bad") for i in range(300)] + [(1000 + i, good, f"h{i % 9}") for i in range(900)] + [(5000, good, "tiny"), (5001, bad, "tiny")]
    found = {r["doc_id"]: r for r in quality_rules.host_rules(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert not found[0]["kept"] and found[1000]["kept"] and found[0]["host_rate"] > 0.5
    assert found[5000]["host_rate"] < 0.5 and found[5000]["kept"] and not found[5001]["kept"]


def test_classifier_on_held_out_rows(spark):
    folder = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet")
    ratings = quality_classifier.ratings_of(labels)
    held = F.crc32(F.col("doc_id").cast("string")) % 4 == 2
    graded = quality_classifier.classify(docs.join(ratings.filter(held).select("doc_id"), "doc_id", "left_semi").unionByName(docs.join(ratings.filter(~held).select("doc_id"), "doc_id", "left_semi")), ratings.filter(~held))
    kept = {r["grade"]: r["k"] for r in graded.join(ratings.filter(held), "doc_id").groupBy("grade").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()}
    assert kept[2] > 0.97 and kept[0] < 0.05 and kept[1] < 0.7


def test_ordinal_fit_orders_grades():
    rng = np.random.default_rng(0)
    grade = rng.integers(0, 3, 600)
    doc = np.repeat(np.arange(600), 3)
    feature = (grade[doc] * 10 + rng.integers(0, 5, 1800)).astype(np.int64)
    model = quality_classifier.fit(doc, feature, grade, 3)
    tails = model.tails(doc, feature, 600)
    means = [tails.sum(1)[grade == g].mean() for g in range(3)]
    assert means[0] < 0.3 and 0.7 < means[1] < 1.3 and means[2] > 1.7 and (np.diff(model.thresholds) >= 0).all()


def test_fit_against_plain_gradient_descent():
    """The same likelihood by loops over documents and small steps gives the same tails."""
    rng = np.random.default_rng(4)
    grade = rng.integers(0, 3, 240)
    rows = [sorted({int(g) * 2 + int(x) for x in rng.integers(0, 8, 3)}) for g in grade]
    doc, feature = np.repeat(np.arange(240), [len(r) for r in rows]), np.concatenate([np.array(r) for r in rows])
    model = quality_classifier.fit(doc, feature, grade, 3)
    used = [f for f in range(16) if quality_classifier.informative(doc, feature, grade)[f]]
    weight, t = dict.fromkeys(used, 0.0), [-1.0, 1.0]
    sigma = lambda x: 1 / (1 + math.exp(-x))
    for step in range(4000):
        dw, dt = {f: quality_classifier.DECAY * w for f, w in weight.items()}, [0.0, 0.0]
        for r, g in zip(rows, grade.tolist()):
            score = sum(weight.get(f, 0.0) for f in r)
            up, low = (sigma(t[g] - score) if g < 2 else 1.0), (sigma(t[g - 1] - score) if g else 0.0)
            slope_up, slope_low = (up * (1 - up) if g < 2 else 0.0), (low * (1 - low) if g else 0.0)
            p = up - low
            for f in r:
                if f in dw:
                    dw[f] += (slope_up - slope_low) / p / 240
            if g < 2:
                dt[g] -= slope_up / p / 240
            if g:
                dt[g - 1] += slope_low / p / 240
        rate = 2.0
        weight = {f: w - rate * dw[f] for f, w in weight.items()}
        t = [x - rate * d for x, d in zip(t, dt)]
    tails = model.tails(doc, feature, 240)
    plain = np.array([[1 - sigma(x - sum(weight.get(f, 0.0) for f in r)) for x in t] for r in rows])
    assert len(used) > 3 and np.abs(tails - plain).max() < 0.03


def test_language_by_a_plain_loop(spark, sf, docs):
    """The passages, their dictionaries and every prediction again, without Spark and arrays."""
    rows = docs.select("doc_id", "text", "lang").collect()
    learn = {}
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 4 != 2 and r["lang"] is not None and r["text"] is not None:
            h = xxhash.xxh64_intdigest(r["text"].encode(), seed=42)
            learn.setdefault(r["lang"], {})[h - 2**64 if h >= 2**63 else h] = r["text"]
    coders = {}
    for lang in sorted(learn, key=lambda x: (-len(learn[x]), x)):
        passages = []
        for h, t in sorted(learn[lang].items())[: language_id.TRAIN_ROWS]:
            at = (h >> 30) % (max(len(t) - language_id.PASSAGE_CHARS, 0) + 1)
            passages.append(language_id.normal(t[at : at + language_id.PASSAGE_CHARS]))
        d = zstandard.ZstdCompressionDict(b" ".join(passages), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        coders[lang] = zstandard.ZstdCompressor(dict_data=d, level=language_id.LEVEL, write_checksum=False, write_content_size=False)
    got = {r["doc_id"]: r for r in queries.op2_language(spark, sf).collect()}
    for r in rows:
        raw = language_id.normal(r["text"] or "")
        if not re.search(r"[^\W\d_]", r["text"] or ""):
            assert got[r["doc_id"]]["lang_pred"] == "und"
            continue
        sizes = {x: sum(len(c.compress(raw[k : k + language_id.BLOCK_BYTES])) for k in range(0, len(raw), language_id.BLOCK_BYTES)) for x, c in coders.items()}
        first, second = sorted(sizes.values())[:2]
        best = next(x for x in sizes if sizes[x] == first)
        mine = got[r["doc_id"]]
        assert mine["lang_pred"] == best and mine["score"] == pytest.approx(1 - first / second) and mine["confident"] == (1 - first / second >= language_id.MARGIN)


def test_ties_of_languages_go_to_the_larger(spark):
    rows = [(k, f"same words here {k}", lang) for lang, ks in (("b", range(0, 40)), ("a", range(0, 40))) for k in ks] + [(1000 + k, f"only b {k}", "b") for k in range(30)] + [(5000, "zz", None)]
    found = language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).filter("doc_id = 5000").first()
    assert found["lang_pred"] == "b" or found["score"] > 0


def test_language(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    found = language_id.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in found if r["held_out"]]
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2) for r in found)
    assert sum(r["lang"] == r["lang_pred"] for r in held) > 0.96 * len(held)
    assert all(0 <= r["score"] <= 1 for r in found)


def test_copies_count_once_in_a_dictionary(spark):
    """A text of thousands of copies takes one place of the sample, whatever its hash."""
    texts = [f"a text of many copies {c}" for c in "abcdefgh"]
    rows = [(t, "en") for t in texts for _ in range(1000)] + [(f"single text {chr(97 + i)}", "en") for i in range(20)]
    docs = spark.createDataFrame(rows, "text string, lang string")
    found = language_id.train(docs, F.lit(True), "text", "lang")["en"]
    assert all(found.count(language_id.normal(t)) == 1 for t, _ in rows)


def test_language_of_odd_texts(odd, docs):
    both = docs.select("doc_id", "text", "lang").unionByName(odd.select((F.col("doc_id") + 10**6).alias("doc_id"), "text", F.lit(None).cast("string").alias("lang")))
    found = {r["doc_id"]: r["lang_pred"] for r in language_id.identify(both).collect() if r["doc_id"] and r["doc_id"] > 10**6}
    assert [found[10**6 + i] for i in (1, 2, 3)] == ["und"] * 3 and found[10**6 + 4] != "und"


# ---------------------------------------------------------------- duplicates
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_equals_its_sql(name, same_as_sql, sf):
    same_as_sql(queries.QUERIES[name], queries.ORACLE_SQL[name], sf)


def test_exact_dedup_of_odd_rows(odd):
    found = collections.defaultdict(list)
    for r in exact_dedup.exact_dedup(odd, digest_all=True).collect():
        found[r["doc_id"]].append((r["keep_id"], r["group_size"], r["kept"]))
    assert sorted(found[4]) == [(5, 3, False), (5, 3, False)] and found[5] == [(5, 3, True)]
    assert found[3] == [(3, 3, True)] and found[1] == [(3, 3, False)]
    kept = exact_dedup.keep_distinct(odd)
    assert kept.columns == odd.columns and sorted(r["doc_id"] or 0 for r in kept.collect()) == [0, 3, 5, 6, 7, 8]


def test_repeated_rows_leave_one(odd):
    rows = odd.filter("doc_id = 4")
    assert sorted(r["kept"] for r in exact_dedup.exact_dedup(rows).collect()) == [False, True]
    assert exact_dedup.keep_distinct(rows).count() == 1


@pytest.mark.parametrize("few", [True, False])
def test_unique_texts_stay_beside_copies_of_their_id(spark, monkeypatch, few):
    if not few:
        monkeypatch.setattr(staging, "BROADCAST_BYTES", -1)
    x, y = "one two three", "another text"
    for rows, want in (
        ([(1, x), (2, x), (2, y)], [x, y]),
        ([(None, x), (None, x), (None, y), (None, y + " more"), (3, "third")], [x, y, y + " more", "third"]),
        ([(1, x), (2, x), (2, y), (2, y), (2, x + "  ")], [x + "  ", y]),
    ):
        kept = exact_dedup.keep_distinct(spark.createDataFrame(rows, "doc_id long, text string")).collect()
        assert sorted(r["text"] for r in kept) == sorted(want)


def brute_components(texts):
    sets = {}
    for i, t in texts.items():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t))
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    parent = {i: i for i in texts}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    ids = sorted(texts)
    for x, a in enumerate(ids):
        for b in ids[:x]:
            if sets[a] and sets[b] and 3 * max(len(sets[a]), len(sets[b])) <= 4 * min(len(sets[a]), len(sets[b])) and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: (len(sets[i]), root(i)) for i in ids}


def family(spark):
    """A family of changed copies, with some too far from most others, and documents that share a passage."""
    rnd = random.Random(5)
    base = [f"b{rnd.randrange(10**6)}" for _ in range(90)]
    rows = []
    for _ in range(150):
        w = list(base)
        for _ in range(rnd.choice([0, 1, 1, 2, 3, 4, 5])):
            w[rnd.randrange(90)] = f"c{rnd.randrange(10**6)}"
        rows.append(" ".join(w))
    passage = " ".join(base[:60])
    rows += [passage + " " + " ".join(f"d{rnd.randrange(10**6)}" for _ in range(rnd.randrange(5, 60))) for _ in range(120)]
    rows += ["one two", "One TWO", "one", "", "!"] + rows[:5]
    return dict(enumerate(rows, 1))


@pytest.mark.parametrize("large", [near_dedup.LARGE, 4])
def test_near_dedup_of_a_family(spark, monkeypatch, large):
    monkeypatch.setattr(near_dedup, "LARGE", large)
    monkeypatch.setattr(near_dedup, "BLOCK_SHINGLES", 1500)
    monkeypatch.setattr(near_dedup, "MEMBERS", 40)
    texts = family(spark)
    rows = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_dedup.near_dedup(rows).collect()}
    assert got == brute_components(texts)


def test_recall_of_links_on_the_thousand_document_table(spark):
    """Every document's component against an exact join of all pairs."""
    folder = "/root/testdata/sf0.01"
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_near_dedup(spark, folder).collect()}
    want = brute_components(texts)
    linked = [i for i, (_, root) in want.items() if root != i]
    print(f"recall of op7: {sum(got[i] == want[i] for i in linked)} of {len(linked)} linked documents, {len(texts)} in all")
    assert got == want


def test_near_dedup_of_documents(spark, sf, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in queries.op7_near_dedup(spark, sf).collect()}
    assert got == brute_components(texts)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, k) for k in range(101, 160)] + [(90, 150)]
    found = {r["node"]: r["label"] for r in near_dedup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(found[i] == 1 for i in range(1, 41)) and all(found[i] == 90 for i in [90, *range(100, 160)])


# ---------------------------------------------------------------- licenses, skew, scratch
def scan(spark, *texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r for _, r in sorted((r["doc_id"], r) for r in license_scan.license_scan(rows).collect())]


def test_license_blocks(spark):
    text = "x\nLicensed under the Apache License, v. 2.0\nThis work is licensed under GNU General Public License version 3\ncc, BY nc; CC by-NC\nunder the mit licensee"
    (r,) = scan(spark, text)
    assert (r["base_labels"], r["n_base"]) == ("cc-by-nc", 2)
    assert set(r["labels"].split(",")) == {"apache-2", "cc-by-nc", "gpl-3"} and r["score"] == 1.0


def test_wrapped_templates_are_found_and_near_ones_are_not(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\nmodification, are permitted"
    mit = "\n".join("filler text before it Permission is hereby granted, free of charge, to any person obtaining a copy of this software and more".split())
    found = scan(spark, bsd, mit, "Released under the Apache license", "words " * 300 + bsd.replace("\n", " ") + " words" * 100, "", None, "the license under released words")
    assert [r["labels"] for r in found] == ["bsd", "mit", "", "bsd", "", "", ""]


def test_blocks_against_all_pairs(spark):
    """Random texts of template words: every block and template above the threshold, and no other."""
    rnd = random.Random(2)
    templates = [("a", "p q r s t", "p"), ("b", "q r u", "u"), ("c", "p p s v w x y z k", "")]
    texts = [" ".join(rnd.choice("pqrstuvwxyzk") for _ in range(rnd.randrange(0, 60))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = sorted((r["doc_id"], r["span"], r["block"], r["label"], round(r["containment"], 6)) for r in license_scan.matching_blocks(rows, ["doc_id"], F.col("text"), 0.6, templates).collect())
    want = []
    for i, t in enumerate(texts):
        w = t.split()
        for label, words, must in templates:
            span, held = license_scan.span_of(words), set(words.split())
            for k, at in enumerate(range(0, max(1, len(w)), span)):
                both = held & set(w[at : at + 2 * span])
                if len(both) >= 0.6 * len(held) - 1e-9 and set(must.split()) <= both:
                    want.append((i, span, k, label, round(len(both) / len(held), 6)))
    assert got == sorted(want) and len(want) > 50


def test_native_plan_has_no_python(spark, sf):
    plan = queries.op9_license_scan(spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)


def test_attach_groups_with_a_hot_key(spark):
    rows = common.staged(spark.range(3000).select((F.col("id") % 7 * F.when(F.col("id") % 3 > 0, 0).otherwise(1)).alias("k"), "id"), "rows")
    groups = common.staged(rows.groupBy("k").agg(F.count("*").alias("n")), "groups")
    joined = common.attach_groups(rows, groups, ["k"], "n", 3000)
    assert joined.count() == 3000 and joined.filter("k = 0").select("n").distinct().count() == 1


def test_scratch_is_the_shared_folder(spark):
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.sql.warehouse.dir")
    assert common.scratch(spark).startswith(base)


# ---------------------------------------------------------------- 12
def test_counts_equal_the_library(spark, docs, texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORD)
    special = ["<|endoftext|>", "x<|endoftext|>Y<|startoftext|>'s <|endoftext", "ΣΑΣ İI ẞ", "e\u0301 a\u0323\u0300 \u0301x", " a\u3000b\x0bq", "9" * 300, "Ab" * 3000]
    data = strange_texts() + special
    for bits in (token_counts.TABLE_BITS, 6):  # a full table starts anew
        own = token_counts.Counter(WORD, bits).count(pa.array(data, pa.large_string()))
        assert own.tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in data]
    found = {r["doc_id"]: r for r in queries.op12_token_counts(spark, "/root/testdata/sf0.001").collect()}
    assert set(found) == set(texts)
    for i, t in texts.items():
        n = len(library.encode(t, add_special_tokens=False).ids)
        assert (found[i]["n_bytes"], found[i]["n_tokens"], found[i]["over_limit"]) == (len(t.encode()), n, n > 2048)


def test_words_of_one_hash_keep_their_counts(monkeypatch):
    monkeypatch.setattr(token_counts, "span_hashes", lambda data, lo, hi: (hi - lo).astype(np.uint64) << np.uint64(50))
    c = token_counts.Counter(WORD)
    for t in ("the qxz", "qxz the zzz", ""):
        assert c.count(pa.array([t], pa.large_string())).tolist() == [sum(map(c.merger.count, t.split()))]


@pytest.mark.parametrize("name", ["byte_bpe_50k.json"])
def test_tokenizers_that_keep_white_space_are_refused(name):
    with pytest.raises(ValueError):
        token_counts.Merger(public_tokenizers.path(name))


# ---------------------------------------------------------------- 11
def plain_variants(counts, ratio=5):
    def edits(w):
        out = {w[:i] + w[i + 1 :] for i in range(len(w))}
        out |= {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for c in letters for k in (0, 1)}
        return (out - {w}) & counts.keys()

    letters = set("".join(counts))
    form, near = {}, {}
    for w, n in counts.items():
        near[w] = edits(w)
        best = min(near[w], key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= ratio * n else None
    rows = set()
    for w, n in counts.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.add((w, form[w], root, n, len(near[w]), counts[form[w]] if form[w] is not None else None))
    return rows


def as_rows(found):
    return [tuple(r) for r in found.select("word", "form", "root", "n", "n_near", "form_n").collect()]


@pytest.mark.parametrize("letters,most,size", [("ab", 6, 1), ("abc", 5, 150), ("abcdeéÿ÷", 4, 400), ("z", 9, 1)])
def test_one_edit_pairs_against_all_edits(spark, letters, most, size):
    rnd = random.Random(len(letters))
    words = ["".join(w) for k in range(1, most + 1) for w in itertools.product(letters, repeat=k)]
    if size > 1:
        words = rnd.sample(words, size)
    counts = {w: rnd.choice([1, 2, 5, 5, 9, 50, 50, 600, 9000]) for w in words} | {"": 3}
    found = as_rows(spelling.variant_groups(spark.createDataFrame(list(counts.items()), "word string, n int")))
    assert len(found) == len(set(found)) == len(counts)
    assert set(found) == plain_variants(counts)


def test_variants_of_whole_documents(spark, sf, docs):
    counts = collections.Counter()
    for r in docs.collect():
        for run in re.findall("[A-Za-z\u00c0-\u00ff]+", r["text"] or ""):
            run = "".join(c.lower() if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{r['doc_id']}:{run}".encode())
            if h % 199 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}
    found = as_rows(queries.op11_spelling(spark, sf))
    assert len(found) == len(set(found)) and set(found) == plain_variants(counts)
    assert sum(1 for r in found if r[4]) > 100 and any(r[1] for r in found)


def test_variants_of_odd_tables(spark, odd):
    words = {r["word"]: r["n"] for r in spelling.spelling_variants(odd, min_count=2).collect()}
    assert words["epsilon"] == 3 and "word" not in words
    assert spelling.spelling_variants(odd.limit(0)).collect() == []
    assert spelling.count_runs(odd, 2, drop_one_in=1).filter("word = 'no'").count() == 0
    with pytest.raises(ValueError):
        spelling.variant_groups(odd.select(F.col("text").alias("word"), F.lit(1).alias("n")), ratio=1)


# ---------------------------------------------------------------- 13
def plain_trie(rows, heads=4, family=20):
    """rows: (conv_id, turn, role, text) in any order, without equal turns in a conversation."""
    own = collections.defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    members, ends, children = collections.defaultdict(list), collections.defaultdict(list), collections.defaultdict(set)
    for c in sorted(own):
        h = zlib.crc32(str(c).encode()) % heads
        path = tuple(own.get(c - c % family, [])[:h] + own[c][h:])
        ends[path].append(c)
        for d in range(len(path) + 1):
            members[path[:d]].append(c)
            if d:
                children[path[: d - 1]].add(path[:d])
    leaves, saved = {}, {}
    for path in sorted(members, key=len, reverse=True):
        below = children[path]
        n_words = len(re.findall(r"[^\x20\x09-\x0D]+", path[-1][1])) if path else 0
        leaves[path] = sum(leaves[p] for p in below) if below else 1
        saved[path] = (len(members[path]) - 1) * n_words + sum(saved[p] for p in below)
    hashed = lambda ids: hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
    return collections.Counter(
        (m[0], len(p), members[p[:-1]][0] if p else None, len(m), len(children[p]), leaves[p], saved[p], hashed(ends[p])) for p, m in members.items()
    )


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def trie_rows(found):
    assert found.columns == TRIE
    return collections.Counter(map(tuple, found.collect()))


def test_trie_of_all_conversations(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert trie_rows(queries.op13_prefix_trie(spark, sf)) == plain_trie(rows)


@pytest.mark.parametrize("seed,block_rows,kinds,longest", [(1, 100_000, 2, 4), (2, 3, 2, 6), (3, 2, 1, 9), (4, 7, 3, 3), (5, 5, 2, 30)])
def test_trie_over_many_blocks(spark, monkeypatch, seed, block_rows, kinds, longest):
    """Few kinds of turns, so that nodes reach over many blocks; copies, and conversations that others go on from."""
    monkeypatch.setattr(prefix_trie, "BLOCK_ROWS", block_rows)
    rnd, rows = random.Random(seed), []
    for c in rnd.sample(range(-30, 200), 60):
        for turn in rnd.sample([None, *range(40)], rnd.choice([1, 1, 2, longest, longest])):
            rows.append((c, turn, rnd.choice(["user", None]) if kinds > 2 else "user", rnd.choice([None, " a  b ", "c", "x y z"][:kinds])))
    rnd.shuffle(rows)
    heads = 1 if seed == 3 else 4
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), heads)) == plain_trie(rows, heads)


def test_trie_of_one_large_conversation_and_its_copy(spark):
    """Two conversations with most of the rows, in many ranges; their key is as long as what they share."""
    rows = [(c, i, "user", f"turn {i} of many") for c in (7, 8) for i in range(1500)] + [(c, i, "user", str(c)) for c in range(20, 40) for i in range(3)] + [(8, 1500, "user", "more")]
    assert trie_rows(prefix_trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"), 1)) == plain_trie(rows, 1)


def test_trie_of_odd_tables(spark):
    schema = "conv_id long, turn long, role string, text string, depth string, L string, part string, len string"
    rows = [(None, 1, "user", "no conversation"), (3, None, None, None), (3, 1, "user", ""), (3, 1, "user", ""), (5, 0, "", ""), (61, 0, "user", LONG)]
    table = spark.createDataFrame([(*r, "x", "x", "x", "x") for r in rows], schema)
    found = trie_rows(prefix_trie.prefix_trie(table))
    assert sum(found.values()) == 1 + 1 + 2 + 1 and {r[0] for r in found} == {3, 61}
    assert trie_rows(prefix_trie.prefix_trie(table.limit(0))) == {}
    turnless = table.filter("conv_id = 5")  # it has one turn, and its first turns are another's that isn't there
    assert zlib.crc32(b"5") % 4 and trie_rows(prefix_trie.prefix_trie(turnless, 4)) == {(5, 0, None, 1, 0, 1, 0, hashlib.sha256(b"5").hexdigest()): 1}


def test_nearest_smaller_values():
    rnd = random.Random(1)
    for n in (1, 2, 9, 40):
        v = [rnd.randrange(5) for _ in range(n)]
        left, right, first = prefix_trie.nearest_smaller(v)
        for i in range(n):
            assert left[i] == max((j for j in range(i) if v[j] < v[i]), default=-1)
            assert right[i] == min((j for j in range(i, n) if v[j] < v[i]), default=n)
            assert first[i] == min(j for j in range(left[i] + 1, i + 1) if v[j] == v[i])


# ---------------------------------------------------------------- 5
def plain_features(text):
    """Slots of a text, one by one."""
    raw = text.encode()
    lower = bytes(c + 32 if 65 <= c <= 90 else c for c in raw)
    runs = re.findall(rb"[A-Za-z0-9\x80-\xff]+|[^A-Za-z0-9\x80-\xff\x20\x09-\x0d]+", lower)
    one = lambda b: int(common.span_hashes(np.frombuffer(b, np.uint8), np.array([0]), np.array([len(b)]))[0]) >> 64 - quality_classifier.BITS
    slots = {one(b) for b in runs}
    n, signs = len(runs), sum(1 for b in runs if not re.match(rb"[A-Za-z0-9\x80-\xff]", b))
    letters = len(re.findall(rb"[A-Za-z0-9\x80-\xff]", raw))
    shapes = [len(re.findall(rb"[A-Z]", raw)) / max(letters, 1), len(slots) / max(n, 1), signs / max(n, 1), math.log2(n + 1) / 20]
    return slots | {(1 << quality_classifier.BITS) + 11 * k + min(int(v * 10), 10) for k, v in enumerate(shapes)}


def test_features_are_distinct_and_shapes_have_slots_of_their_own(texts):
    data = [*texts.values(), "", "...", "A", LONG]
    doc, feature = quality_classifier.features(*common.utf8(pa.array(data, pa.large_string())))
    assert len(set(zip(doc.tolist(), feature.tolist(), strict=True))) == len(doc)
    own = collections.defaultdict(set)
    for d, f in zip(doc.tolist(), feature.tolist(), strict=True):
        own[d].add(f)
    assert [own[d] for d in range(len(data))] == [plain_features(t) for t in data]
    # a word whose hash would have been a shape's: words end below the shapes' slots, whatever they are
    assert max(f for d in own for f in sorted(own[d])[: -quality_classifier.SHAPES]) < 1 << quality_classifier.BITS


def test_classifier_against_a_plain_loop(spark, sf, docs, texts):
    """The whole query, where some rated documents stand in the table three times."""
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    grade = {}
    for r in quality_classifier.ratings_of(labels).collect():
        if r["grade"] is not None:
            grade[r["doc_id"]] = min(r["grade"], grade.get(r["doc_id"], 9))
    rated = [i for i in texts if i in grade]
    pairs = [(k, f) for k, i in enumerate(rated) for f in plain_features(texts[i])]
    doc, feature = (np.array(c) for c in zip(*pairs, strict=True))
    with np.errstate(all="raise"):
        model = quality_classifier.fit(doc, feature, np.array([grade[i] for i in rated]), 3)
    again = docs.filter("doc_id % 5 = 0")
    rows = quality_classifier.classify(docs.unionByName(again).unionByName(again), quality_classifier.ratings_of(labels)).collect()
    assert len(rows) == len(texts) + 2 * sum(1 for i in texts if i % 5 == 0)
    for r in rows:
        score = sum(model.weights[f] for f in plain_features(texts[r["doc_id"]]))
        tails = [1 - 1 / (1 + math.exp(score - t)) if abs(score - t) < 30 else float(score > t) for t in model.thresholds]
        assert [r["tail_1"], r["tail_2"]] == pytest.approx(tails, abs=1e-6)
        assert r["expected_grade"] == pytest.approx(sum(tails), abs=1e-6) and r["kept"] == (r["tail_2"] >= 0.5)


# ---------------------------------------------------------------- 8
def test_tokens_of_one_id_are_many_tasks(spark):
    """An id with half of the rows, and null ids with a third, are dealt to several partitions, in ascending order still."""
    rows = [(None, f"null {i}") for i in range(200)] + [(5, f"five {i}") for i in range(300)] + [(i, f"doc {i}") for i in range(100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    spark.conf.set("spark.sql.shuffle.partitions", "12")
    try:
        tokens = token_output.tokenize(docs, JSON, 2, "doc_id", "text")
        sizes = {(r["doc_id"], r["_part"]): r["count"] for r in tokens.groupBy("doc_id", "_part").count().collect()}
        assert max(sizes.values()) <= 80 and sum(1 for i, _ in sizes if i == 5) > 3 and sum(1 for i, _ in sizes if i is None) > 3
        found = token_output.read_tokens(*token_output.write_tokens(docs, JSON, 2)).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
    ids = [r["doc_id"] if r["doc_id"] is not None else -1 for r in found]
    assert ids == sorted(ids) and collections.Counter(ids) == {-1: 200, 5: 301, **{i: 1 for i in range(100) if i != 5}}
    assert [r["start"] for r in found] == [0, *np.cumsum([r["n_tokens"] for r in found])[:-1].tolist()]

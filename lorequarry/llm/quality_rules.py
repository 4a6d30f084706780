"""Operator 4: host-level quality rules with an empirical beta prior."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE, attach_groups, chunks, mix, span_hashes, staged, tidied, utf8, words

#: The base rule: fewer words fail, and so does a larger percentage of repeated words.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: Further rules that count against a host: symbols in a hundred words, and the percentage of repeated lines.
MAX_SYMBOLS_PERCENT, MAX_DUP_LINES_PERCENT = 10, 30
#: A host goes if its shrunk rate of failing documents is above this.
MAX_HOST_RATE = 0.5

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True


def combine(hashes: list[np.ndarray]) -> np.ndarray:
    """One hash of a sequence of hashes."""
    out = hashes[0]
    for h in hashes[1:]:
        out = mix(out * np.uint64(0x9FB21C651E98DF25) + h)
    return out


def measures(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts for each document of one chunk of texts."""
    n = len(at) - 1
    starts, ends, first = words(data, at)
    n_words = np.diff(first)

    def within(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[at[1:]] - total[at[:-1]]

    inside = ~SPACE[data]
    out = {"n_words": n_words, "word_chars": within(inside & ((data & 0xC0) != 0x80)), "n_symbols": within(_SYMBOL[data])}
    # lines: those with a word, and of these the ones equal to an earlier one
    breaks = np.flatnonzero(data == 10)
    doc_of = np.searchsorted(at, breaks, "right") - 1
    every = np.arange(n)
    line_start, line_end, line_doc = np.concatenate([at[:-1], breaks + 1]), np.concatenate([breaks, at[1:]]), np.concatenate([every, doc_of])
    order = np.lexsort((line_start, line_doc))
    line_start, line_doc, line_end = line_start[order], line_doc[order], line_end[np.lexsort((line_end, np.concatenate([doc_of, every])))]
    filled = np.concatenate([[0], np.cumsum(inside)])
    has_word = filled[line_end] > filled[line_start]
    line_start, line_end, line_doc = line_start[has_word], line_end[has_word], line_doc[has_word]
    hashes = span_hashes(data, line_start, line_end)
    order = np.lexsort((hashes, line_doc))
    same = (hashes[order][1:] == hashes[order][:-1]) & (line_doc[order][1:] == line_doc[order][:-1])
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    out["n_dup_lines"] = np.bincount(line_doc[order][1:][same], minlength=n)
    # words in a window of three that stands twice or more in the text
    word_doc = np.repeat(every, n_words)
    covered = np.zeros(len(starts) + 2, bool)
    if len(starts) > 2:
        h = span_hashes(data, starts, ends)
        window = np.flatnonzero(word_doc[2:] == word_doc[:-2])
        key = mix(combine([h[window], h[window + 1], h[window + 2]]) ^ mix(word_doc[window].astype(np.uint64)))
        order = np.argsort(key)
        equal = key[order][1:] == key[order][:-1]
        twice = window[order[np.concatenate([[False], equal]) | np.concatenate([equal, [False]])]] if len(window) else window
        for k in range(3):
            covered[twice + k] = True
    out["n_repeat_words"] = np.bincount(word_doc[covered[: len(starts)]], minlength=n)
    return out


MEASURES = ["n_words", "word_chars", "n_symbols", "n_lines", "n_dup_lines", "n_repeat_words"]


def measure(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    """doc_id, host and the measures of each document, where it is read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in chunks(batch):
                found = measures(*utf8(texts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("host"), *(pa.array(found[m].astype(np.int64)) for m in MEASURES)], ["doc_id", "host", *MEASURES])

    kind = docs.schema[id_col].dataType.simpleString()
    source = docs.select(docs[id_col].alias("doc_id"), F.coalesce(F.concat(F.lit("host "), docs[host_col].cast("string")), F.lit("")).alias("host"), docs[text_col].alias("text"))
    return source.mapInArrow(tidied(run), f"doc_id {kind}, host string, " + ", ".join(f"{m} long" for m in MEASURES))


def beta_prior(hosts: DataFrame) -> tuple[float, float]:
    """The beta distribution of hosts' failure rates by moments, less what chance adds to their spread."""
    rate = F.col("failed") / F.col("docs")
    mean, spread, chance, n = hosts.agg(F.avg(rate), F.var_pop(rate), F.avg(1 / F.col("docs")), F.count("*")).first()
    if not n or mean in (0.0, 1.0):
        return 1.0, 1.0
    spread = max(spread - mean * (1 - mean) * chance, 1e-4 * mean * (1 - mean))
    strength = min(max(mean * (1 - mean) / spread - 1, 2.0), 1e4)
    return mean * strength, (1 - mean) * strength


def host_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rules for every document: doc_id, the base measures, base_failed, kept, then n_lines, host_docs, host_rate.

    A document fails if it fails the base rule, or has too many symbols or repeated lines. Failures are
    summed by host, a host's rate is shrunk towards all hosts' rates by their beta prior, and a host above
    max_host_rate loses its documents. kept: neither base_failed nor of such a host.

    Texts are read once and stay where they are; numbers move. Hosts that hold a thousandth of all rows
    are broadcast, the others meet in a shuffle. Documents with a null host share a host of their own. A null or
    empty text has no words and fails; a null id is kept; repeated rows are judged each; a very long text is
    measured whole, in a step of its own; a rate that equals max_host_rate keeps its host; an empty table
    gives no rows; other columns are never read, whatever their names.
    """
    found = measure(docs, id_col, text_col, host_col)
    base = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    extra = (100 * F.col("n_symbols") > MAX_SYMBOLS_PERCENT * F.col("n_words")) | (100 * F.col("n_dup_lines") > MAX_DUP_LINES_PERCENT * F.col("n_lines"))
    rows = staged(found.withColumn("base_failed", base).withColumn("_failed", base | extra), "measures")
    hosts = staged(rows.groupBy("host").agg(F.count("*").alias("docs"), F.sum(F.col("_failed").cast("int")).alias("failed")), "hosts")
    a, b = beta_prior(hosts)
    total = hosts.agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]
    rated = hosts.select("host", F.col("docs").alias("host_docs"), ((F.col("failed") + a) / (F.col("docs") + a + b)).alias("host_rate"))
    judged = attach_groups(rows, rated, ["host"], "host_docs", total)
    kept = ~F.col("base_failed") & (F.col("host_rate") <= max_host_rate)
    return judged.select(F.col("doc_id").alias(id_col), *(m for m in MEASURES if m != "n_lines"), "base_failed", kept.alias("kept"), "n_lines", "host_docs", "host_rate")

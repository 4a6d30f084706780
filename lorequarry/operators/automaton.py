"""Dictionaries met with texts by an Aho-Corasick automaton: one pass over a text, whatever the dictionary's size.

The dictionary goes to the workers in parts of at most BROADCAST_BYTES, and each worker builds one automaton of
the parts of a scan; a dictionary beyond SCAN_BYTES is as many scans of the texts as it needs. No texts move.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator
from functools import reduce

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..staging import BROADCAST_BYTES, staged

#: Occurrences that leave a task at a time.
ROWS = 10_000
#: Bytes that the dictionary of a scan may take in a worker, at 64 a word and 16 a byte of it (words of ten letters took half of that).
SCAN_BYTES = 448 << 20
_built: dict[str, Dictionary] = {}


class Dictionary:
    """An automaton whose words lead to their numbers, the sizes of words, and the places of each in the columns of the dictionary."""

    def __init__(self, table: pa.Table):
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        sizes, numbers = [], []
        for chunk in table.column(0).chunks:
            for w in chunk.to_pylist():
                number = self.automaton.get(w, len(sizes)) if w else -1
                if number == len(sizes):
                    self.automaton.add_word(w, number)
                    sizes.append(len(w))
                numbers.append(number)
        if sizes:
            self.automaton.make_automaton()
        self.sizes, own = np.array(sizes, np.int64), np.array(numbers, np.int64)
        self.places = np.argsort(own, kind="stable")
        self.first = np.searchsorted(own[self.places], np.arange(len(sizes) + 1))
        self.columns = {c: table.column(c).combine_chunks() for c in table.column_names[1:]}

    def met(self, text: str) -> Iterator[tuple[int, int]]:
        """The end and the number of each word in a text."""
        return self.automaton.iter(text) if len(self.sizes) else iter(())


def _dictionary(name: str, parts: list) -> Dictionary:
    """The dictionary of a scan; a worker keeps one."""
    if name not in _built:
        _built.clear()
        _built[name] = Dictionary(pa.concat_tables([p.value for p in parts]))
    return _built[name]


def _scan(messages: DataFrame, signals: DataFrame, key: list[str], content: str, more: list[T.StructField], find, fold=F.lower) -> DataFrame:
    """key and the signals' columns but text, with what `find` adds for texts: rows of texts, numbers of words and the columns of more."""
    texts = messages.select(*key, F.coalesce(F.col(content), F.lit("")).alias("__lq_text"), fold(F.coalesce(F.col(content), F.lit(""))).alias("__lq_lower"))
    known = signals.filter("text is not null").select(fold(F.col("text")).alias("__lq_word"), *(c for c in signals.columns if c != "text"))
    carried = known.columns[1:]
    schema = T.StructType([*(messages.schema[k] for k in key), *(signals.schema[c] for c in carried), *more])
    size = F.octet_length("__lq_word")
    sent, held = known.agg(*(F.coalesce(F.sum(s), F.lit(0)) for s in (size + 64, size * 16 + 64))).first()
    scans = max(1, -(-held // SCAN_BYTES))
    parts = scans * max(1, -(-sent // (BROADCAST_BYTES * scans)))
    if parts > 1:
        known = staged(known, "dictionary")

    def one(scan: int) -> DataFrame:
        own = [known if parts == 1 else known.filter(F.pmod(F.xxhash64("__lq_word"), F.lit(parts)) == part) for part in range(scan, parts, scans)]
        name, tables = uuid.uuid4().hex, [messages.sparkSession.sparkContext.broadcast(p.toArrow()) for p in own]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            words = _dictionary(name, tables)
            for batch in batches:
                for rows, numbers, values in find(words, batch.column("__lq_text").to_pylist(), batch.column("__lq_lower").to_pylist()):
                    n = words.first[numbers + 1] - words.first[numbers]
                    each = np.repeat(np.arange(len(numbers)), n)
                    slot = pa.array(words.places[np.repeat(words.first[numbers] - (np.cumsum(n) - n), n) + np.arange(len(each))])
                    columns = [batch.column(k).take(pa.array(rows[each])) for k in key] + [words.columns[c].take(slot) for c in carried]
                    yield pa.RecordBatch.from_arrays([*columns, *(v.take(pa.array(each)) for v in values)], schema.names)

        return texts.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(one, range(scans)))


def occurrences(messages: DataFrame, signals: DataFrame, key: list[str], content: str, radius: int = 50) -> DataFrame:
    """Every place where a signal stands in a message, overlapping ones too: key, the signals' columns but text, start, context.

    start: code points before it in the message in lower case, from 0; context: the message's text around it,
    `radius` code points on either side, with ellipses where it is cut. Case is ignored. Signals of one text
    are each found; empty and null ones never; a null message has none.
    """

    def find(words: Dictionary, texts: list[str], lowers: list[str]) -> Iterator[tuple]:
        length = np.array([len(t) for t in texts], np.int64)

        def made(rows: list[int], ends: list[int], numbers: list[int]) -> tuple:
            row, end, number = (np.array(x, np.int64) for x in (rows, ends, numbers))
            start = end - words.sizes[number] + 1
            lo, hi = np.maximum(start - radius, 0), np.minimum(end + 1 + radius, length[row])
            cut = pa.array([texts[i][x:y] for i, x, y in zip(rows, lo.tolist(), hi.tolist(), strict=True)], pa.string())
            dots = lambda test: pc.if_else(pa.array(test), "...", "")
            return row, number, [pa.array(start), pc.binary_join_element_wise(dots(lo > 0), cut, dots(hi < length[row]), "")]

        rows, ends, numbers = [], [], []
        for i, lower in enumerate(lowers):
            for end, number in words.met(lower):
                rows.append(i)
                ends.append(end)
                numbers.append(number)
                if len(rows) >= ROWS:
                    yield made(rows, ends, numbers)
                    rows, ends, numbers = [], [], []
        if rows:
            yield made(rows, ends, numbers)

    return _scan(messages, signals, key, content, [T.StructField("start", T.LongType()), T.StructField("context", T.StringType())], find)


def _counted(words: Dictionary, texts: list[str], lowers: list[str]) -> Iterator[tuple]:
    """The numbers of the words of each text, each once, with how often they stand in it."""
    rows, numbers, hits = [], [], []
    for i, lower in enumerate(lowers):
        found = Counter(number for _, number in words.met(lower))
        rows += [i] * len(found)
        numbers += found.keys()
        hits += found.values()
        if len(rows) >= ROWS or i == len(lowers) - 1:
            yield np.array(rows, np.int64), np.array(numbers, np.int64), [pa.array(hits, pa.int64())]
            rows, numbers, hits = [], [], []


def counts(messages: DataFrame, signals: DataFrame, key: list[str], content: str) -> DataFrame:
    """The signals of a message and how often each stands in it, as in occurrences: key, the signals' columns but text, hits."""
    return _scan(messages, signals, key, content, [T.StructField("hits", T.LongType())], _counted)


def containing(texts: DataFrame, text: str, patterns: DataFrame, pattern: str) -> DataFrame:
    """All pairs of a text and a pattern that it contains, each once and by its very case: the columns of both sides. Empty and null patterns are in no pair."""

    def find(words: Dictionary, texts: list[str], lowers: list[str]) -> Iterator[tuple]:
        for rows, numbers, _ in _counted(words, texts, lowers):
            yield rows, numbers, []

    named = patterns.withColumnRenamed(pattern, "text").withColumn("__lq_own", F.col("text"))
    met = _scan(texts.filter(F.col(text).isNotNull()), named.filter("text <> ''"), texts.columns, text, [], find, lambda c: c)
    back = lambda df: df.withColumnRenamed("__lq_own", pattern).select(*texts.columns, *patterns.columns)
    return back(met)

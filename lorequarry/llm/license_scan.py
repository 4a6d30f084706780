"""Operator 9: license scan by an exact set-similarity join of text blocks with license templates.

A block is a run of words, whatever lines they stand on. For templates of up to c words, c a power of two,
blocks are 2c words long and start every c words, so that whatever c words follow each other lie in one block.
A template is found in a block that contains at least THRESHOLD of its words, as sets, and all that it must
have. Words are ordered by how rare they are in all texts. A block that contains enough of a template has one
of the template's rarest words, its prefix, so the join is on prefix words alone; length and position in the
order then exclude most of the rest, and the words left are counted.
Only DataFrame functions are used.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..staging import small

#: Part of a template's words that a block must contain.
THRESHOLD = 0.8
# The phrases of the base scan and their labels.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Templates: label, words, and the words without which it is another license.
TEMPLATES = [
    ("mit", "released under the mit license", "released mit"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", "hereby granted"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software", "hereby sublicense"),
    ("apache-2", "licensed under the apache license version 2 0", "licensed apache 2"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at", "apache"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3", "gnu 3"),
    ("gpl-3", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version", "gnu 3"),
    ("cc-by-nc", "licensed under cc by nc 4 0", "licensed cc nc"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", "redistribution"),
    ("bsd", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution", "redistributions"),
    ("all-rights-reserved", "all rights reserved", "reserved"),
]
# Words are runs of what these classes leave: ASCII digits and letters, and everything beyond ASCII.
_BETWEEN = r"[\x00-/:-@\[-`{-\x7F]+"
_WORD = r"[^\x00-/:-@\[-`{-\x7F]"


def _lower(text: Column) -> Column:
    """ASCII letters in lower case."""
    return F.translate(text, string.ascii_uppercase, string.ascii_lowercase)


def _words(text: Column) -> Column:
    """The words of a text in lower case, as an array without empty ones."""
    return F.filter(F.split(_lower(text), _BETWEEN), lambda w: w != "")


def _finds(phrases: list[str]) -> str:
    """A pattern for any of the phrases, over whole words, in either case."""
    return rf"(?i)(?<!{_WORD})(?:" + "|".join(p.replace(" ", _BETWEEN) for p in phrases) + rf")(?!{_WORD})"


def _places(tokens: str, phrase: list[str]) -> Column:
    """Where the phrase's words follow each other, counted from 0."""
    here = F.array(*map(F.lit, phrase))
    at = F.transform(tokens, lambda _, i: F.when(F.slice(tokens, i + 1, len(phrase)) == here, i))
    return F.filter(at, lambda i: i.isNotNull())


def span_of(words: str) -> int:
    """The power of two that a template's number of words is at most."""
    return 1 << max(0, len(words.split()) - 1).bit_length()


def word_order(docs: DataFrame, text: Column, vocabulary: DataFrame) -> dict[str, int]:
    """How often each word of the templates (one column, word) stands in all texts; a row for each reaches the driver."""
    found = docs.select(F.explode(F.split(_lower(text), _BETWEEN)).alias("word")).join(small(vocabulary), "word")
    return {r["word"]: r["n"] for r in found.groupBy("word").agg(F.count("*").alias("n")).collect()}


def matching_blocks(docs: DataFrame, key: list[str], text: Column, threshold: float = THRESHOLD, templates: list[tuple[str, str, str]] | None = None) -> DataFrame:
    """All blocks that contain a template: key, span, block (from 0), label, containment.

    docs are scanned for the counts and again for blocks, which are cut only of texts with a prefix word. The
    templates are tables that are joined on their words, so there may be many, of any length.
    """
    spark = docs.sparkSession
    sets = [(label, span_of(words), set(words.split()), must.split()) for label, words, must in templates or TEMPLATES]
    vocabulary = sorted(set().union(*(s for _, _, s, _ in sets)))
    counts = word_order(docs, text, spark.createDataFrame([(w,) for w in vocabulary], "word string"))
    order = {w: k for k, w in enumerate(sorted(vocabulary, key=lambda w: (counts.get(w, 0), w)))}
    prefixes, first_words = [], set()
    for k, (label, span, s, must) in enumerate(sets):
        ranked = sorted(order[w] for w in s)
        need = -(-len(ranked) * round(threshold * 1000) // 1000)
        prefixes += [(r, k, label, span, i, ranked, need, [order[w] for w in must]) for i, r in enumerate(ranked[: len(ranked) - need + 1])]
        first_words |= {w for w in s if order[w] in ranked[: len(ranked) - need + 1]}
    index = spark.createDataFrame(prefixes, "rank int, template int, label string, span int, at int, ranked array<int>, need int, must array<int>")
    ranks = spark.createDataFrame(list(order.items()), "word string, rank int")
    spans = sorted({span for _, span, _, _ in sets})

    words = docs.select(*key, _words(text).alias("words")).filter(F.arrays_overlap("words", F.lit(sorted(first_words))))

    def cut(span: int) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size("words") - 1, F.lit(0)), F.lit(span))
        return F.transform(starts, lambda i: F.struct(F.lit(span).alias("span"), (i / span).cast("int").alias("block"), F.array_distinct(F.slice("words", i + 1, F.lit(2 * span))).alias("held")))

    blocks = words.select(*key, F.explode(F.concat(*map(cut, spans))).alias("b")).select(*key, "b.*").filter(F.arrays_overlap("held", F.lit(sorted(first_words))))
    each = blocks.select(*key, "span", "block", F.explode("held").alias("word")).join(small(ranks), "word")
    ranked = each.groupBy(*key, "span", "block").agg(F.array_sort(F.collect_set("rank")).alias("words"))  # two spans of words at most
    placed = ranked.select(*key, "span", "block", "words", F.posexplode("words").alias("place", "rank"))
    pairs = placed.join(small(index), ["rank", "span"])
    rest = F.least(F.size("ranked") - F.col("at"), F.size("words") - F.col("place"))
    long_enough = F.size("words") >= F.col("need")
    first = ~F.arrays_overlap(F.slice("ranked", 1, F.col("at")), "words")  # each pair once, at its rarest common word
    near = pairs.filter(long_enough & (rest >= F.col("need")) & first)
    both = F.size(F.array_intersect("words", "ranked"))
    whole = (both >= F.col("need")) & (F.size(F.array_except("must", "words")) == 0)
    return near.filter(whole).select(*key, "span", "block", "label", (both / F.size("ranked")).alias("containment"))


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licenses of whole texts: id_col, n_words, n_base, first_word, last_word, base_labels, labels, score.

    The base scan finds the phrases wherever their words follow each other, the join finds the templates.
    score: 1 with a base place, else the best containment found, else 0. Labels are distinct, sorted and
    joined by commas, '' for none. Texts stay where they are; what is found, a few rows, is joined by id and
    hash of the text.

    A null text is empty; a null id is kept; repeated rows get the same answer; words of one frequency are
    ordered by name; an empty table gives no rows; other columns are never read, whatever their names. Very long
    texts are scanned whole.
    """
    text = F.coalesce(F.col("text"), F.lit(""))
    source = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("hash", F.xxhash64("text"))
    tokens = F.when(text.rlike(_finds(list(PHRASES))), _words(text))
    base = source.select("doc_id", "hash", F.regexp_count(text, F.lit(_WORD + "+")).cast("long").alias("n_words"), tokens.alias("tokens"))
    for k, phrase in enumerate(PHRASES):
        starts = _places("tokens", phrase.split())
        base = base.withColumn(f"at{k}", F.coalesce(F.when(F.col("tokens").isNotNull(), starts), F.array().cast("array<int>")))
    places = F.concat(*(F.col(f"at{k}") for k in range(len(PHRASES))))
    own = F.filter(F.array(*(F.when(F.size(f"at{k}") > 0, F.lit(label)) for k, label in enumerate(PHRASES.values()))), lambda x: x.isNotNull())
    base = base.select(
        "doc_id", "hash", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(own).alias("own"),
    )
    found = matching_blocks(source, ["doc_id", "hash"], text).groupBy("doc_id", "hash").agg(F.collect_set("label").alias("more"), F.max("containment").alias("best"))
    found = found.select(F.col("doc_id").alias("_id"), F.col("hash").alias("_hash"), "more", "best")
    joined = base.join(found, base["doc_id"].eqNullSafe(F.col("_id")) & base["hash"].eqNullSafe(F.col("_hash")), "left")
    every = F.array_sort(F.array_union("own", F.coalesce("more", F.array().cast("array<string>"))))
    score = F.when(F.col("n_base") > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0)))
    return joined.select(
        F.col("doc_id").alias(id_col), "n_words", "n_base", "first_word", "last_word",
        F.concat_ws(",", "own").alias("base_labels"), F.concat_ws(",", every).alias("labels"), score.alias("score"),
    )

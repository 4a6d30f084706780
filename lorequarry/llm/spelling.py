"""Operator 11: spelling variants by errata tries.

The words form a trie. At each of its nodes the child with the most words below is heavy, the others are
light; a word's path has at most log2(words) light edges. Each light subtree is merged into the heavy path
beside it with the character of its edge replaced by the heavy one, skipped, or put behind the heavy one, and
all light subtrees of a node are merged with each other with that character blotted out. Only light subtrees
are copied (small to large), so n words give n log n copies, and where the terminals of two merged subtrees
coincide, two words are one edit apart. The tries are tables here: a node is its prefix, a copied terminal is
the string that it stands for, and terminals coincide in a join.

Each pair is found once. Two words of one length part at one node: either one of them is on the heavy edge
(replaced), or both are on light ones (blotted out). If one word has a character more, take it as the last of
its run; where the words part, the longer one is on a light edge (skipped), or the shorter one is (heavy
before light), or the shorter one ends there (the node's heavy child).
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, staged

#: Runs of letters, as the contract fixes them.
LETTERS = "A-Za-zÀ-ÿ"


def count_runs(docs: DataFrame, min_length: int = 6, drop_one_in: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """word, n: maximal runs of LETTERS of whole texts, A-Z lower-cased, of at least min_length code points, and how often they occur.

    drop_one_in: where it divides h, the unsigned crc32 of `<id>:<run>`, the run loses its code point at
    h % length first (0: nowhere). Occurrences are counted where texts are read, before words move.
    """
    lower = F.translate(F.coalesce(docs[text_col], F.lit("")), string.ascii_uppercase, string.ascii_lowercase)
    runs = docs.select(
        F.coalesce(docs[id_col].cast("string"), F.lit("")).alias("id"),
        F.explode(F.regexp_extract_all(lower, F.lit(f"([{LETTERS}]{{{min_length},}})"), F.lit(1))).alias("word"),
    )
    if drop_one_in:
        h, size = F.crc32(F.concat("id", F.lit(":"), "word")), F.length("word")
        place = (h % size).cast("int")
        shorter = F.concat(F.substr("word", F.lit(1), place), F.substr("word", place + 2))
        runs = runs.select(F.when(h % drop_one_in == 0, shorter).otherwise(F.col("word")).alias("word")).filter(F.length("word") >= min_length)
    return runs.groupBy("word").agg(F.count("*").alias("n"))


def _light_edges(words: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The light edges on the paths of all words, and the heavy child of each node.

    Edges: word, n, x (the node), a (the light character), h (the heavy one), s (what follows a). A node near
    the root is on the paths of most words: nodes with a thousandth of all steps are broadcast (they are a
    thousand at most), the others meet their words in a shuffle.
    """
    steps = words.select("word", "n", F.explode(F.sequence(F.lit(0), F.length("word") - 1)).alias("i"))
    steps = steps.filter("word <> ''").select("word", "n", "i", F.substr("word", F.lit(1), F.col("i")).alias("x"), F.substr("word", F.col("i") + 1, F.lit(1)).alias("a"))
    edges = steps.groupBy("x", "a").agg(F.count("*").alias("below"))
    nodes = edges.groupBy("x").agg(F.max_by("a", F.struct("below", "a")).alias("h"), F.count("*").alias("kids"), F.sum("below").alias("size"))
    nodes = staged(nodes, "trie_nodes")
    total = nodes.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    light = attach_groups(steps, nodes.filter("kids > 1"), ["x"], "size", total).filter("a <> h")
    return staged(light.select("word", "n", "x", "a", "h", F.substr("word", F.col("i") + 2).alias("s")), "light_edges"), nodes


def _best(n: Column | str, word: Column | str) -> Column:
    """A struct whose smallest value is the word of largest n, of those the first in code-point order."""
    return F.struct((-F.col(n)).alias("neg"), F.col(word).alias("near"))


def near_words(words: DataFrame) -> DataFrame:
    """word, n_near, best (neg, near): how many words differ by one inserted, deleted or replaced code point, and the most frequent of them.

    words: distinct word, n, a staged table. Words without a near word have no row.
    """
    light, nodes = _light_edges(words)
    copies = F.array(
        F.concat("x", "h", "s"),  # replaced by the heavy character
        F.when(~F.startswith("s", "a"), F.concat("x", "s")),  # skipped, if it is the last of its run
        F.concat("x", "h", "a", "s"),  # behind the heavy character
    )
    terminals = light.select("word", "n", F.explode(copies).alias("copy")).filter("copy is not null")
    ends = words.join(nodes.select(F.col("x").alias("word"), "h"), "word").select("word", "n", F.concat("word", "h").alias("copy"))
    hits = terminals.unionByName(ends).join(words.select(F.col("word").alias("copy"), F.col("n").alias("copy_n")), "copy")
    hits = hits.select(F.explode(F.array(
        F.struct("word", _best("copy_n", "copy").alias("best")),
        F.struct(F.col("copy").alias("word"), _best("n", "word").alias("best")),
    )).alias("p")).select("p.word", F.lit(1).cast("long").alias("n_near"), "p.best")

    # Light siblings with one character blotted out: a group has at most as many words as there are code points for one place.
    groups = light.groupBy("x", "s").agg(F.array_sort(F.collect_list(_best("n", "word"))).alias("all")).filter(F.size("all") > 1)
    siblings = groups.select((F.size("all") - 1).cast("long").alias("n_near"), F.col("all")[0].alias("first"), F.col("all")[1].alias("second"), F.explode("all").alias("own"))
    siblings = siblings.select(F.col("own.near").alias("word"), "n_near", F.when(F.col("own.near") == F.col("first.near"), F.col("second")).otherwise(F.col("first")).alias("best"))
    return hits.unionByName(siblings).groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min("best").alias("best"))


def variant_groups(words: DataFrame, ratio: int = 5) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words with their counts n (positive).

    form: the near word of largest n (ties: the first in code-point order) if its n is at least ratio times
    the word's, else null. root: from the word, the last that its forms lead to. As n grows by the ratio with
    each form, a chain of forms has log(largest n) steps, and pointers double in each round.

    Words are compared as they are; null words have no row; words of one code point and the empty word are
    words like others; an empty table gives no rows; columns but word and n are never read.
    """
    if ratio < 2:
        raise ValueError("ratio must be 2 or more, or forms could lead in circles")
    words = staged(words.select("word", F.col("n").cast("long").alias("n")).filter("word is not null"), "words")
    found = words.join(near_words(words), "word", "left")
    enough = -F.col("best.neg") >= ratio * F.col("n")
    found = found.select(
        "word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"),
        F.when(enough, F.col("best.near")).alias("form"), F.when(enough, -F.col("best.neg")).alias("form_n"),
    )
    found = staged(found, "forms")
    least, most = found.agg(F.min("n"), F.max("n")).first()
    steps = math.log(max(1.0, (most or 1) / max(1, least or 1)), ratio)
    roots = found.filter("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(max(0, math.ceil(math.log2(steps + 1)))):
        further = roots.select(F.col("word").alias("root"), F.col("root").alias("further"))
        roots = staged(roots.join(further, "root", "left").select("word", F.coalesce("further", "root").alias("root")), "roots")
    return found.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, min_length: int = 6, min_count: int = 5, ratio: int = 5, drop_one_in: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The variant groups of all words of min_length code points or more that occur min_count times or more in whole texts.

    A null text has no words; a null id counts as the empty string where drop_one_in asks for it; an empty
    or very long text is like any other, read where it is; repeated rows count each time; ties go to the word
    that is first in code-point order; an empty table gives no rows; other columns are never read, whatever
    their names.
    """
    counts = count_runs(docs, min_length, drop_one_in, id_col, text_col)
    return variant_groups(counts.filter(F.col("n") >= min_count), ratio)

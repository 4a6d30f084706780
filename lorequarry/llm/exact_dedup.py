"""Operator 6: exact deduplication by progressive refinement: length, then a prefix hash, then the full hash."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import attach_groups, drop_by_key, fits, keep_by_key, staged

#: Code points of the normalised text that the prefix hash covers.
PREFIX = 256


def normal(text: Column) -> Column:
    """The text without white space (null: empty)."""
    return F.translate(F.coalesce(text, F.lit("")), " \t\n\x0b\x0c\r", "")


def _keyed(docs: DataFrame, id_col: str, text_col: str, digest: bool) -> DataFrame:
    """Staged numbers and hashes of each row, and _row, which tells rows apart; one scan of the texts."""
    text, norm = docs[text_col], normal(docs[text_col])
    whole = docs.select(docs[id_col].alias("doc_id"), F.length(F.coalesce(text, F.lit(""))).alias("n_chars"), norm.alias("norm"))
    full = F.sha2(F.col("norm"), 256) if digest else F.lit(None).cast("string")
    keys = whole.select("doc_id", "n_chars", F.length("norm").alias("norm_len"), F.xxhash64(F.substring("norm", 1, PREFIX)).alias("prefix"), full.alias("text_sha256"))
    return staged(keys.withColumn("_row", F.monotonically_increasing_id()), "dedup_keys")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", digest_all: bool = False) -> DataFrame:
    """Which row stays of equal texts: id_col, keep_id, group_size, kept, and text_sha256 of the normalised text.

    Texts are equal when identical without white space. The one with the most code points stays, then the
    smallest id. Rows are first grouped by length, then by length and prefix hash; only groups of two and
    more are compared by their full hash. text_sha256 is null for the others, unless digest_all asks for all
    of them; then length, prefix and digest come of one scan.

    Texts never move: what is grouped are numbers and hashes. Keys of groups that survive the prefix are
    broadcast if they fit; if they are too many, every text is hashed in place and the hashes move.
    Groups that hold a thousandth of all rows are broadcast, so copies by the million don't meet in a task.

    A null text counts as empty; a null id counts as the smallest; a very long text is hashed whole where it
    is read; of rows repeated whole, and of other ties, exactly one is kept; an empty table gives no rows;
    other columns are never read, whatever their names.
    """
    keys = _keyed(docs, id_col, text_col, digest_all)
    total = keys.count()
    lengths = keys.groupBy("norm_len").agg(F.count("*").alias("_n")).filter("_n > 1").select("norm_len")
    surviving = keep_by_key(keys, lengths, ["norm_len"]).groupBy("norm_len", "prefix").agg(F.count("*").alias("_n")).filter("_n > 1")
    surviving = staged(surviving, "dedup_survivors")
    on, own = ["norm_len", "prefix"], ["doc_id", "n_chars", "text_sha256", "_row"]
    few = fits(surviving.select(*on))
    if digest_all or not few:
        hashed = keys if digest_all else _keyed(docs, id_col, text_col, True)
        marked = attach_groups(hashed, surviving, on, "_n", total, "left")
        rest, alone = marked.filter("_n is not null").select(*own), marked.filter("_n is null").select(*own)
    else:
        near = F.broadcast(surviving.select(*on))
        text = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")).withColumn("norm", normal(F.col("text")))
        met = text.withColumns({"norm_len": F.length("norm"), "prefix": F.xxhash64(F.substring("norm", 1, PREFIX))}).join(near, on)
        rest = met.select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n_chars"), F.sha2("norm", 256).alias("text_sha256"), F.monotonically_increasing_id().alias("_row"))
        alone = keys.join(near, on, "left_anti").select(*own)
    rest = staged(rest, "dedup_rows")
    best = F.min(F.struct((-F.col("n_chars")).alias("n"), F.col("doc_id").alias("i"), F.col("_row").alias("r")))
    groups = staged(rest.groupBy("text_sha256").agg(best.alias("_best"), F.count("*").alias("group_size")), "dedup_groups")
    joined = attach_groups(rest, groups, ["text_sha256"], "group_size", total)
    answer = joined.select("doc_id", F.col("_best.i").alias("keep_id"), "group_size", (F.col("_row") == F.col("_best.r")).alias("kept"), "text_sha256")
    single = alone.select("doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"), F.lit(True).alias("kept"), "text_sha256")
    return answer.unionByName(single).withColumnRenamed("doc_id", id_col)


def keep_distinct(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The documents without their equal copies, with all their columns.

    Rows that share an id of which not all stay are told apart by the digest of their text. A text that
    was never hashed in full equals no other, so it has no digest in the verdict and stays. Columns whose
    names begin with __lq_ are this function's own.
    """
    verdict = staged(exact_dedup(docs, id_col, text_col), "dedup_verdict")
    gone = staged(verdict.filter(~F.col("kept")).select(id_col).distinct(), "dedup_gone")
    left = drop_by_key(docs, gone, id_col)
    shared = staged(drop_by_key(verdict, gone, id_col, "left_semi").select(id_col, "kept", "text_sha256"), "dedup_shared")
    mixed = staged(shared.filter("kept").select(id_col).distinct(), "dedup_mixed")
    if not mixed.limit(1).count():
        return left
    columns = docs.columns
    hashed = shared.filter("text_sha256 is not null").groupBy(F.col(id_col).alias("__lq_id"), F.col("text_sha256").alias("__lq_text")).agg(F.max("kept").alias("__lq_kept"))
    some = drop_by_key(docs, mixed, id_col, "left_semi").withColumns({"__lq_sha": F.sha2(normal(docs[text_col]), 256), "__lq_size": F.length(F.coalesce(docs[text_col], F.lit("")))})
    judged = some.join(hashed, some[id_col].eqNullSafe(F.col("__lq_id")) & (F.col("__lq_sha") == F.col("__lq_text")), "left")
    alone = judged.filter("__lq_text is null").select(*(judged[c] for c in columns))
    longest = judged.filter("__lq_kept")
    one = longest.groupBy("__lq_sha").agg(F.max_by(F.struct(*(longest[c] for c in columns)), F.struct("__lq_size")).alias("__lq_row"))
    return left.unionByName(alone).unionByName(one.select("__lq_row.*"))

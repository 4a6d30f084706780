"""Quotas, first-wins, running counts and other ranking windows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_per_group(rows: DataFrame, group: list[str], order: list[Column | str], k: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy(*group).orderBy(*order))
    return rows.withColumn("rank", rank).filter(F.col("rank") <= k)


def quotas(rows: DataFrame, group: str, order: list[Column | str], shares: dict[str, float], total: int) -> DataFrame:
    """`total` rows: from each group its share of them at most, then the best of the others.

    Both cuts are limits of a sort, so no group has to meet in one task beyond its first `total` rows.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(*order))
    quota = F.lit(0)
    for name, share in shares.items():
        quota = F.when(F.col(group) == name, int(share * total)).otherwise(quota)
    best = rows.withColumn("_rank", rank).filter(F.col("_rank") <= total).withColumn("within_quota", F.col("_rank") <= quota)
    return best.orderBy(F.desc("within_quota"), *order).limit(total).drop("_rank")


def first_wins(rows: DataFrame, key: list[str], order: list[Column | str]) -> DataFrame:
    return top_per_group(rows, key, order, 1).drop("rank")


def running_sessions(occurrences: DataFrame, key: str, session: str, day: str) -> DataFrame:
    """Per key and day: occurrences, and distinct sessions so far."""
    first = occurrences.groupBy(key, session).agg(F.min(day).alias(day)).groupBy(key, day).agg(F.count("*").alias("new"))
    daily = occurrences.groupBy(key, day).agg(F.count("*").alias("occurrences")).join(first, [key, day], "left")
    so_far = F.sum(F.coalesce("new", F.lit(0))).over(Window.partitionBy(key).orderBy(day))
    return daily.select(key, day, "occurrences", so_far.alias("sessions_so_far"))


def repeats_previous(messages: DataFrame, session: str, at: str, similarity) -> DataFrame:
    """Each message with the one before it in its session and their similarity."""
    w = Window.partitionBy(session).orderBy(at)
    content = F.col("content")
    before = F.lag("content").over(w)
    return messages.select(session, at, F.round(F.coalesce(similarity(content, before), F.lit(0.0)), 6).alias("similarity"))


def last_path(events: DataFrame, session: str, at: str, path: str, rows: int = 10) -> DataFrame:
    """The last path seen up to `rows` rows before each one."""
    w = Window.partitionBy(session).orderBy(at).rowsBetween(-rows, -1)
    return events.withColumn("last_path", F.last(path, ignorenulls=True).over(w))

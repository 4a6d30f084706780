"""Structured Streaming versions of the incremental operators; extensions beyond batch parity."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators import clustering
from ..staging import staged


def usage_by_week(feedback: DataFrame, delay: str = "1 day") -> DataFrame:
    """Counts by Monday-aligned week and kind of a feedback stream, final once the watermark has passed a week."""
    timed = feedback.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    week = F.window("ts", "7 days", startTime="4 days")
    return timed.groupBy(week.alias("week"), "feedback_type").agg(F.count("*").alias("n"))


def usage_by_day(feedback: DataFrame, delay: str = "1 day") -> DataFrame:
    timed = feedback.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay)
    return timed.groupBy(F.window("ts", "1 day").alias("day"), "feedback_type").agg(F.count("*").alias("n"))


def use_state_store(spark: SparkSession) -> None:
    """Let this session's streams keep their state in RocksDB, which processors with several states need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


class Profile(StatefulProcessor):
    """The running mean of a user and how many values it is of."""

    def __init__(self, rate: float):
        self.rate = rate

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("profile", "mean double, n long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        mean, n = self.state.get() if self.state.exists() else (0.0, 0)
        x = pd.concat(list(rows)).sort_values("ts", kind="stable")["value"].to_numpy(float)
        start, rest = (mean, x) if n else (x[0], x[1:])
        ages = np.arange(len(rest) - 1, -1, -1)
        mean = float(start * (1 - self.rate) ** len(rest) + (self.rate * (1 - self.rate) ** ages * rest).sum())
        n = int(n + len(x))
        self.state.update((mean, n))
        yield pd.DataFrame({"user_id": [key[0]], "mean": [mean], "n": [n]})

    def close(self) -> None:
        pass


def running_profiles(events: DataFrame, rate: float = 0.1) -> DataFrame:
    """Exponential moving average of `value` for each user, kept in the state store (see use_state_store).

    What a trigger brings of a user is put in the order of ts as a whole and folded by weights at once.
    """
    return events.groupBy("user_id").transformWithStateInPandas(Profile(rate), "user_id long, mean double, n long", "update", "none")


class Session(StatefulProcessor):
    """Where a session was read to, its patterns so far, and a timer that closes it."""

    def __init__(self, idle_ms: int):
        self.idle_ms = idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "last_line long, timer long")
        self.patterns = handle.getMapState("patterns", "pattern string", "n long, first_line long, last_line long")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        if self.place.exists() and self.place.get()[1] <= timerValues.getCurrentWatermarkInMs():  # its time is over, but its timer comes after the rows
            self.handle.deleteTimer(self.place.get()[1])
            yield self.closed(key)
        last, timer = self.place.get() if self.place.exists() else (0, 0)
        start, seen, latest, touched = last, set(), 0, {}
        for part in rows:
            part = part[part["line_number"] > start]
            for line, pattern, ts in zip(part["line_number"].tolist(), part["pattern"].tolist(), part["ts"], strict=True):
                if line in seen:  # a line that a trigger brings twice
                    continue
                seen.add(line)
                last, latest = max(last, line), max(latest, int(ts.timestamp() * 1000))
                if isinstance(pattern, str):
                    old = touched.get(pattern) or (self.patterns.getValue((pattern,)) if self.patterns.containsKey((pattern,)) else (0, line, line))
                    touched[pattern] = (old[0] + 1, min(old[1], line), max(old[2], line))
        if not seen:
            return
        for pattern, value in touched.items():
            self.patterns.updateValue((pattern,), value)
        until = max(timer, latest + self.idle_ms)
        if until != timer:
            if timer:
                self.handle.deleteTimer(timer)
            self.handle.registerTimer(until)
        self.place.update((last, until))
        names = list(touched)
        yield _session_rows(key[0], names, [touched[p] for p in names], last, False)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        if self.place.exists() and self.place.get()[1] == expiredTimerInfo.getExpiryTimeInMs():
            yield self.closed(key)

    def closed(self, key) -> pd.DataFrame:
        """All patterns of the session, whose state goes."""
        last, _ = self.place.get()
        found = [(k[0], v) for k, v in self.patterns.iterator()]
        self.place.clear()
        self.patterns.clear()
        return _session_rows(key[0], [k for k, _ in found], [v for _, v in found], last, True)

    def close(self) -> None:
        pass


def _session_rows(session: str, names: list[str], values: list[tuple], last: int, closed: bool) -> pd.DataFrame:
    names, values = [*names, None], [*values, (0, 0, last)]  # the last row is the session's own
    return pd.DataFrame({"session_id": session, "pattern": names, "n": [v[0] for v in values], "first_line": [v[1] for v in values], "last_line": [v[2] for v in values], "closed": closed})


def session_patterns(messages: DataFrame, idle: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Patterns of sessions over time: session_id, pattern, n, first_line, last_line, closed, with a row of no pattern for the session itself.

    messages: a stream of session_id (string), line_number, ts, pattern (null where a message has none). Each trigger
    resumes a session after the last line that it was read to and merges what the new lines show with the
    patterns kept in the state, so lines that come again change nothing. `idle` after its last message, by the
    watermark (`delay` behind the newest), a timer closes the session: its patterns are given out whole and its state goes;
    lines that come later begin it anew. Needs use_state_store.
    """
    timed = messages.select("session_id", "line_number", F.col("ts").cast("timestamp").alias("ts"), "pattern").withWatermark("ts", delay)
    unit = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}
    number, name = idle.split()
    processor = Session(int(float(number) * unit[name.rstrip("s")] * 1000))
    return timed.groupBy("session_id").transformWithStateInPandas(processor, "session_id string, pattern string, n long, first_line long, last_line long, closed boolean", "update", "eventTime")


def cluster_stream(vectors: DataFrame, path: str, checkpoint: str, threshold: float):
    """Cluster a stream of unit vectors (id, items, weights): every batch is assigned to the centroids of the batches before, and what fits none founds new ones.

    path holds, for each batch, the assignments (assigned/epoch=N: id, centroid) and all centroids after it
    (centroids/epoch=N); a batch that is run again reads the centroids of the one before and replaces its own folders.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        try:
            known = spark.read.parquet(f"{path}/centroids/epoch={epoch - 1}") if epoch else None
        except AnalysisException:
            known = None
        if known is None:
            known = spark.createDataFrame([], "centroid long, vector array<double>")
        first = known.agg(F.coalesce(F.max("centroid") + 1, F.lit(0))).first()[0]
        found, centroids = clustering.cluster_batch(staged(batch, "batch_vectors"), known, threshold, first)
        found.write.mode("overwrite").parquet(f"{path}/assigned/epoch={epoch}")
        centroids.write.mode("overwrite").parquet(f"{path}/centroids/epoch={epoch}")

    return vectors.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def log_sessions(stream: DataFrame, path: str, checkpoint: str):
    """Append the newest line of each session of a micro-batch to a log of Parquet files; sessions() reads the newest of all.

    A batch has a folder of its own, so one that is run again replaces itself and nothing else.
    """

    def write(batch: DataFrame, epoch: int) -> None:
        batch.groupBy("session_id").agg(F.max("line_number").alias("last_line")).write.mode("overwrite").parquet(f"{path}/epoch={epoch}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """session_id, last_line: the newest of each session in the log."""
    return spark.read.parquet(path).groupBy("session_id").agg(F.max("last_line").alias("last_line"))


def compacted(spark: SparkSession, path: str, target: str) -> None:
    """Write the log as one table elsewhere, a row for each session."""
    sessions(spark, path).write.mode("overwrite").parquet(target)

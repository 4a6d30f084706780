"""Queries: the streams over the test tables, run until their input is read; what the batches wrote is read back."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..functions import text
from ..staging import scratch
from ..streaming import incremental
from . import adapters as a

QUERIES, ORACLE_SQL = {}, {}


#: Files that a batch of a stream takes.
FILES = 4


def _run(s, d, name, make, mode, batches=("true",)):
    """The rows that each batch of a stream over a table gave, with its epoch. The table's rows come in batches, one for each condition, in this order."""
    incremental.use_state_store(s)
    folder = f"{scratch(s)}/stream-{uuid.uuid4().hex[:12]}"
    table = a.table(s, d, name)
    for condition in batches:  # files are taken in the order in which they were written
        table.filter(condition).repartition(FILES).write.mode("append").parquet(f"{folder}/in")
    stream = s.readStream.schema(s.read.parquet(f"{folder}/in").schema).option("maxFilesPerTrigger", FILES).parquet(f"{folder}/in")
    if mode is None:
        make(stream, folder).trigger(availableNow=True).start().awaitTermination()
        return folder

    def write(batch, epoch):
        batch.write.mode("overwrite").parquet(f"{folder}/out/epoch={epoch}")

    made = make(stream)
    made.writeStream.outputMode(mode).foreachBatch(write).option("checkpointLocation", f"{folder}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    return s.read.schema(made.schema.add("epoch", "integer")).parquet(f"{folder}/out")


def _weekly(s, d):
    feed = lambda stream: incremental.usage_by_week(stream.select("ts", F.col("event_type").alias("feedback_type")))
    rows = _run(s, d, "events", feed, "complete")
    return rows.join(rows.agg(F.max("epoch").alias("epoch")), "epoch").select(F.col("week.start").cast("date").alias("week"), "feedback_type", "n")


QUERIES["stream_weekly_usage"] = _weekly
ORACLE_SQL["stream_weekly_usage"] = "SELECT CAST(date_trunc('week', ts) AS DATE) AS week, event_type AS feedback_type, count(*) AS n FROM events GROUP BY ALL"


def _profiles(s, d):
    rows = _run(s, d, "events", lambda stream: incremental.running_profiles(stream.select("user_id", F.col("ts").cast("timestamp").alias("ts"), "value")), "update", ("ts < timestamp '2024-01-12'", "ts >= timestamp '2024-01-12'"))
    return rows.groupBy("user_id").agg(F.round(F.max_by("mean", "n"), 4).alias("mean"), F.max("n").alias("n"))


QUERIES["stream_profiles"] = _profiles
ORACLE_SQL["stream_profiles"] = """
    WITH e AS (SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)
    SELECT user_id, round(sum(value * CASE WHEN k = 1 THEN pow(0.9, n - 1) ELSE 0.1 * pow(0.9, n - k) END), 4) AS mean, count(*) AS n FROM e GROUP BY user_id"""


def _sessions(s, d):
    """The conversations turn by turn over several batches, where user messages of one text are a pattern."""
    pattern = F.when(F.col("role") == "user", text.fingerprint(F.lit("preference"), F.col("text")))
    minute = F.timestamp_seconds(1_700_000_000 + 60 * F.col("turn"))
    feed = lambda stream: incremental.session_patterns(stream.select(F.col("conv_id").cast("string").alias("session_id"), (F.col("turn") + 1).alias("line_number"), minute.alias("ts"), pattern.alias("pattern")))
    rows = _run(s, d, "conversations", feed, "update", ("turn < 2", "turn between 2 and 4", "turn > 4"))
    last = rows.groupBy("session_id", F.coalesce("pattern", F.lit("")).alias("pattern")).agg(F.max(F.struct("n", "last_line")).alias("m"), F.min("first_line").alias("first_line"))
    return last.filter("pattern <> ''").select("session_id", "pattern", F.col("m.n").alias("n"), "first_line", F.col("m.last_line").alias("last_line"))


QUERIES["stream_sessions"] = _sessions
ORACLE_SQL["stream_sessions"] = """
    SELECT CAST(conv_id AS VARCHAR) AS session_id, 'pattern-fp-' || left(sha256('preference:' || lower(trim(text, ' '))), 8) AS pattern, count(*) AS n, min(turn) + 1 AS first_line, max(turn) + 1 AS last_line
    FROM conversations WHERE role = 'user' GROUP BY ALL"""


def _clusters(s, d):
    """The embeddings in two batches, each assigned to the centroids before it."""
    length = text.norm(F.col("embedding"))

    def make(stream, folder):
        places = F.transform(F.sequence(F.lit(0), F.size("embedding") - 1), lambda i: i.cast("long"))
        rows = stream.select(F.col("vec_id").alias("id"), places.alias("items"), F.transform("embedding", lambda x: x.cast("double") / length).alias("weights"))
        return incremental.cluster_stream(rows, f"{folder}/clusters", f"{folder}/checkpoint", 0.3)

    return s.read.parquet(f"{_run(s, d, 'embeddings', make, None, ('vec_id % 2 = 0', 'vec_id % 2 = 1'))}/clusters/assigned").select(F.col("id").alias("vec_id"), "centroid", F.col("epoch").cast("int").alias("epoch"))


QUERIES["stream_clusters"] = _clusters  # tests hold cluster_batch against a loop

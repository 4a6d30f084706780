"""Tables that end a lineage, and joins in which a few groups may hold most of the rows."""

from __future__ import annotations

import atexit
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: A group that holds at least this part of all rows is hot, so there are at most as many hot groups.
HOT_PARTS = 1000
#: Bytes of keys that are ever broadcast; they are summed before, and beyond it the join shuffles.
BROADCAST_BYTES = 16 << 20

#: Spark's setting by which the shuffle files of an execution go when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def scratch(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir of the session, else one beside the warehouse."""
    base = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir')}/_scratch"
    return f"{base.rstrip('/')}/lorequarry-{spark.sparkContext.applicationId}"


_cleaned: set[str] = set()
_tables: list[str] = []


def _remove(spark: SparkSession, folder: str) -> None:
    try:
        jvm = spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)
    except Exception:  # noqa: BLE001  the session may have ended before
        pass


def staged(df: DataFrame, name: str) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends here and lost executors lose nothing.

    drop_staged removes it; what is left goes when the driver's process ends.
    """
    spark = df.sparkSession
    root = scratch(spark)
    if root not in _cleaned:
        _cleaned.add(root)
        atexit.register(_remove, spark, root)
    path = f"{root}/{name}-{uuid.uuid4().hex[:12]}"
    before = spark.conf.get(CLEANUP, "false")
    spark.conf.set(CLEANUP, "true")  # what was shuffled to write the table isn't read again
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(CLEANUP, before)
    _tables.append(path)
    return spark.read.schema(df.schema).parquet(path)


def staged_tables() -> int:
    """How many tables are staged, to be given to drop_staged."""
    return len(_tables)


def drop_staged(spark: SparkSession, since: int) -> None:
    """Remove the tables staged since then, but the last one."""
    for path in _tables[since:-1]:
        _remove(spark, path)
    del _tables[since:-1]


def spread(rows: DataFrame) -> DataFrame:
    """rows dealt to as many tasks as a shuffle has: a small file is read by one task, however long its rows then take."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))


def attach_groups(rows: DataFrame, groups: DataFrame, key: list[str], size: str, total: int, how: str = "inner") -> DataFrame:
    """Join rows with one row per group, where a few groups may hold most of the rows.

    Groups with at least total / HOT_PARTS rows are at most HOT_PARTS many and are broadcast, so their
    rows stay where they are; the others are small enough for one task each and meet in a shuffle.
    Both inputs are read twice and so should be staged tables. how: inner or left.
    """
    limit = max(2, total // HOT_PARTS)
    hot, cold = groups.filter(F.col(size) >= limit), groups.filter(F.col(size) < limit)
    near = rows.join(F.broadcast(hot), key, "inner")
    far = rows.join(F.broadcast(hot.select(*key)), key, "left_anti").join(cold, key, how)
    return near.unionByName(far.select(*near.columns))


def fits(keys: DataFrame) -> bool:
    """Whether a table may be broadcast, by its bytes (sixteen a row, and its values as text)."""
    width = sum((F.coalesce(F.octet_length(F.col(f"`{c}`").cast("string")), F.lit(0)) for c in keys.columns), F.lit(16))
    return keys.agg(F.coalesce(F.sum(width.cast("long")), F.lit(0))).first()[0] <= BROADCAST_BYTES


def small(df: DataFrame) -> DataFrame:
    """df with a hint to broadcast it if it fits."""
    return F.broadcast(df) if fits(df) else df

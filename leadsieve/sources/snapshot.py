"""The kept tables: today's queue, its history, the run log and their column checks.

The queue and its history are parquet, partitioned by `audit_date`. A run replaces its own
day's partition; an empty run writes no partition and so leaves the last queue in place.
"""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadsieve.config import Clock, instant

DAY = "audit_date"
KEEP_DAYS = 120


def read_kept(spark: SparkSession, path: str) -> DataFrame | None:
    """A kept table, or None before its first write."""
    try:
        return spark.read.parquet(path)
    except AnalysisException as error:
        if error.getCondition() in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            return None
        raise


def replace_day(queue: DataFrame, path: str) -> None:
    """Write the queue, replacing only the days it holds."""
    writer = queue.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    writer.partitionBy(DAY).parquet(path)


def write_once(queue: DataFrame, path: str) -> None:
    """Append the days that are not kept yet; a second run of a day adds nothing."""
    kept = read_kept(queue.sparkSession, path)
    if kept is not None:
        # one row per kept day
        days = kept.select(F.col(DAY).cast(queue.schema[DAY].dataType).alias(DAY)).distinct()
        queue = queue.join(days, DAY, "left_anti")
    queue.write.mode("append").partitionBy(DAY).parquet(path)


def append_log(queue: DataFrame, path: str, exported_at: datetime) -> None:
    """Append a run to the history; two runs of one day differ by `exported_at`."""
    stamped = queue.select(instant(exported_at).alias("exported_at"), *queue.columns)
    stamped.write.mode("append").partitionBy(DAY).parquet(path)


def retained(log: DataFrame, clock: Clock, keep_days: int = KEEP_DAYS) -> DataFrame:
    """Log rows young enough to keep; on the partition column, so old files are not opened."""
    return log.filter(F.col(DAY) >= F.lit(clock.today - timedelta(days=keep_days)))


def drop_expired(spark: SparkSession, path: str, clock: Clock, keep_days: int = KEEP_DAYS) -> list[str]:
    """Delete the partitions of days past retention; touches folder names only."""
    oldest = (clock.today - timedelta(days=keep_days)).isoformat()
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    files = root.getFileSystem(spark._jsc.hadoopConfiguration())
    dropped = []
    for entry in files.listStatus(root):
        name = entry.getPath().getName()
        if name.startswith(f"{DAY}=") and name[len(DAY) + 1 :] < oldest:
            files.delete(entry.getPath(), True)
            dropped.append(name[len(DAY) + 1 :])
    return sorted(dropped)


def reconcile(stored: DataFrame, schema: StructType) -> DataFrame:
    """Stored rows in the columns of the code: absent ones NULL, unknown ones gone."""
    empty = stored.sparkSession.createDataFrame([], schema)
    known = stored.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema if f.name in stored.columns])
    return empty.unionByName(known, allowMissingColumns=True)


def missing_columns(df: DataFrame, expected: tuple[str, ...]) -> list[str]:
    return [c for c in expected if c not in df.columns]


def fill_missing(df: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """Expected columns in order; absent ones are written blank."""
    return df.select(*[F.col(c) if c in df.columns else F.lit(None).cast("string").alias(c) for c in expected])


def column_diff(df: DataFrame, expected: tuple[str, ...]) -> DataFrame:
    """Each expected or returned column, whether it was returned, and how many rows fill it."""
    names = [*expected, *[c for c in df.columns if c not in expected]]
    counts = df.agg(*[(F.count(c) if c in df.columns else F.lit(0)).cast("bigint").alias(c) for c in names])
    long = counts.unpivot([], names, "column_name", "filled_rows")
    known, returned = F.col("column_name").isin(*expected), F.col("column_name").isin(*df.columns)
    state = F.when(known & returned, "ok").when(known, "missing").otherwise("unexpected")
    return long.withColumn("state", state)

"""The newest stage of every lead, kept up to date from files of events as they arrive.

Each micro-batch is reduced to one event per lead and merged into the kept one, the later by
(created_at, event_id). That order makes the merge blind to replays and to late events: an event that
was seen, or that is older than the kept one, changes nothing, and the table always equals the batch
answer over all events so far. No watermark is needed and no state is held between batches.

The table is dealt into parts by a hash of the lead. A batch writes the parts it touches anew, under
its own name, and then one small manifest that names the current version of every part, by a rename.
A batch that dies before that leaves the table as it was, and runs again.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.types import StructType

from leadsieve.operators.history import newest
from leadsieve.sources.commits import Folder

PARTS = 64
MANIFEST = "current.json"


def newest_events(events: DataFrame) -> DataFrame:
    """(lead_id, event_id, created_at, stage) of each lead's newest event."""
    row = newest("event_id", "created_at", "stage")
    return events.groupBy("lead_id").agg(row.alias("n")).select("lead_id", "n.event_id", "n.created_at", "n.stage")


def part_of(parts: int) -> Column:
    return F.pmod(F.xxhash64("lead_id"), F.lit(parts)).cast("int")


def manifest(spark: SparkSession, root: str) -> dict:
    folder = Folder(spark, root)
    if MANIFEST not in folder.names():
        return {"parts": PARTS, "versions": {}}
    return json.loads(folder.read(MANIFEST))


def _paths(root: str, versions: dict[str, str], parts: list[str] | None = None) -> list[str]:
    return [f"{root}/{version}/part={part}" for part, version in sorted(versions.items()) if parts is None or part in parts]


def read_latest(spark: SparkSession, root: str) -> DataFrame | None:
    """(lead_id, audit_stage, audit_stage_at) as of the last finished batch; None before the first."""
    paths = _paths(root, manifest(spark, root)["versions"])
    if not paths:
        return None
    return spark.read.parquet(*paths).select("lead_id", F.col("stage").alias("audit_stage"), F.col("created_at").alias("audit_stage_at"))


def merge(events: DataFrame, root: str, version: str, parts: int = PARTS) -> None:
    """Bring events into the kept table. Only the parts that they touch are read and written."""
    spark = events.sparkSession
    known = manifest(spark, root)
    if known["versions"] and known["parts"] != parts:
        raise ValueError(f"{root} is dealt into {known['parts']} parts")
    fresh = newest_events(events).withColumn("part", part_of(parts)).persist()
    try:
        touched = [str(r["part"]) for r in fresh.select("part").distinct().collect()]  # at most `parts`
        if not touched:
            return
        rows = fresh.drop("part")
        if paths := _paths(root, known["versions"], touched):
            rows = newest_events(rows.unionByName(spark.read.parquet(*paths)))
        dealt = rows.withColumn("part", part_of(parts))
        dealt.repartition("part").write.mode("overwrite").partitionBy("part").parquet(f"{root}/{version}")
    finally:
        fresh.unpersist()
    versions = {**known["versions"], **dict.fromkeys(touched, version)}
    Folder(spark, root).write(json.dumps({"parts": parts, "versions": versions}), MANIFEST)


def follow(
    spark: SparkSession, path: str, schema: StructType, root: str, checkpoint: str, parts: int = PARTS, files_per_batch: int | None = None
) -> StreamingQuery:
    """Merge the event files under `path` that are new since the last run, then stop.

    Run it on a schedule, or again after a failure: the checkpoint knows which files are done, and a
    batch that is done twice changes nothing. A version folder is never written by two batches.
    """
    run = uuid.uuid4().hex  # a batch that runs again writes under another name
    reader = spark.readStream.schema(schema)
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)

    def batch(events: DataFrame, number: int) -> None:
        merge(events, root, f"{run}-{number}", parts)

    writer = reader.parquet(path).writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)
    return writer.trigger(availableNow=True).start()

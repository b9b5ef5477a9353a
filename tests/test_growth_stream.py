"""A batch of events is never one task's."""

from __future__ import annotations

import glob

from checks import queries_queue


def test_a_batch_of_events_is_several_files(spark, tmp_path):
    ids = spark.range(0, 200_000, 1, 8)
    events = ids.selectExpr("uuid() AS event_id", "'L1' AS lead_id", "timestamp '2023-01-01' AS created_at")
    size = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(size)
    spark.conf.set(size, "512k")
    try:
        queries_queue.in_batches(events).write.partitionBy("batch").parquet(f"{tmp_path}/in")
    finally:
        spark.conf.set(size, before)
    assert len(glob.glob(f"{tmp_path}/in/batch=2/*.parquet")) > 2
    assert spark.read.parquet(f"{tmp_path}/in").count() == 200_000

"""The dial log is read once; clock times are arithmetic."""

from __future__ import annotations

from datetime import timedelta

from conftest import CLOCK, at, make_tables

from leadsieve.functions.times import clock_seconds
from leadsieve.operators import calls
from leadsieve.sources.schemas import CALL_LOG


def test_the_call_log_is_not_read_for_each_reader_of_its_line(spark, tmp_path):
    path = f"{tmp_path}/calls"
    dials = [("09800000001", f"2026-08-0{d}T10:00:0{s}Z", "00:00:20", "Manual") for d in (1, 2) for s in range(5)]
    spark.createDataFrame(dials, CALL_LOG).write.parquet(path)
    leads = make_tables(spark, leads=[{"lrm_assigned_at": "2026-08-01T10:00:02Z"}]).lead
    stats = calls.call_stats(leads, spark.read.parquet(path), CLOCK)
    assert [tuple(r) for r in stats.collect()] == [("A", at("2026-08-02 10:00").replace(tzinfo=None) + timedelta(seconds=4), 8, 8)]
    ran = stats._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert len([x for x in ran.splitlines() if "FileScan" in x and "call_to" in x]) == 1


def test_clock_times_are_read_as_before(spark):
    want = {
        "9:30 PM": 77_400, " 09:05am ": 32_700, "12:00 AM": 0, "12:59pm": 46_740, "11:00\tPM": 82_800,
        "13:00 PM": 32_400, "0:30 AM": 32_400, "9:60 AM": 32_400, "9:30 PM\n": 32_400, "soon": 32_400, "99:99 PM": 32_400, "": 32_400,
    }
    rows = spark.createDataFrame([(k,) for k in (*want, None)], "t string")
    assert {r[0]: r[1] for r in rows.select("t", clock_seconds(rows["t"])).collect()} == {**want, None: 32_400}

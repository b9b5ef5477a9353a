"""Ranks, key filters and lookups on groups that hold most of the rows."""

from __future__ import annotations

import re

import pytest
from conftest import CLOCK
from pyspark.sql import Window
from pyspark.sql import functions as F

from leadsieve.operators import calls
from leadsieve.operators import rules as r
from leadsieve.operators.history import history_facts
from leadsieve.operators.skew import key_filter, lookup_join, ordering, prefilter, rank_in_group

ORDER = [("a", "desc_nulls_last"), ("b", "asc_nulls_first"), ("c", "desc_nulls_first"), ("id", "asc")]


@pytest.fixture(scope="module")
def skewed(spark):
    n = F.col("id")
    return spark.range(3000).select(
        F.concat(F.lit("r"), n).alias("id"),
        # two thirds in one group, some in the NULL group
        F.when(n % 3 != 0, "hot").when(n % 9 != 0, F.concat(F.lit("g"), n % 7)).alias("g"),
        F.when(n % 11 != 0, n % 4).alias("a"),
        F.when(n % 5 != 0, n * 7 % 6).alias("b"),
        F.when(n % 13 != 0, n * 31 % 50).alias("c"),
    )


@pytest.fixture
def no_broadcast(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


@pytest.mark.parametrize("group", [[], ["g"], ["g", "a"]])
def test_range_rank_is_the_row_number(skewed, group):
    plain = skewed.withColumn("r", F.row_number().over(Window.partitionBy(*group).orderBy(*ordering(ORDER))))
    ranged = rank_in_group(skewed, group, ORDER, "r")
    assert ranged.columns == plain.columns
    assert sorted(map(tuple, ranged.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)


def test_one_group_with_one_leading_value_is_dealt_evenly(spark, monkeypatch):
    """A million rows of one group, score and day: no range holds much more than its share."""
    from leadsieve.operators import skew

    stored = []
    monkeypatch.setattr(skew, "written", lambda df, label, keep=skew.written: stored.append(keep(df, label)) or stored[-1])
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.range(1_000_000).select(F.lit("g").alias("g"), F.lit(7).alias("score"), F.xxhash64("id").alias("id"))
        ranked = rank_in_group(rows, ["g"], [("score", "desc_nulls_last"), ("id", "asc")], "r")
        row = ranked.agg(F.min("r"), F.max("r"), F.countDistinct("r")).first()
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert tuple(row) == (1, 1_000_000, 1_000_000)
    sizes = [x["count"] for x in stored[0].groupBy("_range").count().collect()]
    assert len(sizes) == 4 and max(sizes) < 1.5 * 250_000


@pytest.mark.parametrize("how", ["left", "inner", "left_semi", "left_anti"])
def test_lookup_with_and_without_broadcast(spark, skewed, how):
    names = spark.sql("SELECT * FROM VALUES ('hot', 'H'), ('g1', 'G') AS t(g, name)")
    counts = [lookup_join(skewed, names, "g", how=how).count()]
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        counts.append(lookup_join(skewed, names, "g", how=how).count())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert counts[0] == counts[1]


@pytest.mark.parametrize("words", [1, 64, 1 << 18])
def test_prefilter_loses_no_key(skewed, words):
    ids = skewed.filter("g in ('g1', 'g2') or g is null").select("g")
    kept = prefilter(skewed, ids, "g", words)
    assert kept.columns == skewed.columns
    assert kept.join(ids.distinct(), "g", "left_semi").count() == skewed.filter("g in ('g1', 'g2')").count()
    if words > 64:
        assert kept.count() == skewed.filter("g in ('g1', 'g2')").count()


def test_key_filter_is_bounded(spark):
    assert key_filter(spark.range(50_000), "id", 128).count() <= 128
    ids = spark.range(0, 100_000, 10)
    passed = prefilter(spark.range(100_000), ids, "id").count()
    assert 10_000 <= passed < 10_500


def exchanged_rows(df) -> list[int]:
    """Rows that each shuffle of the plan that ran has written."""
    sizes = []

    def visit(node):
        name = node.nodeName()
        if name == "AdaptiveSparkPlan":
            return visit(node.executedPlan())
        if "QueryStage" in name:
            return visit(node.plan())
        if name == "Exchange":
            sizes.append(int(node.metrics().apply("shuffleRecordsWritten").value()))
        children = node.children()
        for i in range(children.size()):
            visit(children.apply(i))

    df.collect()
    visit(df._jdf.queryExecution().executedPlan())
    return sizes


def test_half_of_history_on_one_lead(spark, no_broadcast):
    """No raw event is shuffled: the shuffles hold partial rows and the key filter only."""
    n = F.col("id")
    at = F.timestamp_seconds(F.lit(1_780_000_000) + n % 1000)
    history = spark.range(0, 400_000, 1, 8).select(
        F.concat(F.lit("e"), n).alias("event_id"),
        F.when(n % 2 == 0, "hot").otherwise(F.concat(F.lit("L"), n % 1000)).alias("lead_id"),
        at.alias("created_at"),
        F.lit("Assigned").alias("stage"),
        F.lit("x").alias("status"),
        *[at.alias(c) for c in ("meeting_confirmed_datetime", "meeting_schedule_date", "meeting_done_date")],
    )
    ids = spark.range(300).select(F.concat(F.lit("L"), F.col("id")).alias("lead_id")).union(spark.sql("SELECT 'hot'"))
    facts = history_facts(history, ids, r.CURRENT)
    moved = exchanged_rows(facts)
    assert max(moved) < 8 * 600
    assert facts.filter("lead_id = 'hot'").count() == 1


def test_a_third_of_dials_in_one_hour_of_one_number(spark, no_broadcast):
    """Dials at microsecond times: the hour is dealt over its minutes and totals stay exact."""
    n = F.col("id")
    micros = F.lit(1_785_700_000_000_000) + F.when(n % 3 == 0, n * 9973 % 3_600_000_000).otherwise(n * 7919 % 400_000_000_000)
    dials = spark.range(300_000).select(
        F.when(n % 3 == 0, "9800000000").otherwise(F.concat(F.lit("98000"), F.lpad((n % 5000).cast("string"), 5, "0"))).alias("ph10"),
        F.timestamp_micros(micros).alias("call_at"),
        (n % 7 == 0).alias("connected"),
    )
    starts = dials.filter("ph10 = '9800000000'").sample(0.001, seed=3).select("ph10", F.col("call_at").alias("since_at"))
    got = {x.since_at: (x.calls_30d, x.connects_30d, x.last_call_at) for x in calls.dials_after(starts, dials).collect()}
    hot = sorted((x.call_at, x.connected) for x in dials.filter("ph10 = '9800000000'").collect())
    times = [t for t, _ in hot]
    from bisect import bisect_left

    for since, (count, connects, last) in got.items():
        at = bisect_left(times, since)
        assert (count, connects, last) == (len(hot) - at, sum(c for _, c in hot[at:]), times[-1])
    assert len(got) == starts.distinct().count() > 20


def test_dial_slices_are_minutes(spark):
    starts = spark.createDataFrame([("9800000000", CLOCK.as_of)], "ph10 STRING, since_at TIMESTAMP")
    dials = spark.createDataFrame([("9800000000", CLOCK.as_of, True)], "ph10 STRING, call_at TIMESTAMP, connected BOOLEAN")
    text = calls.dials_after(starts, dials)._jdf.queryExecution().toString()
    assert re.search(r"hashpartitioning\(ph10#\d+, minute#\d+", text) and re.search(r"hashpartitioning\(ph10#\d+, hour#\d+", text)

"""Dials per lead, matched on the last ten digits of the phone.

Phones are shared: a call centre's own number or a placeholder can sit on a third of the leads
and a third of the dials, and joining the two would build every pair. Nothing here does. A
lead only needs how many dials on its phone came at or after one instant, which is a running
total along the phone's time line:

* dials and the leads' start instants go on one time line, cut by phone and minute;
* inside a slice a running total counts the dials after each start;
* later minutes of the hour are added from a running total over the hour's minutes, and later
  hours from one over the phone's hours.

A hot phone is thus spread over its minutes, and repeated dials are combined before the shuffle.
The leads then meet one row per phone and start; if a third of them share that row, the
adaptive skew join splits them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from leadsieve.config import Clock, instant
from leadsieve.functions.text import digits, phone_key
from leadsieve.functions.times import ISO_DATE_PREFIX, ISO_INSTANT_PREFIX, instant_from_text, local_date
from leadsieve.operators.population import lead_phones
from leadsieve.operators.skew import lookup_join, prefilter

CONNECT_DIGITS = 15
MANUAL = "Manual"


def connected() -> Column:
    """The duration's digits read as one number are at least 15: `00:01:00` is 100."""
    return F.coalesce(digits(F.col("response_call_duration")).try_cast("bigint") >= CONNECT_DIGITS, F.lit(False))


def recent_dials(call_log: DataFrame, clock: Clock, days: int, keep: Column | None = None) -> DataFrame:
    """(ph10, call_at, connected) of dials since the day `days` ago; unreadable times are NULL.

    The bound is on the ISO text, so it reaches the scan. `keep` is an optional extra filter on
    the raw log, such as the call type or the dialling agent. Short numbers stay in: no lead
    has one to match, and testing them here would parse every number twice.
    """
    since = clock.days_ago(days).strftime("%Y-%m-%d")
    rows = call_log.filter(F.col("created_at") >= since)
    if keep is not None:
        rows = rows.filter(keep)
    return rows.select(
        phone_key(F.col("call_to")).alias("ph10"),
        instant_from_text(F.col("created_at"), ISO_DATE_PREFIX).alias("call_at"),
        connected().alias("connected"),
    )


def dials_after(starts: DataFrame, dials: DataFrame) -> DataFrame:
    """Dial totals at or after each distinct (ph10, since_at)."""
    combined = dials.groupBy("ph10", "call_at").agg(
        F.count(F.lit(1)).alias("n"), F.count_if("connected").alias("c")
    )
    # The line is read three times below. Every reader asks for all of its columns and takes hour, mark and
    # the dial's time from them after the shuffle; were they columns, each reader would drop those that it
    # does not need, no two shuffles would be alike, and the log would be scanned for each.
    line = combined.select("ph10", F.col("call_at").alias("at"), "n", "c").unionByName(
        starts.select("ph10", F.col("since_at").alias("at")).distinct(),
        allowMissingColumns=True,
    )
    # dials without a time fall into the slices NULL, which sort before all others: no start looks
    # for them there
    line = line.withColumn("minute", F.floor(F.unix_seconds("at") / 60))

    # rows of the minute at or after this one; equal times count as after
    later = Window.partitionBy("ph10", "minute").orderBy(F.col("at").desc())
    mark = F.col("n").isNull()
    running = line.select(
        "ph10",
        F.floor(F.col("minute") / 60).alias("hour"),
        "minute",
        mark.alias("mark"),
        "at",
        F.sum("n").over(later).alias("n"),
        F.sum("c").over(later).alias("c"),
        F.max(F.when(~mark, F.col("at"))).over(later).alias("last_at"),
    )
    # running totals only grow, so their maxima are the totals of the minute; the grouping uses
    # the window's own partitioning
    minutes = running.groupBy("ph10", "minute").agg(
        F.max("hour").alias("hour"),
        F.max("n").alias("n"),
        F.max("c").alias("c"),
        F.max("last_at").alias("last_at"),
        F.bool_or("mark").alias("marked"),
    )
    of_hour = minutes.select("*", *_later_totals(Window.partitionBy("ph10", "hour"), "minute"))
    hours = of_hour.groupBy("ph10", "hour").agg(F.sum("n").alias("n"), F.sum("c").alias("c"), F.max("last_at").alias("last_at"))
    of_phone = hours.select(
        F.col("ph10").alias("_ph10"), F.col("hour").alias("_hour"), *_later_totals(Window.partitionBy("ph10"), "hour", "far")
    )
    # null-safe on the slices, or the optimizer would filter one of the two readings of the line
    # for NULL slices and Spark could not share their shuffle
    same_hour = (F.col("ph10") == F.col("_ph10")) & F.col("hour").eqNullSafe(F.col("_hour"))
    rest = of_hour.filter("marked").join(of_phone, same_hour).select(
        F.col("ph10").alias("_ph10"),
        F.col("minute").alias("_minute"),
        *[(F.coalesce(f"more_{x}", F.lit(0)) + F.coalesce(f"far_{x}", F.lit(0))).alias(f"more_{x}") for x in ("n", "c")],
        F.greatest("more_last_at", "far_last_at").alias("more_last_at"),
    )
    same_minute = (F.col("ph10") == F.col("_ph10")) & F.col("minute").eqNullSafe(F.col("_minute"))
    return (
        running.filter("mark")
        .join(rest, same_minute)
        .select(
            "ph10",
            F.col("at").alias("since_at"),
            F.greatest("last_at", "more_last_at").alias("last_call_at"),
            (F.coalesce("n", F.lit(0)) + F.col("more_n")).alias("calls_30d"),
            (F.coalesce("c", F.lit(0)) + F.col("more_c")).alias("connects_30d"),
        )
        .filter(F.col("calls_30d") > 0)
    )


def _later_totals(slices: WindowSpec, order: str, name: str = "more") -> list[Column]:
    """Totals over the slices that lie after this one."""
    beyond = slices.orderBy(F.col(order).desc()).rowsBetween(Window.unboundedPreceding, -1)
    return [
        F.sum("n").over(beyond).alias(f"{name}_n"),
        F.sum("c").over(beyond).alias(f"{name}_c"),
        F.max("last_at").over(beyond).alias(f"{name}_last_at"),
    ]


def dials_by_phone(dials: DataFrame) -> DataFrame:
    """Totals per phone, dials with unreadable times included."""
    return dials.groupBy("ph10").agg(
        F.max("call_at").alias("last_call_at"),
        F.count(F.lit(1)).alias("calls_30d"),
        F.count_if("connected").alias("connects_30d"),
    )


def call_stats(
    leads: DataFrame,
    call_log: DataFrame,
    clock: Clock,
    *,
    days: int = 30,
    since_assignment: bool = True,
    keep: Column | None = None,
) -> DataFrame:
    """(lead_id, last_call_at, calls_30d, connects_30d) of the leads that were dialled."""
    phones = lead_phones(leads)
    dials = recent_dials(call_log, clock, days, keep)
    if since_assignment:
        # text days are cut in UTC and offsets reach 14 h, so no kept dial is older than this
        floor = instant(clock.days_ago(days + 2))
        since = F.greatest(F.coalesce("assigned_at", floor), floor)
        starts = phones.select("lead_id", "ph10", since.alias("since_at"))
        totals = dials_after(starts, prefilter(dials, starts, "ph10")).withColumnsRenamed({"ph10": "_ph10", "since_at": "_since_at"})
        # null-safe, though no phone is NULL here: the optimizer would carry the test of the leads' phones
        # over to one of the readings of the line, which could not share its shuffle then
        same = F.col("ph10").eqNullSafe(F.col("_ph10")) & (F.col("since_at") == F.col("_since_at"))
    else:
        starts = phones.select("lead_id", "ph10")
        totals, same = dials_by_phone(prefilter(dials, starts, "ph10")), ["ph10"]
    joined = starts.join(totals, same)
    return joined.select("lead_id", "last_call_at", "calls_30d", "connects_30d")


def manual_dials_today(leads: DataFrame, call_log: DataFrame, clock: Clock) -> DataFrame:
    """Leads whose phone was dialled by hand on the local day of the run."""
    # a local day starts at most a day before its UTC date text
    since = clock.days_ago(2).strftime("%Y-%m-%d")
    dialled = (
        call_log.filter((F.col("call_type") == MANUAL) & (F.col("created_at") >= since))
        .filter(
            local_date(instant_from_text(F.col("created_at"), ISO_INSTANT_PREFIX)) == clock.today_col()
        )
        .select(phone_key(F.col("call_to")).alias("ph10"))
        .filter("ph10 <> ''")  # an unknown number matches no lead
        .distinct()
    )
    phones = leads.select("lead_id", phone_key(F.col("customer_phone_number")).alias("ph10"))
    return lookup_join(phones, dialled, "ph10", how="inner").select("lead_id")

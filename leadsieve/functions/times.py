"""Instants, local calendar dates and the text forms they arrive in."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsieve.config import LOCAL_ZONE, MONTH_CHANGEOVER_DAYS

ISO_DATE_PREFIX = r"^\d{4}-\d{2}-\d{2}"
ISO_INSTANT_PREFIX = r"^\d{4}-\d{2}-\d{2}T"
CLOCK_12H = r"(?i)^\d{1,2}:\d{2}\s*[AP]M$"
WHOLE_CLOCK = r"^\d{1,2}:\d{2}\s*[AP]M\z"
MORNING_SECONDS = 9 * 3600
DAY_SECONDS = 86_400


def local_date(ts: Column) -> Column:
    """The local calendar date of an instant (session zone must be UTC)."""
    return F.to_date(F.from_utc_timestamp(ts, LOCAL_ZONE))


def close_from(today: Column) -> Column:
    """First day whose closes are audited on `today`; the column form of `Clock.close_from`."""
    start = F.trunc(today, "MM")
    young = F.datediff(today, start) < MONTH_CHANGEOVER_DAYS
    return F.when(young, F.add_months(start, -1)).otherwise(start)


def days_between(later: Column, earlier: Column) -> Column:
    return F.datediff(later, earlier).cast("bigint")


def instant_from_text(c: Column, shape: str) -> Column:
    """Parse ISO text that has the given prefix shape; NULL for anything else."""
    return F.when(c.rlike(shape), c.try_cast("timestamp"))


def clock_seconds(c: Column) -> Column:
    """Seconds of day of `9:30 PM` text; 09:00 when absent or malformed."""
    # arithmetic, since a parser throws for a time that does not exist, and per row that is slow
    text = F.upper(F.trim(c))
    hour, minute = F.substring_index(text, ":", 1).try_cast("int"), F.substring(F.substring_index(text, ":", -1), 1, 2).try_cast("int")
    exists = text.rlike(WHOLE_CLOCK) & hour.between(1, 12) & (minute < 60)
    half = F.when(text.endswith("PM"), 12).otherwise(0)
    return F.when(exists, (hour % 12 + half) * 3600 + minute * 60).otherwise(MORNING_SECONDS)


def instant_of_local(day: Column, seconds: Column) -> Column:
    """The instant at which the local wall clock shows `day` plus `seconds`."""
    wall = F.timestamp_seconds(F.unix_date(day).cast("bigint") * DAY_SECONDS + seconds)
    return F.to_utc_timestamp(wall, LOCAL_ZONE)


def hours_between(later: Column, earlier: Column) -> Column:
    gap = (F.unix_micros(later) - F.unix_micros(earlier)) / F.lit(3.6e9)
    return F.round(gap).cast("bigint")


def iso_text(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")

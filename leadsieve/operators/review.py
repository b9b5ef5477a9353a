"""The append-only review log and what is counted from it."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.config import Clock
from leadsieve.functions.text import blank_to_null, null_to_blank, one_line
from leadsieve.sources.schemas import RCA_COLUMNS

CELL = 900
DEFAULT_DAYS, MAX_DAYS = 45, 120
REWORK = "%rework%"
#: What `with_review` reads of a log row.
SEEN = ("audit_date", "lead_id", "reason")


def look_back_days(asked: str | int | None) -> int:
    """Days to read: 1 to 120; nothing, zero or words mean 45."""
    number = re.match(r"\s*([+-]?\d+)", str(asked if asked is not None else ""))
    days = int(number.group(1)) if number else 0
    return min(MAX_DAYS, max(1, days or DEFAULT_DAYS))


def new_reviews(items: DataFrame, logged_at: str, auditor_email: str = "", auditor_name: str = "") -> DataFrame:
    """Submitted reviews as log rows. A lead and a reason are required; a signed-in auditor
    outweighs the one in the submission; the action starts out open."""
    valid = items.filter((null_to_blank(F.col("lead_id")) != "") & (null_to_blank(F.col("reason")) != ""))
    made = {
        "logged_at": F.lit(logged_at),
        "auditor_email": F.lit(auditor_email) if auditor_email else F.col("auditor_email"),
        "auditor_name": F.lit(auditor_name) if auditor_name else F.col("auditor_name"),
        "action_status": F.coalesce(blank_to_null(F.col("action_status")), F.lit("open")),
    }
    return valid.select(
        *[made[c].alias(c) if c == "logged_at" else one_line(made.get(c, F.col(c)), CELL).alias(c) for c in RCA_COLUMNS]
    )


def review_day() -> Column:
    return F.substring(null_to_blank(F.col("audit_date")), 1, 10)


def reviews_in_window(log: DataFrame, clock: Clock, days: str | int | None = None) -> DataFrame:
    """Reviews of the last days; undated ones are kept."""
    cut = clock.days_ago(look_back_days(days)).date().isoformat()
    return log.filter((review_day() == "") | (review_day() >= cut))


def newest_reviews(log: DataFrame, fields: Sequence[str] | None = None) -> DataFrame:
    """One row per audit day and lead: the newest, and of equals the one appended later.

    A log row is wide. Name the `fields` that are read afterwards: the others are neither sorted nor shuffled.
    """
    order = F.struct(null_to_blank(F.col("logged_at")), F.col("seq"))
    return (
        log.groupBy(review_day().alias("_day"), null_to_blank(F.col("lead_id")).alias("_lead"))
        .agg(F.max_by(F.struct(*(fields or log.columns)), order).alias("r"))
        .select("r.*")
    )


def with_review(rows: DataFrame, newest: DataFrame) -> DataFrame:
    """Queue rows with `done` and the reason of their newest review."""
    seen = newest.select(
        review_day().alias("_day"), F.col("lead_id"), F.col("reason").alias("review_reason"), F.lit(True).alias("_seen")
    )
    day = F.substring(F.col("audit_date").cast("string"), 1, 10)
    return (
        rows.withColumn("_day", day)
        .join(seen, ["_day", "lead_id"], "left")
        .withColumn("done", F.coalesce("_seen", F.lit(False)))
        .drop("_day", "_seen")
    )


def done_by_team(reviewed: DataFrame) -> DataFrame:
    return reviewed.groupBy("tl_email").agg(
        F.count(F.lit(1)).alias("queued"),
        F.count_if("done").alias("done"),
        F.count_if(~F.col("done")).alias("pending"),
    )


def adherence_month_to_date(picked: DataFrame, newest: DataFrame, clock: Clock) -> DataFrame:
    """Share of picked leads reviewed, per team lead, since the first of the local month."""
    day = F.col("audit_date").cast("date")
    month = picked.filter((day >= F.lit(clock.month_start)) & (day <= clock.today_col()))
    counts = with_review(month, newest).groupBy("tl_email").agg(
        F.count(F.lit(1)).alias("picked"), F.count_if("done").alias("reviewed")
    )
    return counts.withColumn("adherence_pct", F.round(F.col("reviewed") * 100.0 / F.col("picked"), 1))


def rework_counts(newest: DataFrame) -> DataFrame:
    """Reviews sent back, per team lead and reviewer."""
    return newest.groupBy("tl_email", "reviewer_email").agg(
        F.count_if(null_to_blank(F.col("review_verdict")) != "").alias("judged"),
        F.count_if(F.col("review_verdict").ilike(REWORK)).alias("rework"),
    )

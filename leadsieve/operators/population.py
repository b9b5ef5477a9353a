"""Which leads are looked at, and the plain per-lead projections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.config import Clock, instant
from leadsieve.functions.text import PHONE_DIGITS, blank_to_null, phone_key
from leadsieve.functions.times import (
    ISO_DATE_PREFIX,
    ISO_INSTANT_PREFIX,
    clock_seconds,
    instant_from_text,
    instant_of_local,
    local_date,
)


def not_set(flag: str) -> Column:
    """NULL and 0 both mean the flag is off; written so that the scan can use it."""
    return F.col(flag).isNull() | (F.col(flag) == 0)


def none_of(name: str, values: tuple[str, ...]) -> Column:
    return F.col(name).isNull() | ~F.col(name).isin(*values)


def is_open(clock: Clock, rules) -> Column:
    """Undeleted, recent, recently touched and not closed in the lead table."""
    out = not_set("is_delete") & not_set("customer_is_delete")
    if rules.max_age_months is not None:
        out = out & (F.col("created_at") >= instant(clock.months_ago(rules.max_age_months)))
    out = out & (F.col("updated_at") >= instant(clock.days_ago(rules.touched_days)))
    if rules.closed_statuses:
        out = out & none_of("status", rules.closed_statuses)
    if rules.closed_stages:
        out = out & none_of("stage", rules.closed_stages)
    return out


def open_funnel(leads: DataFrame, clock: Clock, rules) -> DataFrame:
    return leads.filter(is_open(clock, rules))


def lead_phones(leads: DataFrame) -> DataFrame:
    """(lead_id, ph10, assigned_at) of the leads with a full phone number."""
    return leads.select(
        "lead_id",
        phone_key(F.col("customer_phone_number")).alias("ph10"),
        instant_from_text(F.col("lrm_assigned_at"), ISO_INSTANT_PREFIX).alias("assigned_at"),
    ).filter(F.length("ph10") == PHONE_DIGITS)


def full_name(*parts: str) -> Column:
    return F.trim(F.concat_ws(" ", *[F.col(p) for p in parts]))


def customer_name() -> Column:
    return blank_to_null(full_name("customer_first_name", "customer_middle_name", "customer_last_name"))


def pin_key() -> Column:
    """Pin code of the site, else of the meeting place."""
    return F.coalesce(
        blank_to_null(F.trim("site_address_pin_code")),
        blank_to_null(F.trim("meeting_address_pin_code")),
    )


def written_city() -> Column:
    return F.coalesce(
        blank_to_null(F.trim("site_address_city")),
        blank_to_null(F.trim("meeting_address_city")),
    )


def promised_instant() -> Column:
    """The rescheduled local day at its clock time, 09:00 when the time is unreadable."""
    day = local_date(F.col("reschedule_date"))
    return F.when(
        F.col("reschedule_date").isNotNull(),
        instant_of_local(day, clock_seconds(F.col("reschedule_time"))),
    )


FOLLOW_UP_SOURCES = {
    "promise": promised_instant,
    "next_action": lambda: F.col("lrm_queue_entry_next_action_at"),
    "crm_field": lambda: F.col("follow_up_datetime"),
}


def follow_up_at(sources: tuple[str, ...]) -> Column:
    return F.coalesce(*[FOLLOW_UP_SOURCES[s]() for s in sources])


def qualified_at(shape: str = ISO_DATE_PREFIX) -> Column:
    return instant_from_text(F.col("qualified_datetime"), shape)


def attempt_today() -> Column:
    return F.coalesce(F.col("lrm_queue_entry_attempts_today") > 0, F.lit(False))


def current_stage(audit_stage: str = "audit_stage", table_stage: str = "stage") -> Column:
    """Newest audit stage when it is not blank, else the lead table's own, untrimmed."""
    return F.coalesce(blank_to_null(F.trim(audit_stage)), F.col(table_stage))


def stage_mismatch(audit_stage: str = "audit_stage", table_stage: str = "stage") -> Column:
    seen = F.trim(audit_stage)
    stored = F.trim(F.coalesce(F.col(table_stage), F.lit("")))
    return blank_to_null(seen).isNotNull() & ~seen.eqNullSafe(stored)

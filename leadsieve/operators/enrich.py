"""The wide per-lead row: lead columns, history facts, dial totals and silence."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.config import DEFAULT_ALIAS, Clock, MailAlias
from leadsieve.functions.text import mail_key
from leadsieve.functions.times import (
    ISO_DATE_PREFIX,
    ISO_INSTANT_PREFIX,
    days_between,
    hours_between,
    local_date,
)
from leadsieve.operators import population as pop
from leadsieve.operators import rules as r
from leadsieve.operators.skew import lookup_join

COUNTS = ("loop_turns", "mcch_events", "dev_events", "md_events", "calls_30d", "connects_30d")
SIGNAL_TYPES = {
    "last_call_at": "call",
    "meeting_done_touch": "meeting_done",
    "follow_up_at": "followup_set",
    "last_stage_at": "stage_change",
}
EMPTY_TIMES = ("audit_stage_at", "ni_at", "nq_at")


def with_nulls(df: DataFrame, names: tuple[str, ...], kind: str) -> DataFrame:
    missing = [n for n in names if n not in df.columns]
    return df.withColumns({n: F.lit(None).cast(kind) for n in missing}) if missing else df


def lead_facts(base: DataFrame, history: DataFrame, rules: r.RuleSet) -> DataFrame:
    """One row per lead in scope with its history facts and the columns the rules read."""
    return facts_row(base.join(history, "lead_id", "left"), rules)


def facts_row(wide: DataFrame, rules: r.RuleSet, carry: Sequence[str] = ()) -> DataFrame:
    """The columns the rules read from a lead and its history facts on one row; `carry` are kept too."""
    wide = with_nulls(with_nulls(wide, EMPTY_TIMES, "timestamp"), ("audit_stage",), "string")
    if rules.stage_from_history:
        stage, mismatch = pop.current_stage(), pop.stage_mismatch()
    else:
        stage, mismatch = F.col("stage"), F.lit(False)
    shape = ISO_INSTANT_PREFIX if rules.qualified_with_time else ISO_DATE_PREFIX
    out = wide.select(
        *carry,
        "lead_id",
        pop.customer_name().alias("customer_name"),
        pop.pin_key().alias("pin_key"),
        pop.written_city().alias("written_city"),
        F.col("assigned_lrm").alias("lrm_id"),
        stage.alias("current_stage"),
        F.col("status").alias("current_status"),
        F.col("audit_stage_at").alias("current_stage_at"),
        F.col("stage").alias("lead_table_stage"),
        mismatch.alias("stage_mismatch"),
        "created_at",
        F.col("meeting_confirmed_datetime").alias("meeting_confirmed_at"),
        "meeting_schedule_date",
        "meeting_done_date",
        pop.follow_up_at(rules.follow_up).alias("follow_up_at"),
        F.col("follow_up_datetime").alias("follow_up_datetime_raw"),
        F.col("reschedule_date").alias("reschedule_date_raw"),
        F.col("reschedule_time").alias("reschedule_time_raw"),
        pop.qualified_at(shape).alias("qualified_at"),
        F.col("order_closure_datetime").alias("status_changed_at"),
        pop.attempt_today().alias("attempt_today"),
        "last_stage_at",
        F.col("first_meeting_done_date").alias("meeting_done_touch"),
        F.col("updated_at").alias("crm_updated_at"),
        "ni_at",
        "nq_at",
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in COUNTS if c in wide.columns],
    )
    return out.withColumns(
        {
            "created_ist": local_date(F.col("created_at")),
            "msd_ist": local_date(F.col("meeting_schedule_date")),
            "mdd_ist": local_date(F.col("meeting_done_date")),
            "fu_ist": local_date(F.col("follow_up_at")),
            "stage_ist": local_date(F.col("last_stage_at")),
            "ni_ist": local_date(F.col("ni_at")),
            "nq_ist": local_date(F.col("nq_at")),
            "stage_lc": F.lower(F.trim(F.coalesce("current_stage", F.lit("")))),
        }
    )


def not_blocked(facts: DataFrame, rules: r.RuleSet) -> DataFrame:
    return facts.filter(~F.col("stage_lc").isin(rules.blocked)) if rules.blocked else facts


def with_calls(facts: DataFrame, stats: DataFrame | None) -> DataFrame:
    if stats is None:
        out = facts.withColumn("last_call_at", F.lit(None).cast("timestamp"))
    else:
        out = facts.join(stats, "lead_id", "left")
    return out.withColumns(
        {c: F.coalesce(c, F.lit(0)).cast("bigint") for c in ("calls_30d", "connects_30d") if c in out.columns}
    )


def newest_signal(rules: r.RuleSet) -> Column:
    """The newest of the signals a rep can be credited with; missing ones are skipped."""
    return F.greatest(*rules.signals)


def signal_type(rules: r.RuleSet) -> Column:
    chain = F.when(F.col("last_activity_at").isNull(), "none")
    for name in rules.signal_order:
        chain = chain.when(F.col("last_activity_at") == F.col(name), SIGNAL_TYPES[name])
    return chain.otherwise(rules.signal_rest)


def with_silence(facts: DataFrame, rules: r.RuleSet, clock: Clock) -> DataFrame:
    """Last activity, quiet days and hours. A promise in the future makes both negative."""
    seen = facts.withColumn("last_activity_at", newest_signal(rules))
    since = F.col("last_activity_at")
    if not rules.hours_need_activity:
        since = F.coalesce(since, "created_at")
    return seen.withColumns(
        {
            "last_activity_type": signal_type(rules),
            "quiet_days": F.coalesce(
                days_between(clock.today_col(), local_date(F.col("last_activity_at"))),
                days_between(clock.today_col(), F.col("created_ist")),
            ),
            "hours_silent": hours_between(clock.instant_col(), since),
        }
    )


def with_stage_flags(facts: DataFrame, rules: r.RuleSet) -> DataFrame:
    return facts.withColumns(
        {
            "meeting_really_done": r.meeting_really_done(rules),
            "is_ni": r.is_not_interested(rules),
            "is_nq": r.is_not_qualified(rules),
            "no_md_ever": r.no_meeting_ever(),
        }
    )


def categorised(facts: DataFrame, rules: r.RuleSet, clock: Clock) -> DataFrame:
    """Leads that some arm claims, with category, leak code and scores."""
    out = facts.withColumn("category", r.category(rules, clock)).filter(F.col("category").isNotNull())
    if rules.uses_calls:
        out = out.withColumn("leak_code", r.leak_code(rules))
    return out.withColumns(
        {"rank_key": r.rank_key(rules, clock), "overdue_days": r.overdue_days(rules, clock)}
    )


def geo_rollup(geo: DataFrame) -> DataFrame:
    """Largest cluster and city name per active pin code; the two may come from different rows."""
    return (
        geo.filter((F.col("pincode_status") == "active") & pop.not_set("is_delete"))
        .groupBy(F.trim("pin_code").alias("pin_key"))
        .agg(F.max("cluster").alias("geo_cluster"), F.max("city").alias("geo_city"))
    )


def user_names(users: DataFrame, alias: MailAlias = DEFAULT_ALIAS) -> DataFrame:
    return users.select(
        F.col("user_id").alias("lrm_id"),
        pop.full_name("first_name", "last_name").alias("lrm_name"),
        mail_key(F.col("emails"), alias).alias("lrm_email"),
    )


def with_geo(rows: DataFrame, geo: DataFrame, rules: r.RuleSet) -> DataFrame:
    joined = lookup_join(rows, geo_rollup(geo), "pin_key")
    names = ["geo_cluster", "geo_city"] + (["written_city"] if rules.written_cities else [])
    return joined.withColumn("cluster", F.coalesce(*names))


def with_owner(rows: DataFrame, users: DataFrame, alias: MailAlias = DEFAULT_ALIAS) -> DataFrame:
    """Owner's name (blank, not NULL, for an unknown owner) and normalised address."""
    joined = lookup_join(rows, user_names(users, alias), "lrm_id")
    return joined.withColumn("lrm_name", F.coalesce("lrm_name", F.lit("")))

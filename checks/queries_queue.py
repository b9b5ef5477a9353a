"""Registered queries: population, facts, rules and the ranked queue."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import crm_views as crm
from checks.oracle_crm import (
    BLOCKED,
    CLOCK_MINUTES,
    LOOP_TEST,
    PROMISE,
    TODAY,
    as_text,
    day,
    digits_of,
    iso,
    mail_key,
    three_days_later,
)
from checks.registration import register, texts
from leadsieve.config import Clock
from leadsieve.functions import times
from leadsieve.operators import calls, enrich, history, population, quality
from leadsieve.operators import rules as r
from leadsieve.operators.skew import lookup_join, prefilter
from leadsieve.plans import queue as plan
from leadsieve.session import scratch_path
from leadsieve.sources.schemas import LEAD_HISTORY
from leadsieve.streaming import latest

CLOCK = crm.CLOCK
RULES = r.CURRENT


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lead facts without dials, for the operators that read only those."""
    tables = crm.crm_tables(spark, sf_dir)
    base = plan.scoped_leads(tables, CLOCK)
    return enrich.lead_facts(base, history.history_facts(tables.history, base.select("lead_id"), RULES), RULES)


def states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.audited_facts(crm.crm_tables(spark, sf_dir), CLOCK)


def flagged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.flagged_leads(crm.crm_tables(spark, sf_dir), CLOCK)


def scoped(spark: SparkSession, sf_dir: str) -> DataFrame:
    return population.open_funnel(crm.lead(spark, sf_dir), CLOCK, RULES)


# ---- whole plans -----------------------------------------------------------------------


@register("audit_queue", f"SELECT {as_text(r.COLUMNS_V7_8)} FROM queue_row")
def audit_queue(spark, sf_dir):
    return texts(plan.build_queue(crm.crm_tables(spark, sf_dir), CLOCK))


@register("project_queue", f"SELECT {as_text(r.COLUMNS_V7_8)} FROM queue_row")
def project_queue(spark, sf_dir):
    return texts(plan.build_queue(crm.crm_tables(spark, sf_dir), CLOCK, sort=False))


# ---- population and projections --------------------------------------------------------


@register(
    "base_open_funnel",
    f"SELECT lead_id, {iso('created_at')} AS created_at, {iso('updated_at')} AS updated_at, status, stage FROM open_lead",
)
def base_open_funnel(spark, sf_dir):
    return texts(scoped(spark, sf_dir).select("lead_id", "created_at", "updated_at", "status", "stage"))


@register(
    "stage_blocklist",
    "SELECT lead_id, current_stage FROM audit_row WHERE NOT blocked",
)
def stage_blocklist(spark, sf_dir):
    return enrich.not_blocked(facts(spark, sf_dir), RULES).select("lead_id", "current_stage")


@register(
    "anti_blocklist",
    f"SELECT stage, count(*) AS events FROM crm_event WHERE lower(trim(coalesce(stage, ''))) NOT IN {BLOCKED} GROUP BY stage",
)
def anti_blocklist(spark, sf_dir):
    """The blocklist as an anti join against a table of stages, for lists kept as data."""
    listed = spark.createDataFrame([(s,) for s in RULES.blocked], "stage_lc STRING")
    events = crm.lead_history(spark, sf_dir).withColumn("stage_lc", F.lower(F.trim(F.coalesce("stage", F.lit("")))))
    kept = events.join(F.broadcast(listed), "stage_lc", "left_anti")
    return kept.groupBy("stage").agg(F.count(F.lit(1)).alias("events"))


@register(
    "clock",
    f"""SELECT CAST(today AS VARCHAR) AS today, CAST(date_trunc('month', today) AS DATE)::VARCHAR AS month_start,
      CAST(if(day(today) <= 7, date_trunc('month', today) - INTERVAL 1 MONTH, date_trunc('month', today)) AS DATE)::VARCHAR
        AS close_from, count(*) AS leads
    FROM (SELECT {day('created_at')} AS today FROM crm_lead) GROUP BY ALL""",
)
def clock(spark, sf_dir):
    """The run clock as it would stand at each lead's creation."""
    today = times.local_date(F.col("created_at"))
    days = crm.lead(spark, sf_dir).select(today.alias("today")).groupBy("today").agg(F.count(F.lit(1)).alias("leads"))
    start = F.trunc("today", "MM").alias("month_start")
    return texts(days.select("today", start, times.close_from(F.col("today")).alias("close_from"), "leads"))


@register(
    "cross_cfg",
    f"""SELECT lead_id, '{'2024-01-31'}' AS today, '2024-01-01' AS close_from, 14 AS breach_window_days,
      CAST({TODAY} - {day('created_at')} AS BIGINT) AS age_days FROM open_lead""",
)
def cross_cfg(spark, sf_dir):
    """Clock and thresholds are literals on every row; there is nothing to join."""
    return texts(
        scoped(spark, sf_dir).select(
            "lead_id",
            CLOCK.today_col().alias("today"),
            CLOCK.close_from_col().alias("close_from"),
            F.lit(RULES.thresholds.breach_window_days).alias("breach_window_days"),
            times.days_between(CLOCK.today_col(), times.local_date(F.col("created_at"))).alias("age_days"),
        )
    )


@register(
    "current_stage",
    f"SELECT lead_id, current_stage, {iso('last_stage_at')} AS current_stage_at, stage AS lead_table_stage FROM audit_row",
)
def current_stage(spark, sf_dir):
    return texts(facts(spark, sf_dir).select("lead_id", "current_stage", "current_stage_at", "lead_table_stage"))


@register(
    "stage_mismatch",
    "SELECT lead_id, current_stage, stage AS lead_table_stage FROM audit_row WHERE stage_differs",
)
def stage_mismatch(spark, sf_dir):
    rows = facts(spark, sf_dir).filter("stage_mismatch")
    return rows.select("lead_id", "current_stage", "lead_table_stage")


@register(
    "follow_up_at",
    f"""SELECT lead_id, {iso(f'coalesce({PROMISE}, lrm_queue_entry_next_action_at, follow_up_datetime)')} AS follow_up_at,
    CAST({CLOCK_MINUTES} AS BIGINT) AS clock_minutes, reschedule_time FROM crm_lead""",
)
def follow_up_at(spark, sf_dir):
    leads = crm.lead(spark, sf_dir)
    readable = F.trim("reschedule_time").rlike(times.CLOCK_12H) & ~F.col("reschedule_time").startswith("13")
    return texts(
        leads.select(
            "lead_id",
            population.follow_up_at(RULES.follow_up).alias("follow_up_at"),
            F.when(readable, times.clock_seconds(F.col("reschedule_time")) / 60).cast("bigint").alias("clock_minutes"),
            "reschedule_time",
        )
    )


@register(
    "silence",
    f"""SELECT lead_id, {iso('last_activity_at')} AS last_activity_at, last_activity_type, quiet AS quiet_days, hours_silent
    FROM audit_row WHERE NOT blocked""",
)
def silence(spark, sf_dir):
    return texts(
        states(spark, sf_dir).select("lead_id", "last_activity_at", "last_activity_type", "quiet_days", "hours_silent")
    )


@register(
    "greatest_activity",
    f"""SELECT lead_id, {iso('greatest(last_stage_at, last_call_at, met_at, follow_up_at)')} AS last_activity_at,
      CAST({TODAY} - coalesce({day('greatest(last_stage_at, last_call_at, met_at, follow_up_at)')}, created_day) AS BIGINT) AS quiet_days
    FROM audit_row""",
)
def greatest_activity(spark, sf_dir):
    """The four signals of every open lead, blocked ones too, through the operator that credits them."""
    open_leads = facts(spark, sf_dir)
    dialled = calls.call_stats(scoped(spark, sf_dir), crm.call_log(spark, sf_dir), CLOCK)
    rows = enrich.with_silence(enrich.with_calls(open_leads, dialled), RULES, CLOCK)
    return texts(rows.select("lead_id", "last_activity_at", "quiet_days"))


@register(
    "activity_union",
    f"""SELECT lead_id, {iso('max(seen_at)')} AS last_activity_at FROM (
      SELECT lead_id, unnest([last_stage_at, last_call_at, met_at, follow_up_at]) AS seen_at FROM audit_row WHERE NOT blocked)
    GROUP BY lead_id""",
)
def activity_union(spark, sf_dir):
    """Signals "unioned, newest wins" is a row-wise maximum: no union and no shuffle."""
    return texts(states(spark, sf_dir).select("lead_id", enrich.newest_signal(RULES).alias("last_activity_at")))


@register(
    "phone_key",
    f"""SELECT lead_id, right({digits_of('customer_phone_number')}, 10) AS ph10,
    {iso("CASE WHEN lrm_assigned_at <> 'n/a' THEN try_cast(lrm_assigned_at AS TIMESTAMP) END")} AS assigned_at
    FROM crm_lead WHERE length(right({digits_of('customer_phone_number')}, 10)) = 10""",
)
def phone_key(spark, sf_dir):
    return texts(population.lead_phones(crm.lead(spark, sf_dir)))


@register(
    "valid_phone",
    f"""SELECT length({digits_of('customer_phone_number')}) AS digits, count(*) AS leads FROM crm_lead
    WHERE length(right({digits_of('customer_phone_number')}, 10)) = 10 GROUP BY 1""",
)
def valid_phone(spark, sf_dir):
    leads = crm.lead(spark, sf_dir)
    kept = leads.join(population.lead_phones(leads).select("lead_id"), "lead_id", "left_semi")
    size = F.length(F.regexp_replace("customer_phone_number", r"\D", ""))
    return kept.groupBy(size.alias("digits")).agg(F.count(F.lit(1)).alias("leads"))


@register(
    "place_and_names",
    f"""SELECT lead_id, nullif(trim(concat_ws(' ', customer_first_name, customer_middle_name, customer_last_name)), '')
      AS customer_name,
      coalesce(geo_cluster, geo_city, nullif(trim(site_address_city), ''), nullif(trim(meeting_address_city), ''))
        AS cluster,
      trim(concat_ws(' ', first_name, last_name)) AS lrm_name, {mail_key('emails')} AS lrm_email
    FROM crm_lead LEFT JOIN pin_place ON pin = coalesce(nullif(trim(site_address_pin_code), ''),
      nullif(trim(meeting_address_pin_code), '')) LEFT JOIN crm_user ON user_id = assigned_lrm""",
)
def place_and_names(spark, sf_dir):
    leads = crm.lead(spark, sf_dir).select(
        "lead_id",
        population.customer_name().alias("customer_name"),
        population.pin_key().alias("pin_key"),
        population.written_city().alias("written_city"),
        F.col("assigned_lrm").alias("lrm_id"),
    )
    rows = enrich.with_owner(enrich.with_geo(leads, crm.geo(spark, sf_dir), RULES), crm.users(spark, sf_dir))
    return rows.select("lead_id", "customer_name", "cluster", "lrm_name", "lrm_email")


@register(
    "qualified_at",
    f"""SELECT lead_id, {iso("CASE WHEN qualified_datetime LIKE '____-__-__%' THEN try_cast(qualified_datetime AS TIMESTAMP) END")}
      AS qualified_at, {iso('order_closure_datetime')} AS status_changed_at,
      coalesce(lrm_queue_entry_attempts_today, 0) > 0 AS attempt_today FROM crm_lead""",
)
def qualified_at(spark, sf_dir):
    return texts(
        crm.lead(spark, sf_dir).select(
            "lead_id",
            population.qualified_at().alias("qualified_at"),
            F.col("order_closure_datetime").alias("status_changed_at"),
            population.attempt_today().alias("attempt_today"),
        )
    )


@register(
    "call_window",
    f"SELECT ph10, {iso('call_at')} AS call_at, connected, dials FROM (SELECT ph10, call_at, connected, count(*) AS dials FROM dial GROUP BY ALL)",
)
def call_window(spark, sf_dir):
    dials = calls.recent_dials(crm.call_log(spark, sf_dir), CLOCK, 30).filter(F.col("call_at").isNotNull())
    return texts(dials.groupBy("ph10", "call_at", "connected").agg(F.count(F.lit(1)).alias("dials")))


@register(
    "active_pincode",
    """SELECT trim(pin_code) AS pin, cluster, city, count(*) AS n FROM crm_geo
    WHERE pincode_status = 'active' AND coalesce(is_delete, 0) = 0 GROUP BY ALL""",
)
def active_pincode(spark, sf_dir):
    rows = crm.geo(spark, sf_dir).filter((F.col("pincode_status") == "active") & population.not_set("is_delete"))
    return rows.groupBy(F.trim("pin_code").alias("pin"), "cluster", "city").agg(F.count(F.lit(1)).alias("n"))


def stage_flag(name: str, sql_test: str):
    @register(name, f"SELECT current_stage, {sql_test} AS {name}, count(*) AS leads FROM audit_row WHERE NOT blocked GROUP BY ALL")
    def run(spark, sf_dir):
        return (
            states(spark, sf_dir)
            .groupBy("current_stage", F.col(FLAG_COLUMNS[name]).alias(name))
            .agg(F.count(F.lit(1)).alias("leads"))
        )


FLAG_COLUMNS = {
    "is_not_interested": "is_ni",
    "is_not_qualified": "is_nq",
    "meeting_really_done": "meeting_really_done",
    "no_md_ever": "no_md_ever",
}
stage_flag("is_not_interested", "is_ni")
stage_flag("is_not_qualified", "is_nq")
stage_flag("meeting_really_done", "met")
stage_flag("no_md_ever", "no_md_ever")


# ---- history, dials, places ------------------------------------------------------------


@register("semi_base", "SELECT lead_id, count(*) AS events, max(event_id) AS last_id FROM crm_event SEMI JOIN open_lead USING (lead_id) GROUP BY lead_id")
def semi_base(spark, sf_dir):
    ids = scoped(spark, sf_dir).select("lead_id")
    events = prefilter(crm.lead_history(spark, sf_dir), ids, "lead_id")
    counts = events.groupBy("lead_id").agg(F.count(F.lit(1)).alias("events"), F.max("event_id").alias("last_id"))
    return counts.join(ids, "lead_id", "left_semi")


@register(
    "latest_stage",
    """SELECT lead_id, stage AS audit_stage, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS audit_stage_at FROM crm_event
    QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC NULLS LAST, event_id DESC) = 1""",
)
def latest_stage(spark, sf_dir):
    return texts(history.latest_stage(crm.lead_history(spark, sf_dir)))


def in_batches(events: DataFrame) -> DataFrame:
    """Events with their batch by age, dealt so that a batch is files of bounded size and no task holds one whole."""
    age = F.floor(F.datediff(CLOCK.today_col(), F.col("created_at")) / 30).cast("int")
    return events.withColumn("batch", F.least(age, F.lit(2))).hint("rebalance", "batch")


@register(
    "latest_stage_kept",
    """SELECT lead_id, stage AS audit_stage, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS audit_stage_at FROM crm_event
    QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC NULLS LAST, event_id DESC) = 1""",
)
def latest_stage_kept(spark, sf_dir):
    """The same from a stream: events arrive in three batches of files, the oldest last, and one batch twice."""
    root = scratch_path(spark, "followed")
    events = crm.lead_history(spark, sf_dir)
    in_batches(events).write.partitionBy("batch").parquet(f"{root}/in")
    for name in ("batch=0", "batch=1", "batch=2", "batch=0"):
        done = latest.follow(spark, f"{root}/in/{name}", LEAD_HISTORY, f"{root}/kept", f"{root}/seen-{scratch_path(spark, 'x')[-8:]}")
        done.awaitTermination()
    return texts(latest.read_latest(spark, f"{root}/kept"))


@register(
    "distinct_on",
    """SELECT lead_id, event_id, strftime(created_at, '%Y-%m-%dT%H:%M:%SZ') AS created_at, stage FROM crm_event
    QUALIFY row_number() OVER (PARTITION BY lead_id ORDER BY created_at DESC, event_id DESC) = 1""",
)
def distinct_on(spark, sf_dir):
    """One whole row per key: the largest ordering wins, combined map-side."""
    row = F.max_by(F.struct("event_id", "created_at", "stage"), F.struct("created_at", "event_id"))
    return texts(crm.lead_history(spark, sf_dir).groupBy("lead_id").agg(row.alias("r")).select("lead_id", "r.*"))


@register(
    "terminal_dates",
    f"SELECT lead_id, {iso('ni_at')} AS ni_at, {iso('nq_at')} AS nq_at FROM lead_events SEMI JOIN open_lead USING (lead_id)",
)
def terminal_dates(spark, sf_dir):
    rows = history.closing_dates(crm.lead_history(spark, sf_dir), RULES)
    return texts(rows.join(scoped(spark, sf_dir).select("lead_id"), "lead_id", "left_semi"))


@register(
    "milestones",
    f"""SELECT lead_id, {iso('max(created_at)')} AS last_stage_at,
    {iso('max(meeting_confirmed_datetime)')} AS meeting_confirmed_datetime,
    {iso('max(meeting_schedule_date)')} AS meeting_schedule_date, {iso('max(meeting_done_date)')} AS meeting_done_date
    FROM crm_event GROUP BY lead_id""",
)
def milestones(spark, sf_dir):
    return texts(history.milestones(crm.lead_history(spark, sf_dir)))


@register(
    "loop_counts",
    f"""SELECT lead_id, count(*) FILTER ({LOOP_TEST}) AS loop_turns,
    count(*) FILTER (stage ILIKE 'meeting confirmed%') AS mcch_events, count(*) FILTER (stage = 'DEV Scheduled') AS dev_events,
    count(*) FILTER (stage ILIKE 'meeting done%') AS md_events FROM crm_event GROUP BY lead_id""",
)
def loop_counts(spark, sf_dir):
    return history.loop_counts(crm.lead_history(spark, sf_dir), RULES)


@register(
    "join_calls",
    f"SELECT lead_id, {iso('last_call_at')} AS last_call_at, calls_30d, connects_30d FROM lead_dials",
)
def join_calls(spark, sf_dir):
    return texts(calls.call_stats(scoped(spark, sf_dir), crm.call_log(spark, sf_dir), CLOCK))


@register(
    "call_stats",
    f"""SELECT ph10, {iso('max(call_at)')} AS last_call_at, count(*) AS calls_30d,
    count(*) FILTER (connected) AS connects_30d FROM dial GROUP BY ph10""",
)
def call_stats(spark, sf_dir):
    dials = calls.recent_dials(crm.call_log(spark, sf_dir), CLOCK, 30).filter(F.col("call_at").isNotNull())
    return texts(calls.dials_by_phone(dials))


@register("geo_rollup", "SELECT pin AS pin_key, geo_cluster, geo_city FROM pin_place")
def geo_rollup(spark, sf_dir):
    return enrich.geo_rollup(crm.geo(spark, sf_dir))


@register(
    "join_geo",
    """SELECT lead_id, k AS pin_key, geo_cluster, geo_city FROM (SELECT lead_id,
      coalesce(nullif(trim(site_address_pin_code), ''), nullif(trim(meeting_address_pin_code), '')) AS k FROM open_lead)
    LEFT JOIN pin_place ON pin = k""",
)
def join_geo(spark, sf_dir):
    leads = scoped(spark, sf_dir).select("lead_id", population.pin_key().alias("pin_key"))
    joined = lookup_join(leads, enrich.geo_rollup(crm.geo(spark, sf_dir)), "pin_key")
    return joined.select("lead_id", "pin_key", "geo_cluster", "geo_city")


@register(
    "join_user",
    f"""SELECT lead_id, assigned_lrm AS lrm_id, trim(concat_ws(' ', first_name, last_name)) AS lrm_name,
    {mail_key('emails')} AS lrm_email FROM open_lead LEFT JOIN crm_user ON user_id = assigned_lrm""",
)
def join_user(spark, sf_dir):
    leads = scoped(spark, sf_dir).select("lead_id", F.col("assigned_lrm").alias("lrm_id"))
    return enrich.with_owner(leads, crm.users(spark, sf_dir)).select("lead_id", "lrm_id", "lrm_name", "lrm_email")


@register(
    "join_enrich",
    f"""SELECT lead_id, current_stage, {iso('last_stage_at')} AS last_stage_at, CAST(ni_day AS VARCHAR) AS ni_ist,
    CAST(nq_day AS VARCHAR) AS nq_ist, {iso('meeting_schedule_date')} AS meeting_schedule_date, loop_turns, mcch_events,
    {iso('last_call_at')} AS last_call_at, calls_30d, connects_30d FROM audit_row WHERE NOT blocked""",
)
def join_enrich(spark, sf_dir):
    return texts(
        states(spark, sf_dir).select(
            "lead_id", "current_stage", "last_stage_at", "ni_ist", "nq_ist", "meeting_schedule_date",
            "loop_turns", "mcch_events", "last_call_at", "calls_30d", "connects_30d",
        )
    )


# ---- rules and ranks -------------------------------------------------------------------


@register("categorise", "SELECT lead_id, category FROM flagged_row")
def categorise(spark, sf_dir):
    return flagged(spark, sf_dir).select("lead_id", "category")


@register("leak_code", "SELECT lead_id, category, leak_code, calls_30d, connects_30d FROM flagged_row")
def leak_code(spark, sf_dir):
    return flagged(spark, sf_dir).select("lead_id", "category", "leak_code", "calls_30d", "connects_30d")


@register("rank_key", "SELECT lead_id, category, rank_key FROM flagged_row")
def rank_key(spark, sf_dir):
    return flagged(spark, sf_dir).select("lead_id", "category", "rank_key")


@register("overdue_days", "SELECT lead_id, category, overdue AS overdue_days FROM flagged_row")
def overdue_days(spark, sf_dir):
    return flagged(spark, sf_dir).select("lead_id", "category", "overdue_days")


@register("lrm_category_rank", "SELECT lead_id, lrm_id, category, rank_key, lrm_category_rank FROM ranked_row")
def lrm_category_rank(spark, sf_dir):
    """Every rank, not only the first twenty: groups are cut into slices."""
    ranked = plan.all_ranks(flagged(spark, sf_dir), RULES)
    return ranked.select("lead_id", "lrm_id", "category", "rank_key", "lrm_category_rank")


@register(
    "topk_lrm_category",
    "SELECT lead_id, lrm_id, category, lrm_category_rank FROM ranked_row WHERE lrm_category_rank <= 20",
)
def topk_lrm_category(spark, sf_dir):
    return plan.ranked(flagged(spark, sf_dir), RULES).select("lead_id", "lrm_id", "category", "lrm_category_rank")


@register(
    "final_sort",
    """SELECT row_number() OVER (ORDER BY lrm_email NULLS LAST, category, lrm_category_rank, lead_id) AS place,
    lrm_email, category, lrm_category_rank, lead_id FROM queue_row""",
)
def final_sort(spark, sf_dir):
    """The queue in output order, with each row's place in it."""
    queue = crm.queue_snapshot(spark, sf_dir).select("lrm_email", "category", "lrm_category_rank", "lead_id")
    return plan.final_places(queue)


@register(
    "category_profile",
    """SELECT category, leak_code, count(*) AS n, round(avg(days_silent), 1) AS avg_silent,
    round(avg(days_overdue), 1) AS avg_overdue FROM queue_row GROUP BY ALL""",
)
def category_profile(spark, sf_dir):
    return quality.category_profile(plan.build_queue(crm.crm_tables(spark, sf_dir), CLOCK, sort=False))


@register("count_by_category", "SELECT category, count(*) AS n FROM flagged_row GROUP BY category")
def count_by_category(spark, sf_dir):
    return quality.count_by_category(flagged(spark, sf_dir))


@register("month_changeover", "SELECT category, count(*) AS n FROM flagged_row GROUP BY category", parts=three_days_later())
def month_changeover(spark, sf_dir):
    """The same data three days into the next month: closes are still audited from 1 January."""
    later = Clock(datetime(2024, 2, 3, 9, 30, tzinfo=timezone.utc))
    rows = plan.flagged_leads(crm.crm_tables(spark, sf_dir), later)
    return quality.count_by_category(rows)


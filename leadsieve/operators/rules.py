"""The audit rules as data: twelve dated rule sets over one set of named conditions.

A rule set says who is in scope, which facts to read, which arms to try in order, and how to
score. The arms are tried top to bottom and the first match wins. An arm with a `gate` is
final: a lead that matches it but fails the gate is dropped and tries no later arm.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, replace
from functools import reduce
from operator import and_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsieve.config import Clock
from leadsieve.functions.text import matches_any, null_to_blank
from leadsieve.functions.times import days_between, local_date

# ---- fixed values ----------------------------------------------------------------------
# Stages that never belong in the queue, compared trimmed and lower-cased.
BLOCKED_FIRST_26 = (
    "Meeting Done - Hot",
    "Meeting Done - Moderate",
    "Meeting Done - Customer Not Reachable",
    "Lost In Qualification",
    "Inactive Lead",
    "On-Hold",
    "Language Issue",
    "Qualification In Progress",
    "Qualification Remaining",
    "Followup Rescheduled",
    "Followup On Call",
    "Followup At Home",
    "Lead - Cold",
    "Lost to Competitor",
    "Expert Call Required",
    "Advance Received",
    "Booking Pending by Cx",
    "Booking Pending by ZSM",
    "Booking Rejected by Cx",
    "Booking Rejected by ZSM",
    "Pending Verification",
    "Verification Rejected",
    "Pending RM Call",
    "RM Rejected",
    "HOTO Initiated",
    "New Lead",
)
BLOCKED_AFTER_MEETING = (
    "Design Created",
    "DEV Confirmation",
    "DEV Scheduled",
    "DEV Postponed",
    "DEV Done",
    "Duplicate Opportunity",
)
BLOCKED_ORDER_SIDE = ("Meeting Confirmation", "Speed Order")
BLOCKED_MEETING_CLOSE = ("Meeting - Not Interested",)

LOOP_PATTERNS = (
    "%call later%",
    "%followup%",
    "%follow up%",
    "%call not connected%",
    "%future followup%",
    "%postponed%",
)
LOOP_PATTERNS_V4 = ("%call later%", "%follow%")
LOOP_STATUS_PATTERNS_V4 = ("%call later%", "%could not connect%", "%cnc%", "%follow%")

CATEGORIES = ("followup_missed", "mcch_future", "mcch_past", "not_interested", "not_qualified")
NEVER_CALLED = "1900-01-01"
# ----------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Thresholds:
    breach_window_days: int = 14
    close_quiet_days: int = 2
    loop_quiet_days: int = 3
    loop_turns_min: int = 3
    quiet_cap: int = 60
    turns_cap: int = 8

    @property
    def loop_quiet_max(self) -> int:
        return self.breach_window_days * 3


Condition = Callable[[Clock, Thresholds], Column]


@dataclass(frozen=True)
class Arm:
    """One rule: leads meeting every `when` condition get `category`, if `gate` allows."""

    name: str
    category: str
    when: tuple[Condition, ...]
    gate: tuple[Condition, ...] | None = None


@dataclass(frozen=True)
class RuleSet:
    name: str
    arms: tuple[Arm, ...]
    thresholds: Thresholds = Thresholds()
    # population
    max_age_months: int | None = 6
    touched_days: int = 45
    closed_statuses: tuple[str, ...] = ("Closed - Won", "Booked")
    closed_stages: tuple[str, ...] = ("Order Confirmed", "Booking Processing")
    blocked_stages: tuple[str, ...] = ()
    # facts
    stage_from_history: bool = True
    milestones_from_newest: bool = False
    follow_up: tuple[str, ...] = ("next_action", "crm_field")
    qualified_with_time: bool = False
    call_days: int = 30
    calls_since_assignment: bool = True
    loop_patterns: tuple[str, ...] = LOOP_PATTERNS
    loop_status_patterns: tuple[str, ...] = ()
    confirmed_is_prefix: bool = True
    ni_patterns: tuple[str, ...] = ("%not interested%",)
    nq_patterns: tuple[str, ...] = ("%not qualified%",)
    short_stage_codes: bool = False
    closes_from_status: bool = False
    # silence
    signals: tuple[str, ...] = ("last_stage_at", "last_call_at", "meeting_done_touch", "follow_up_at")
    signal_order: tuple[str, ...] = ("last_call_at", "meeting_done_touch", "follow_up_at")
    signal_rest: str = "stage_change"
    hours_need_activity: bool = False
    attempt_from_manual_dials: bool = False
    # scores
    uses_calls: bool = True
    moved_on_code: bool = False
    score: str = "weighted"
    overdue: str = "silence"
    rank_group: tuple[str, ...] = ("lrm_id", "category")
    rank_order: tuple[tuple[str, str], ...] = (
        ("rank_key", "desc_nulls_last"),
        ("quiet_days", "desc_nulls_last"),
        ("created_at", "desc_nulls_first"),
        ("lead_id", "asc"),
    )
    top: int | None = 20
    # output
    customer_named: bool = True
    written_cities: bool = True
    columns: tuple[str, ...] = ()
    renamed: tuple[tuple[str, str], ...] = ()

    @property
    def blocked(self) -> list[str]:
        return [s.lower() for s in self.blocked_stages]


# ---- conditions ------------------------------------------------------------------------


def flag(name: str) -> Condition:
    return lambda clock, t: F.col(name)


def unless(name: str) -> Condition:
    return lambda clock, t: ~F.col(name)


def stage_is(*stages: str) -> Condition:
    return lambda clock, t: F.col("stage_lc").isin(*stages)


def stage_has(text: str) -> Condition:
    return lambda clock, t: F.col("stage_lc").contains(text)


def owned(clock: Clock, t: Thresholds) -> Column:
    return F.col("lrm_id").isNotNull()


def created_before_today(clock: Clock, t: Thresholds) -> Column:
    return F.col("created_ist") < clock.today_col()


def close_quiet(clock: Clock, t: Thresholds) -> Column:
    return F.col("quiet_days") >= t.close_quiet_days


def loop_quiet(clock: Clock, t: Thresholds) -> Column:
    return F.col("quiet_days") >= t.loop_quiet_days


def loop_not_dead(clock: Clock, t: Thresholds) -> Column:
    return F.col("quiet_days") <= t.loop_quiet_max


def loop_turning(clock: Clock, t: Thresholds) -> Column:
    return (F.col("loop_turns") >= t.loop_turns_min) & (F.col("mcch_events") == 0)


def closed_in_month_window(*dates: str) -> Condition:
    return lambda clock, t: F.coalesce(*dates, "created_ist") >= clock.close_from_col()


def closed_in_breach_window(clock: Clock, t: Thresholds) -> Column:
    return F.coalesce("stage_ist", "created_ist") >= F.date_sub(clock.today_col(), t.breach_window_days)


def meeting_before_today(clock: Clock, t: Thresholds) -> Column:
    return F.col("msd_ist") < clock.today_col()


def meeting_after_today(clock: Clock, t: Thresholds) -> Column:
    return F.col("msd_ist") > clock.today_col()


def meeting_in_window(clock: Clock, t: Thresholds) -> Column:
    return F.col("msd_ist") >= F.date_sub(clock.today_col(), t.breach_window_days)


def nothing_since_meeting(clock: Clock, t: Thresholds) -> Column:
    return F.coalesce(local_date(F.col("last_activity_at")), "created_ist") <= F.col("msd_ist")


def no_meeting_done_date(clock: Clock, t: Thresholds) -> Column:
    return F.col("mdd_ist").isNull()


def done_date_before_meeting(clock: Clock, t: Thresholds) -> Column:
    return F.col("mdd_ist").isNull() | (F.col("mdd_ist") < F.col("msd_ist"))


def follow_up_due(clock: Clock, t: Thresholds) -> Column:
    return F.col("fu_ist") <= clock.today_col()


def follow_up_in_window(clock: Clock, t: Thresholds) -> Column:
    return F.col("fu_ist") >= F.date_sub(clock.today_col(), t.breach_window_days)


def not_called_since_due(clock: Clock, t: Thresholds) -> Column:
    last = F.coalesce(local_date(F.col("last_call_at")), F.lit(NEVER_CALLED).cast("date"))
    return last < F.col("fu_ist")


# ---- arms ------------------------------------------------------------------------------

MEETING_PAST = Arm(
    "meeting_past",
    "mcch_past",
    (meeting_before_today, meeting_in_window, unless("meeting_really_done"), nothing_since_meeting),
)
MEETING_AHEAD = Arm("meeting_ahead", "mcch_future", (meeting_after_today, unless("meeting_really_done")))
FOLLOW_UP = Arm(
    "follow_up",
    "followup_missed",
    (follow_up_due, follow_up_in_window, unless("attempt_today"), not_called_since_due),
)
LOOP = Arm("loop", "followup_missed", (loop_turning, loop_quiet, loop_not_dead))

ASSIGNED = Arm("assigned", "followup_missed", (stage_is("assigned"), created_before_today, loop_quiet))
BD_MEETING = Arm(
    "bd_meeting",
    "followup_missed",
    (stage_is("meeting scheduled (bd)"), owned, created_before_today, loop_quiet),
)
FUTURE_FOLLOW_UP = Arm("future_follow_up", "followup_missed", (stage_is("future followup required"), follow_up_due))
CALL_LATER = Arm("call_later", "followup_missed", (stage_has("call later"), follow_up_due))
DESIGN_NO_MEETING = Arm(
    "design_no_meeting",
    "followup_missed",
    (stage_is("dev scheduled", "design created"), flag("no_md_ever"), loop_quiet),
)
DEV_STALLED = Arm("dev_stalled", "followup_missed", (stage_is("dev postponed", "dev done"), loop_quiet, loop_not_dead))
SPEED_ORDER = Arm("speed_order", "followup_missed", (stage_is("speed order"), created_before_today, loop_quiet))


def final_closes(*gates: tuple[Condition, Condition]) -> tuple[Arm, Arm]:
    """The two closing arms that drop a lead failing its gate."""
    ni_gate, nq_gate = gates
    return (
        Arm("not_interested", "not_interested", (flag("is_ni"),), (ni_gate, close_quiet)),
        Arm("not_qualified", "not_qualified", (flag("is_nq"),), (nq_gate, close_quiet)),
    )


CLOSES_BY_OWN_DATE = final_closes(
    closed_in_month_window("ni_ist", "stage_ist"), closed_in_month_window("nq_ist", "stage_ist")
)
CLOSES_BY_STAGE_DATE = final_closes(closed_in_month_window("stage_ist"), closed_in_month_window("stage_ist"))
DATED_ARMS = (MEETING_PAST, MEETING_AHEAD, FOLLOW_UP, LOOP)

# ---- output columns --------------------------------------------------------------------

WHO = ("audit_date", "lrm_id", "lrm_name", "lrm_email", "lead_id", "customer_name", "cluster")
MILESTONE_COLUMNS = ("created_at", "meeting_confirmed_at", "meeting_schedule_date", "meeting_done_date")
COLUMNS_V2 = (
    *WHO,
    "lead_stage",
    "category",
    "priority_key",
    "lrm_category_rank",
    *MILESTONE_COLUMNS,
    "follow_up_at",
    "qualified_at",
    "status_changed_at",
    "attempt_today",
    "days_overdue",
)
COLUMNS_V3 = (
    *WHO,
    "lead_stage",
    "category",
    "leak_code",
    "priority_key",
    "lrm_category_rank",
    *MILESTONE_COLUMNS,
    "follow_up_at",
    "qualified_at",
    "status_changed_at",
    "attempt_today",
    "last_activity_at",
    "last_activity_type",
    "days_silent",
    "hours_silent",
    "calls_30d",
    "connects_30d",
    "days_overdue",
)
SILENCE_COLUMNS = ("last_activity_at", "last_activity_type", "days_silent", "hours_silent")
COUNT_COLUMNS = ("calls_30d", "connects_30d", "loop_turns", "mcch_events", "dev_events", "days_overdue")
SCORE_COLUMNS = ("category", "leak_code", "priority_key", "lrm_category_rank")
DATE_COLUMNS = ("qualified_at", "status_changed_at", "attempt_today")
COLUMNS_V4 = (
    *WHO,
    "lead_stage",
    "lead_status",
    *SCORE_COLUMNS,
    *MILESTONE_COLUMNS,
    "follow_up_at",
    *DATE_COLUMNS,
    *SILENCE_COLUMNS,
    "crm_touch_at",
    *COUNT_COLUMNS,
)
COLUMNS_V5 = tuple("crm_updated_at" if c == "crm_touch_at" else c for c in COLUMNS_V4)
STAGE_PAIR = (
    "lead_stage",
    "lead_status",
    "stage_changed_at_audit",
    "lead_table_stage",
    "lead_table_status",
    "stage_mismatch",
)
COLUMNS_V6 = (
    *WHO,
    *STAGE_PAIR,
    *SCORE_COLUMNS,
    *MILESTONE_COLUMNS,
    "follow_up_at",
    *DATE_COLUMNS,
    *SILENCE_COLUMNS,
    "crm_updated_at",
    *COUNT_COLUMNS,
)


def with_follow_up_columns(columns: tuple[str, ...], *extra: str) -> tuple[str, ...]:
    at = columns.index("follow_up_at") + 1
    return (*columns[:at], *extra, *columns[at:])


COLUMNS_V7 = with_follow_up_columns(COLUMNS_V6, "follow_up_datetime_raw")
COLUMNS_V7_8 = with_follow_up_columns(
    COLUMNS_V6, "follow_up_datetime_raw", "reschedule_date_raw", "reschedule_time_raw"
)
COLUMNS_V1 = tuple(c for c in COLUMNS_V2 if c not in ("priority_key", "lrm_category_rank")) + ("category_rank",)

# ---- rule sets -------------------------------------------------------------------------

V7_8 = RuleSet(
    name="v7.8",
    arms=(*CLOSES_BY_OWN_DATE, ASSIGNED, BD_MEETING, FUTURE_FOLLOW_UP, CALL_LATER, *DATED_ARMS),
    blocked_stages=(*BLOCKED_FIRST_26, *BLOCKED_AFTER_MEETING, *BLOCKED_ORDER_SIDE, *BLOCKED_MEETING_CLOSE),
    follow_up=("promise", "next_action", "crm_field"),
    ni_patterns=("lead%not interested%",),
    columns=COLUMNS_V7_8,
)
V7_7 = replace(
    V7_8,
    name="v7.7",
    arms=(*CLOSES_BY_OWN_DATE, ASSIGNED, BD_MEETING, FUTURE_FOLLOW_UP, *DATED_ARMS),
    follow_up=("next_action", "crm_field"),
    columns=COLUMNS_V7,
)
V7_6 = replace(
    V7_7,
    name="v7.6",
    blocked_stages=(*BLOCKED_FIRST_26, *BLOCKED_AFTER_MEETING, *BLOCKED_ORDER_SIDE),
    ni_patterns=("%not interested%",),
)
V7_5 = replace(
    V7_6,
    name="v7.5",
    arms=(*CLOSES_BY_OWN_DATE, SPEED_ORDER, ASSIGNED, BD_MEETING, FUTURE_FOLLOW_UP, *DATED_ARMS),
    blocked_stages=(*BLOCKED_FIRST_26, *BLOCKED_AFTER_MEETING),
)
STAGE_ARMS_V7 = (DESIGN_NO_MEETING, DEV_STALLED, SPEED_ORDER, ASSIGNED, BD_MEETING, FUTURE_FOLLOW_UP)
V7_4 = replace(
    V7_5,
    name="v7.4",
    arms=(*CLOSES_BY_OWN_DATE, *STAGE_ARMS_V7, *DATED_ARMS),
    blocked_stages=BLOCKED_FIRST_26,
    moved_on_code=True,
)
V7 = replace(V7_4, name="v7", arms=(*CLOSES_BY_STAGE_DATE, *STAGE_ARMS_V7, *DATED_ARMS))
V6 = replace(
    V7,
    name="v6",
    arms=(*final_closes(closed_in_breach_window, closed_in_breach_window), *DATED_ARMS),
    max_age_months=None,
    closed_stages=("Order Confirmed", "Booking Processing", "Speed Order"),
    blocked_stages=(),
    follow_up=("crm_field",),
    qualified_with_time=True,
    confirmed_is_prefix=False,
    nq_patterns=("%not qualified%", "%lost in qualification%"),
    moved_on_code=False,
    columns=COLUMNS_V6,
)
V5 = replace(
    V6,
    name="v5",
    arms=(
        Arm("not_interested", "not_interested", (flag("is_ni"), closed_in_breach_window, close_quiet)),
        Arm("not_qualified", "not_qualified", (flag("is_nq"), closed_in_breach_window, close_quiet)),
        *DATED_ARMS,
    ),
    stage_from_history=False,
    columns=COLUMNS_V5,
)
V4 = replace(
    V5,
    name="v4",
    arms=(
        replace(MEETING_PAST, when=(meeting_before_today, unless("meeting_really_done"), nothing_since_meeting)),
        MEETING_AHEAD,
        Arm("not_interested", "not_interested", (flag("is_ni"), close_quiet)),
        Arm("not_qualified", "not_qualified", (flag("is_nq"), close_quiet)),
        replace(FOLLOW_UP, when=(follow_up_due, unless("attempt_today"), not_called_since_due)),
        replace(LOOP, when=(loop_turning, loop_quiet)),
    ),
    closed_statuses=(),
    closed_stages=(),
    loop_patterns=LOOP_PATTERNS_V4,
    loop_status_patterns=LOOP_STATUS_PATTERNS_V4,
    nq_patterns=("%not qualified%",),
    short_stage_codes=True,
    closes_from_status=True,
    signal_order=("last_call_at", "last_stage_at", "meeting_done_touch", "follow_up_at"),
    hours_need_activity=True,
    score="weighted_with_age",
    columns=COLUMNS_V4,
)
EARLY_MEETINGS = (
    Arm("meeting_past", "mcch_past", (meeting_before_today, done_date_before_meeting)),
    Arm("meeting_ahead", "mcch_future", (meeting_after_today, no_meeting_done_date)),
)
EARLY_CLOSES = (
    Arm("not_interested", "not_interested", (flag("is_ni"),)),
    Arm("not_qualified", "not_qualified", (flag("is_nq"),)),
)
V3 = replace(
    V4,
    name="v3",
    arms=(
        replace(EARLY_MEETINGS[0], when=(*EARLY_MEETINGS[0].when, nothing_since_meeting)),
        EARLY_MEETINGS[1],
        *EARLY_CLOSES,
        replace(FOLLOW_UP, when=(follow_up_due, unless("attempt_today"), not_called_since_due)),
    ),
    milestones_from_newest=True,
    call_days=45,
    calls_since_assignment=False,
    closes_from_status=False,
    ni_patterns=(),
    nq_patterns=(),
    loop_status_patterns=(),
    signals=("last_stage_at", "last_call_at", "meeting_done_touch", "follow_up_at", "crm_updated_at"),
    signal_order=("last_call_at", "last_stage_at", "meeting_done_touch", "follow_up_at"),
    signal_rest="crm_touch",
    score="weighted_no_turns",
    customer_named=False,
    written_cities=False,
    columns=COLUMNS_V3,
)
V2 = replace(
    V3,
    name="v2",
    arms=(
        *EARLY_MEETINGS,
        *EARLY_CLOSES,
        replace(FOLLOW_UP, when=(follow_up_due, unless("attempt_today"))),
    ),
    touched_days=30,
    uses_calls=False,
    score="days",
    overdue="age",
    rank_order=(("rank_key", "desc_nulls_last"), ("created_at", "desc_nulls_first"), ("lead_id", "asc")),
    columns=COLUMNS_V2,
)
V1 = replace(
    V2,
    name="v1",
    attempt_from_manual_dials=True,
    score="overdue",
    overdue="status_change",
    rank_group=("category",),
    rank_order=(("rank_key", "desc_nulls_last"), ("created_at", "desc_nulls_first"), ("lead_id", "asc")),
    top=None,
    customer_named=True,
    columns=COLUMNS_V1,
    renamed=(("lrm_id", "rep_id"), ("lrm_name", "rep_name"), ("lrm_email", "rep_email")),
)

RULE_SETS = {r.name: r for r in (V1, V2, V3, V4, V5, V6, V7, V7_4, V7_5, V7_6, V7_7, V7_8)}
CURRENT = V7_8


# ---- evaluation ------------------------------------------------------------------------


def is_not_interested(rules: RuleSet) -> Column:
    return _closed(rules, rules.ni_patterns, "NI")


def is_not_qualified(rules: RuleSet) -> Column:
    return _closed(rules, rules.nq_patterns, "NQ")


def _closed(rules: RuleSet, patterns: tuple[str, ...], code: str) -> Column:
    source = F.col("current_status") if rules.closes_from_status else F.col("current_stage")
    hit = matches_any(source, patterns)
    if rules.short_stage_codes:
        hit = hit | (null_to_blank(F.col("current_stage")) == code)
    return hit


def meeting_really_done(rules: RuleSet) -> Column:
    by_date = F.coalesce(F.col("mdd_ist") >= F.col("msd_ist"), F.lit(False))
    if rules.closes_from_status:
        return by_date
    return null_to_blank(F.col("current_stage")).ilike("meeting done%") | by_date


def no_meeting_ever() -> Column:
    return (F.col("md_events") == 0) & F.col("meeting_done_touch").isNull()


def category(rules: RuleSet, clock: Clock) -> Column:
    def all_of(conditions: tuple[Condition, ...]) -> Column:
        return reduce(and_, [c(clock, rules.thresholds) for c in conditions])

    chain = F
    for arm in rules.arms:
        outcome = F.lit(arm.category)
        if arm.gate is not None:
            outcome = F.when(all_of(arm.gate), outcome)
        chain = chain.when(all_of(arm.when), outcome)
    return chain


def is_close() -> Column:
    return F.col("category").isin("not_interested", "not_qualified")


def leak_code(rules: RuleSet) -> Column:
    missed = F.col("category") == "followup_missed"
    chain = F.when(F.col("category") == "mcch_past", "L1")
    if rules.moved_on_code:
        moved_on = F.col("stage_lc").isin("dev confirmation", "dev scheduled", "design created")
        chain = chain.when(missed & F.col("no_md_ever") & moved_on, "L5")
    return (
        chain.when(missed & (F.col("calls_30d") < 2), "L2")
        .when(missed, "L3")
        .when(is_close() & (F.col("connects_30d") == 0), "L4")
        .when(is_close(), "L4b")
        .otherwise("L0")
    )


def _by_category(past: Column, ahead: Column, missed: Column, closed: Column) -> Column:
    kind = F.col("category")
    return (
        F.when(kind == "mcch_past", past)
        .when(kind == "mcch_future", ahead)
        .when(kind == "followup_missed", missed)
        .otherwise(closed)
    )


def rank_key(rules: RuleSet, clock: Clock) -> Column:
    """Priority inside a category; larger is more urgent."""
    t = rules.thresholds
    past = days_between(clock.today_col(), F.col("msd_ist"))
    ahead = days_between(F.col("msd_ist"), clock.today_col())
    due = days_between(clock.today_col(), F.col("fu_ist"))
    age = days_between(clock.today_col(), F.col("created_ist"))
    if rules.score == "overdue":
        return _by_category(past, F.lit(0), due, F.lit(0)).cast("bigint")
    if rules.score == "days":
        return _by_category(past, ahead, due, age)
    quiet = F.least(F.col("quiet_days"), F.lit(t.quiet_cap))
    turns = F.least(F.col("loop_turns"), F.lit(t.turns_cap)) * 5
    missed = F.coalesce(due, F.lit(0)) * 10 + quiet
    closed = quiet * 10
    if rules.score != "weighted":
        closed = closed + age
    if rules.score != "weighted_no_turns":
        missed = missed + turns
    return _by_category(past * 10 + quiet, ahead * 10, missed, closed).cast("bigint")


def overdue_days(rules: RuleSet, clock: Clock) -> Column:
    past = days_between(clock.today_col(), F.col("msd_ist"))
    due = days_between(clock.today_col(), F.col("fu_ist"))
    closed = {
        "silence": F.col("quiet_days"),
        "age": days_between(clock.today_col(), F.col("created_ist")),
        "status_change": days_between(clock.today_col(), local_date(F.col("status_changed_at"))),
    }[rules.overdue]
    if rules.overdue == "silence":
        due = F.coalesce(due, "quiet_days")
    return _by_category(past, F.lit(0), due, closed).cast("bigint")

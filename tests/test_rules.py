"""Hand-written leads, one per story told by the rules."""

from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import CLOCK, at, make_tables

from leadsieve.config import Clock, shift_months
from leadsieve.operators import rules as r
from leadsieve.plans import queue as plan


def flagged(spark, clock=CLOCK, rules=r.CURRENT, **tables):
    return [row.asDict() for row in plan.flagged_leads(make_tables(spark, **tables), clock, rules).collect()]


def states(spark, clock=CLOCK, **tables):
    return [row.asDict() for row in plan.audited_facts(make_tables(spark, **tables), clock).collect()]


def test_stale_close_is_dropped_not_passed_on(spark):
    events = [
        {"stage": "Lead - Not Interested", "created_at": at("2026-06-20"), "meeting_schedule_date": at("2026-08-06")}
    ]
    assert flagged(spark, leads=[{"created_at": at("2026-06-01")}], events=events) == []


def test_close_is_dated_by_its_own_event(spark):
    events = [
        {"stage": "Lead - Not Qualified", "created_at": at("2026-05-30")},
        {"stage": " ", "created_at": at("2026-07-25")},
    ]
    lead = {"created_at": at("2026-05-01"), "stage": "Lead - Not Qualified"}
    assert flagged(spark, leads=[lead], events=events) == []
    # v7 still dated it by the newest row of any kind
    assert [x["category"] for x in flagged(spark, rules=r.V7, leads=[lead], events=events)] == ["not_qualified"]


def test_meeting_not_interested_is_blocked(spark):
    events = [{"stage": "Meeting - Not Interested", "created_at": at("2026-07-28")}]
    assert states(spark, leads=[{}], events=events) == []


def test_meeting_not_qualified_is_a_close(spark):
    events = [{"stage": "Meeting - Not Qualified", "created_at": at("2026-07-28")}]
    (row,) = flagged(spark, leads=[{}], events=events)
    assert (row["category"], row["leak_code"], row["quiet_days"], row["rank_key"]) == ("not_qualified", "L4", 6, 60)


PROMISE = {
    "created_at": at("2026-07-01"),
    "reschedule_date": at("2026-11-04 18:30"),
    "lrm_queue_entry_next_action_at": at("2026-07-05 09:00"),
}


@pytest.mark.parametrize(
    ("time", "expected"),
    [
        ("09:30 AM", "2026-11-05 04:00"),
        ("9:30pm", "2026-11-05 16:00"),
        ("12:00 AM", "2026-11-04 18:30"),
        ("12:15 PM", "2026-11-05 06:45"),
        ("soon", "2026-11-05 03:30"),
        (None, "2026-11-05 03:30"),
        ("13:00 PM", "2026-11-05 03:30"),
        ("0:30 AM", "2026-11-05 03:30"),
    ],
)
def test_promise_is_local_day_and_time(spark, time, expected):
    events = [{"stage": "Future Followup Required", "created_at": at("2026-07-05")}]
    lead = {**PROMISE, "reschedule_time": time}
    (row,) = states(spark, leads=[lead], events=events)
    assert row["follow_up_at"] == at(expected).replace(tzinfo=None)
    assert flagged(spark, leads=[lead], events=events) == []


def test_next_action_came_first_before(spark):
    events = [{"stage": "Future Followup Required", "created_at": at("2026-07-05")}]
    lead = {**PROMISE, "reschedule_time": "09:30 AM"}
    (row,) = flagged(spark, rules=r.V7_7, leads=[lead], events=events)
    assert row["follow_up_at"] == at("2026-07-05 09:00").replace(tzinfo=None)


def test_held_meeting_is_not_missed(spark):
    events = [
        {"stage": "Meeting Done - Cold", "created_at": at("2026-07-29"), "meeting_schedule_date": at("2026-07-30")}
    ]
    assert flagged(spark, leads=[{}], events=events) == []


@pytest.mark.parametrize(
    ("meeting", "expected"),
    [
        ("2026-07-30", ("mcch_past", "L1", 45, 4)),
        ("2026-08-03", None),
        ("2026-08-06", ("mcch_future", "L0", 30, 0)),
    ],
)
def test_meeting_dates(spark, meeting, expected):
    events = [{"stage": "Meeting Rescheduled", "created_at": at("2026-07-29"), "meeting_schedule_date": at(meeting)}]
    got = [
        (x["category"], x["leak_code"], x["rank_key"], x["overdue_days"])
        for x in flagged(spark, leads=[{}], events=events)
    ]
    assert got == ([expected] if expected else [])


@pytest.mark.parametrize(
    ("dials", "expected"),
    [
        (["2026-08-01T05:00:00Z"], None),
        (["2026-07-31T05:00:00Z"], ("followup_missed", "L2", 27)),
        (["2026-07-30T05:00:00Z", "2026-07-31T05:00:00Z"], ("followup_missed", "L3", 27)),
    ],
)
def test_follow_up_and_dials(spark, dials, expected):
    lead = {"follow_up_datetime": at("2026-08-01")}
    events = [{"stage": "Call Not Connected", "created_at": at("2026-07-20")}]
    got = [
        (x["category"], x["leak_code"], x["rank_key"])
        for x in flagged(spark, leads=[lead], events=events, calls=[{"created_at": d} for d in dials])
    ]
    assert got == ([expected] if expected else [])


def test_deleted_and_old_leads_are_out(spark):
    edge = shift_months(CLOCK.as_of, -6)
    leads = [
        {"lead_id": "null", "is_delete": None},
        {"lead_id": "zero", "is_delete": 0},
        {"lead_id": "gone", "is_delete": 1},
        {"lead_id": "customer gone", "customer_is_delete": 1},
        {"lead_id": "edge", "created_at": edge},
        {"lead_id": "past edge", "created_at": edge - timedelta(microseconds=1)},
        {"lead_id": "untouched", "updated_at": CLOCK.days_ago(45) - timedelta(microseconds=1)},
        {"lead_id": "won", "status": "Closed - Won"},
        {"lead_id": "no status", "status": None},
        {"lead_id": "ordered", "stage": "Order Confirmed"},
        {"lead_id": "ordered, other case", "stage": "order confirmed"},
    ]
    kept = {row.lead_id for row in plan.scoped_leads(make_tables(spark, leads=leads), CLOCK).collect()}
    assert kept == {"null", "zero", "edge", "no status", "ordered, other case"}


def test_call_later_has_no_lower_bound_and_reads_the_newest_stage(spark):
    lead = {"stage": "Assigned", "follow_up_datetime": at("2026-03-01")}
    (row,) = flagged(spark, leads=[lead], events=[{"stage": "Call Later", "created_at": at("2026-07-20")}])
    assert (row["current_stage"], row["stage_mismatch"], row["category"]) == ("Call Later", True, "followup_missed")


def test_blank_newest_stage_falls_back_to_the_lead_not_to_older_events(spark):
    events = [
        {"stage": "Call Later", "created_at": at("2026-07-20")},
        {"stage": "  ", "created_at": at("2026-07-21")},
    ]
    (row,) = states(spark, leads=[{"stage": " Assigned"}], events=events)
    assert (row["current_stage"], row["stage_mismatch"]) == (" Assigned", False)


def test_close_window_at_the_month_change():
    assert Clock(at("2026-08-07 09:30")).close_from.isoformat() == "2026-07-01"
    assert Clock(at("2026-08-08 09:30")).close_from.isoformat() == "2026-08-01"
    assert Clock(at("2026-01-03 09:30")).close_from.isoformat() == "2025-12-01"
    # late evening UTC is already the next local day
    assert Clock(at("2026-08-07 18:30")).close_from.isoformat() == "2026-08-01"


def test_future_promise_makes_silence_negative(spark):
    lead = {"stage": "Assigned", "follow_up_datetime": at("2026-08-10")}
    (row,) = states(spark, leads=[lead])
    assert (row["quiet_days"], row["last_activity_type"]) == (-7, "followup_set")
    assert row["hours_silent"] < 0
    assert flagged(spark, leads=[lead]) == []


def test_loop_needs_turns_and_a_live_silence(spark):
    turns = [{"stage": "Call Not Connected", "created_at": at(d)} for d in ("2026-07-11", "2026-07-12", "2026-07-20")]
    (row,) = flagged(spark, leads=[{}], events=turns)
    assert (row["category"], row["loop_turns"], row["rank_key"]) == ("followup_missed", 3, 14 + 15)
    confirmed = [*turns, {"stage": "Meeting Confirmed - Over Phone", "created_at": at("2026-07-13")}]
    assert flagged(spark, leads=[{}], events=confirmed) == []
    assert flagged(spark, leads=[{}], events=turns[:2]) == []


def test_superseded_stage_arms(spark):
    events = [{"stage": "DEV Scheduled", "created_at": at("2026-07-20")}]
    (row,) = flagged(spark, rules=r.V7_4, leads=[{}], events=events)
    assert (row["category"], row["leak_code"]) == ("followup_missed", "L5")
    assert flagged(spark, rules=r.V7_5, leads=[{}], events=events) == []
    speed = [{"stage": "Speed Order", "created_at": at("2026-07-20")}]
    assert len(flagged(spark, rules=r.V7_5, leads=[{}], events=speed)) == 1
    assert flagged(spark, rules=r.V7_6, leads=[{}], events=speed) == []


def test_blocklist_sizes():
    sizes = {name: len(rules.blocked_stages) for name, rules in r.RULE_SETS.items() if rules.blocked_stages}
    assert sizes == {"v7": 26, "v7.4": 26, "v7.5": 32, "v7.6": 34, "v7.7": 35, "v7.8": 35}
    assert len(r.V7_8.columns) == 39
    assert {len(r.RULE_SETS[v].columns) for v in ("v7", "v7.4", "v7.5", "v7.6", "v7.7")} == {37}

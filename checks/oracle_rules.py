"""The superseded rule sets as `Plain` records, each told by what it did otherwise than its successor."""

from __future__ import annotations

from dataclasses import replace

from checks.oracle_crm import (
    AHEAD,
    AS_OF,
    BD,
    DUE,
    FUTURE,
    LOOPING,
    LOOPS,
    MEETINGS,
    MISSED,
    NI,
    NQ,
    OWN_DAY_CLOSES,
    PARTS,
    PAST,
    PICKED_UP,
    QUIET_SCORE,
    SINCE_14,
    SINCE_CLOSE,
    STALE,
    TODAY,
    UNCALLED,
    UNSEEN,
    ISO_TIME,
    Plain,
    any_like,
    audit_parts,
    blocked_until,
    claim,
    closes,
    day,
    days_since,
    phone,
)

SPEED = claim(MISSED, f"stage_lc = 'speed order' AND {STALE}")
DESIGN = claim(MISSED, "stage_lc IN ('dev scheduled', 'design created') AND no_md_ever AND quiet >= 3")
DEV = claim(MISSED, "stage_lc IN ('dev postponed', 'dev done') AND quiet BETWEEN 3 AND 42")
ENDING = (*MEETINGS, DUE, LOOPS)


def other(pairs: tuple[tuple[str, str], ...], **changed: str) -> tuple[tuple[str, str], ...]:
    return tuple((c, changed.get(c, v)) for c, v in pairs)


V7_8 = Plain()
V7_7 = replace(
    V7_8, arms=(*OWN_DAY_CLOSES, PICKED_UP, BD, FUTURE, *ENDING), follow_up="coalesce(lrm_queue_entry_next_action_at, follow_up_datetime)"
)
V7_6 = replace(V7_7, blocked=blocked_until("speed order"), ni="%not interested%")
V7_5 = replace(V7_6, blocked=blocked_until("duplicate opportunity"), arms=(*OWN_DAY_CLOSES, SPEED, PICKED_UP, BD, FUTURE, *ENDING))
UNMET = "no_md_ever AND stage_lc IN ('dev confirmation', 'dev scheduled', 'design created')"
V7_4 = replace(
    V7_5,
    blocked=blocked_until("new lead"),
    arms=(*OWN_DAY_CLOSES, DESIGN, DEV, SPEED, PICKED_UP, BD, FUTURE, *ENDING),
    leak=other(V7_8.leak, followup_missed=f"CASE WHEN {UNMET} THEN 'L5' WHEN calls_30d < 2 THEN 'L2' ELSE 'L3' END"),
)
V7 = replace(V7_4, arms=(*closes("", "", SINCE_CLOSE), DESIGN, DEV, SPEED, PICKED_UP, BD, FUTURE, *ENDING))
V6 = replace(
    V7,
    scope=(
        f"updated_at >= {AS_OF} - INTERVAL 45 DAY",
        "coalesce(status, '') NOT IN ('Closed - Won', 'Booked')",
        "coalesce(stage, '') NOT IN ('Order Confirmed', 'Booking Processing', 'Speed Order')",
    ),
    blocked=(),
    confirmed="stage = 'Meeting Confirmed - Customer Home'",
    follow_up="follow_up_datetime",
    qualified=ISO_TIME,
    is_nq=any_like("coalesce(current_stage, '')", "%not qualified%", "%lost in qualification%"),
    arms=(*closes("", "", SINCE_14), *ENDING),
    leak=V7_8.leak,
)
FRESH_CLOSE = f"coalesce(stage_day, created_day) {SINCE_14} AND quiet >= 2"
V5 = replace(
    V6,
    newest_stage=False,
    arms=(claim(NI, f"is_ni AND {FRESH_CLOSE}"), claim(NQ, f"is_nq AND {FRESH_CLOSE}"), *ENDING),
)
ANY_DUE = claim(MISSED, f"due_day <= {TODAY} AND {UNCALLED}")
AGED = f"{QUIET_SCORE} * 10 + {days_since('created_day')}"
V4 = replace(
    V5,
    scope=(f"updated_at >= {AS_OF} - INTERVAL 45 DAY",),
    turn=any_like("stage", "%call later%", "%follow%") + " OR " + any_like("status", "%call later%", "%could not connect%", "%cnc%", "%follow%"),
    signals=(("last_call_at", "call"), ("last_stage_at", "stage_change"), ("met_at", "meeting_done"), ("follow_up_at", "followup_set")),
    silent_from="last_activity_at",
    met="coalesce(done_day >= meeting_day, false)",
    is_ni="coalesce(current_stage = 'NI', false) OR coalesce(status, '') ILIKE '%not interested%'",
    is_nq="coalesce(current_stage = 'NQ', false) OR coalesce(status, '') ILIKE '%not qualified%'",
    arms=(
        claim(PAST, f"meeting_day < {TODAY} AND {UNSEEN}"),
        MEETINGS[1],
        claim(NI, "is_ni AND quiet >= 2"),
        claim(NQ, "is_nq AND quiet >= 2"),
        ANY_DUE,
        claim(MISSED, f"{LOOPING} AND quiet >= 3"),
    ),
    score=other(V7_8.score, not_interested=AGED, not_qualified=AGED),
)
BY_NAME = (claim(NI, "current_stage = 'NI'"), claim(NQ, "current_stage = 'NQ'"))
UNDONE = f"meeting_day < {TODAY} AND coalesce(done_day < meeting_day, true)"
STILL_AHEAD = claim(AHEAD, f"meeting_day > {TODAY} AND done_day IS NULL")
V3 = replace(
    V4,
    milestones="newest",
    since_assigned=False,
    signals=(*V4.signals, ("updated_at", "crm_touch")),
    arms=(claim(PAST, f"{UNDONE} AND activity_day <= meeting_day"), STILL_AHEAD, *BY_NAME, ANY_DUE),
    score=other(V4.score, followup_missed=f"coalesce({days_since('due_day')}, 0) * 10 + {QUIET_SCORE}"),
    place="geo_cluster, geo_city",
    named=False,
)
AGE, MET_AGO, DUE_AGO = days_since("created_day"), days_since("meeting_day"), days_since("due_day")
V2 = replace(
    V3,
    scope=(f"updated_at >= {AS_OF} - INTERVAL 30 DAY",),
    arms=(claim(PAST, UNDONE), STILL_AHEAD, *BY_NAME, claim(MISSED, f"due_day <= {TODAY} AND NOT attempt_today")),
    leak=(),
    score=((PAST, MET_AGO), (MISSED, DUE_AGO), (AHEAD, f"-{MET_AGO}"), (NI, AGE), (NQ, AGE)),
    late=((PAST, MET_AGO), (MISSED, DUE_AGO), (AHEAD, "0"), (NI, AGE), (NQ, AGE)),
    rank_by="PARTITION BY lrm_id, category ORDER BY rank_key DESC, created_at DESC, lead_id",
)
BY_HAND = f"""ph10 IN (SELECT {phone('call_to')} FROM crm_call
    WHERE call_type = 'Manual' AND {day('try_cast(created_at AS TIMESTAMP)')} = {TODAY} AND {phone('call_to')} <> '')"""
CLOSED_AGO = days_since(day("order_closure_datetime"))
V1 = replace(
    V2,
    attempt=BY_HAND,
    score=((PAST, MET_AGO), (MISSED, DUE_AGO), (AHEAD, "0"), (NI, "0"), (NQ, "0")),
    late=((PAST, MET_AGO), (MISSED, DUE_AGO), (AHEAD, "0"), (NI, CLOSED_AGO), (NQ, CLOSED_AGO)),
    rank_by="PARTITION BY category ORDER BY rank_key DESC, created_at DESC, lead_id",
    top=None,
    named=True,
)

PLAIN = {
    "v7.8": V7_8, "v7.7": V7_7, "v7.6": V7_6, "v7.5": V7_5, "v7.4": V7_4, "v7": V7,
    "v6": V6, "v5": V5, "v4": V4, "v3": V3, "v2": V2, "v1": V1,
}
VARIANTS: dict[str, dict[str, str]] = {name: {**PARTS, **audit_parts(p)} for name, p in PLAIN.items()}

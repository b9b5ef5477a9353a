"""Dial totals against the plain join of every lead with every dial."""

from __future__ import annotations

import random
from datetime import timedelta

from conftest import CLOCK, at, make_tables
from pyspark.sql import functions as F

from leadsieve.operators import calls
from leadsieve.plans import queue as plan


def test_connects_read_the_digits(spark):
    durations = ["00:00:14", "00:01:00", "1.5", "abc", None, "9" * 30]
    df = spark.createDataFrame([(d,) for d in durations], "response_call_duration STRING")
    assert [x.ok for x in df.select(calls.connected().alias("ok")).collect()] == [False, True, True, False, False, False]


def test_shared_phone_counts_for_both(spark):
    leads = [{"lead_id": "A"}, {"lead_id": "B", "customer_phone_number": "+91 98000-00001"}]
    dials = [{"created_at": f"2026-07-2{i}T10:00:00Z"} for i in range(3)]
    tables = make_tables(spark, leads=leads, calls=dials)
    got = {x.lead_id: x.calls_30d for x in calls.call_stats(tables.lead, tables.call_log, CLOCK).collect()}
    assert got == {"A": 3, "B": 3}


def test_short_and_missing_numbers_match_nothing(spark):
    leads = [{"lead_id": "A", "customer_phone_number": "12345"}, {"lead_id": "B", "customer_phone_number": None}]
    dials = [{"call_to": "12345", "created_at": "2026-07-20T10:00:00Z"}, {"call_to": None, "created_at": "2026-07-20"}]
    tables = make_tables(spark, leads=leads, calls=dials)
    assert calls.call_stats(tables.lead, tables.call_log, CLOCK).collect() == []


def pair_counts(leads, dials):
    out = {}
    for lead in leads:
        since = lead["lrm_assigned_at"]
        start = at(since[:19].replace("T", " ")) if since and since[4:5] == "-" and "T" in since else None
        hits = [
            (t, d["response_call_duration"])
            for d in dials
            if d["call_to"][-10:] == lead["customer_phone_number"][-10:]
            and (t := d["_at"]) is not None
            and d["created_at"] >= "2026-07-04"
            and (start is None or t >= start)
        ]
        if hits:
            connects = sum(int("".join(c for c in x if c.isdigit()) or 0) >= 15 for _, x in hits)
            out[lead["lead_id"]] = (max(t for t, _ in hits).replace(tzinfo=None), len(hits), connects)
    return out


def test_totals_equal_every_pair(spark):
    """A third of leads and dials on one phone; same-second ties, same-hour starts, junk times."""
    rng = random.Random(7)

    def moment():
        return CLOCK.as_of - timedelta(seconds=rng.choice([rng.randrange(40 * 86400), rng.randrange(7200)]))

    def phone():
        return "9800000000" if rng.random() < 0.35 else f"98000000{rng.randrange(1, 12):02d}"

    dials = []
    for i in range(600):
        t = moment() if i % 5 else dials[-1]["_at"] if dials and dials[-1]["_at"] else moment()
        text = t.strftime("%Y-%m-%dT%H:%M:%SZ")
        if i % 41 == 0:
            t, text = None, "2026-13-45T00:00:00Z"
        dials.append(
            {"call_to": "0" + phone(), "created_at": text, "_at": t, "response_call_duration": f"00:00:{rng.randrange(60):02d}"}
        )
    known = [d["created_at"] for d in dials if d["_at"]]
    leads = [
        {
            "lead_id": f"L{i}",
            "customer_phone_number": "+91" + phone(),
            # some start exactly at a dial
            "lrm_assigned_at": rng.choice(
                [None, "n/a", rng.choice(known), moment().strftime("%Y-%m-%dT%H:%M:%SZ"), "2020-01-01T00:00:00Z"]
            ),
        }
        for i in range(300)
    ]
    tables = make_tables(spark, leads=leads, calls=[{k: v for k, v in d.items() if k != "_at"} for d in dials])
    got = {
        x.lead_id: (x.last_call_at, x.calls_30d, x.connects_30d)
        for x in calls.call_stats(tables.lead, tables.call_log, CLOCK).collect()
    }
    assert got == pair_counts(leads, dials)


def test_no_pair_is_built(spark):
    """Every join in the plan is an equality join; none sits below the totals."""
    tables = make_tables(spark, leads=[{}], calls=[{"created_at": "2026-07-20T10:00:00Z"}])
    text = calls.call_stats(tables.lead, tables.call_log, CLOCK)._jdf.queryExecution().toString()
    assert "NestedLoop" not in text and "Cartesian" not in text


def test_manual_dials_of_the_local_day(spark):
    rows = [
        {"created_at": "2026-08-02T18:29:59Z", "call_type": "Manual"},  # still 2 August locally
        {"call_to": "09800000002", "created_at": "2026-08-02T18:30:00Z", "call_type": "Manual"},
        {"call_to": "09800000003", "created_at": "2026-08-03T05:00:00Z", "call_type": "IVR"},
    ]
    leads = [{"lead_id": f"L{i}", "customer_phone_number": f"980000000{i}"} for i in (1, 2, 3)]
    tables = make_tables(spark, leads=leads, calls=rows)
    assert [x.lead_id for x in calls.manual_dials_today(tables.lead, tables.call_log, CLOCK).collect()] == ["L2"]


def test_optional_dial_filter(spark):
    rows = [{"created_at": "2026-07-20T10:00:00Z", "call_type": t} for t in ("Manual", "IVR", "Manual")]
    tables = make_tables(spark, leads=[{}], calls=rows)
    (row,) = plan.audited_facts(tables, CLOCK, keep_dials=F.col("call_type") == "Manual").collect()
    assert row.calls_30d == 2

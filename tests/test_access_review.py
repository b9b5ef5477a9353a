"""Roles, visibility, the review log and recordings."""

from __future__ import annotations

import pytest
from conftest import CLOCK, at

from leadsieve.operators import access, quality, recordings, review
from leadsieve.sources.schemas import RCA_COLUMNS

CHART = [
    # lrm, tl, zsm, ados
    ("l1@example.com", "t1@example.com", "z1@example.com", "d@example.com"),
    ("l2@example.com", "t2@example.com", "z1@example.com", "d@example.com"),
    ("l3@example.com", "t3@example.com", "z2@example.com", ""),
]


@pytest.fixture(scope="module")
def chart(spark):
    return spark.createDataFrame(CHART, "lrm_email STRING, tl_email STRING, zsm_email STRING, ados_email STRING")


def overrides(spark, *rows):
    data = [(i, e, r, "", "", "", "") for i, (e, r) in enumerate(rows)]
    df = spark.createDataFrame(
        data, "seq BIGINT, email STRING, role STRING, scope STRING, note STRING, updated_by STRING, updated_at STRING"
    )
    return access.access_latest(df)


def seen(spark, chart, people, given=(), admins=()):
    viewers = spark.createDataFrame([(p,) for p in people], "viewer_email STRING")
    given = overrides(spark, *given) if given else overrides(spark, ("nobody@example.com", "tl"))
    roles = access.resolve_roles(viewers, chart, given, admins)
    out = {x.viewer_email: (x.role, x.see_all) for x in access.visibility(roles, chart).collect()}
    teams = {}
    for x in access.team_grants(roles, chart).collect():
        teams.setdefault(x.viewer_email, set()).add(x.tl_email)
    return out, teams


def test_chart_roles(spark, chart):
    people = ["T1@homes.example.com", "z1@example.com", "d@example.com", "l1@example.com"]
    out, teams = seen(spark, chart, people)
    assert out == {
        "t1@example.com": ("tl", False),
        "z1@example.com": ("zsm", False),
        "d@example.com": ("ados", False),
        "l1@example.com": ("none", False),
    }
    both = {"t1@example.com", "t2@example.com"}
    assert teams == {"t1@example.com": {"t1@example.com"}, "z1@example.com": both, "d@example.com": both}


def test_overrides_decide_first(spark, chart):
    given = [
        ("t1@example.com", "tl"),
        ("t1@example.com", "zsm"),  # the later row counts, and there are no lines for it
        ("t2@example.com", "none"),
        ("z1@example.com", "Admin"),
        ("x@example.com", "auditor"),
        ("z2@example.com", "zsm"),
    ]
    people = [e for e, _ in given] + ["boss@example.com"]
    out, teams = seen(spark, chart, people, given, admins=["Boss@homes.example.com "])
    assert out == {
        "t1@example.com": ("zsm", True),
        "t2@example.com": ("blocked", False),
        "z1@example.com": ("admin", True),
        "x@example.com": ("auditor", True),
        "z2@example.com": ("zsm", False),
        "boss@example.com": ("admin", True),
    }
    assert teams == {"z2@example.com": {"t3@example.com"}}


def test_access_upsert(spark):
    current = overrides(spark, ("a@example.com", "tl"), ("b@example.com", "zsm"), ("c@example.com", "ados"))
    items = spark.createDataFrame(
        [
            (0, "A@homes.example.com", "Admin", "s", "n\nm"),
            (1, "b@example.com", "", "", ""),
            (2, "c@example.com", "king", "", ""),
            (3, "nobody", "tl", "", ""),
        ],
        "seq BIGINT, email STRING, role STRING, scope STRING, note STRING",
    )
    rows = access.access_upsert(current, items, "me", "now").collect()
    assert [(x.email, x.role, x.note) for x in rows] == [("a@example.com", "admin", "n m"), ("c@example.com", "ados", "")]


def reviews(spark, *rows):
    kinds = ", ".join(f"{c} STRING" for c in RCA_COLUMNS)
    data = [(i, *[r.get(c, "") for c in RCA_COLUMNS]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, f"seq BIGINT, {kinds}")


def test_newest_review_wins_and_ties_go_to_the_later_row(spark):
    log = reviews(
        spark,
        {"audit_date": "2026-08-03", "lead_id": "A", "reason": "first", "logged_at": "2"},
        {"audit_date": "2026-08-03T10:00", "lead_id": "A", "reason": "tie", "logged_at": "2"},
        {"audit_date": "2026-08-03", "lead_id": "A", "reason": "older", "logged_at": "1"},
        {"audit_date": "2026-08-02", "lead_id": "A", "reason": "other day", "logged_at": "1"},
    )
    assert {x.reason for x in review.newest_reviews(log).collect()} == {"tie", "other day"}


@pytest.mark.parametrize(
    ("asked", "days"),
    [(None, 45), ("", 45), ("0", 45), ("junk", 45), ("-3", 1), ("1", 1), ("7days", 7), ("500", 120), (30, 30)],
)
def test_look_back(asked, days):
    assert review.look_back_days(asked) == days


def test_undated_reviews_stay_in_the_window(spark):
    log = reviews(spark, {"audit_date": ""}, {"audit_date": "2026-08-02"}, {"audit_date": "2026-08-01"})
    assert [x.audit_date for x in review.reviews_in_window(log, CLOCK, 1).collect()] == ["", "2026-08-02"]


def test_new_reviews_are_checked_and_cleaned(spark):
    items = reviews(
        spark,
        {"lead_id": "A", "reason": "x\r\ny", "note": "n" * 1000, "auditor_email": "given"},
        {"lead_id": "", "reason": "x"},
        {"lead_id": "B", "reason": ""},
    ).drop("seq")
    (row,) = review.new_reviews(items, "now", auditor_email="me").collect()
    assert (row.reason, len(row.note), row.auditor_email, row.action_status) == ("x y", 900, "me", "open")


def test_audio_listing(spark):
    files = [
        ("s/recordings/L1/1700000000000-a.mp3", ""),
        ("s/recordings/L1/1700000000001-b.txt", "text/plain"),
        ("s/recordings/L1/1700000000002-c.bin", "audio/x-any; q=1"),
        ("s/recordings/L1/1700000000003-d.bin", "video/webm"),
        ("s/recordings/L1/1700000000004-e.bin", "video/avi"),
        ("s/other/1-f.mp3", ""),
    ]
    listing = spark.createDataFrame(files, "path STRING, content_type STRING")
    found = recordings.inventory(listing)
    assert {x.name for x in found.collect()} == {"a.mp3", "c.bin", "d.bin"}
    linked = reviews(spark, {"recording_url": files[0][0]})
    assert {x.name for x in recordings.orphaned(found, linked).collect()} == {"c.bin", "d.bin"}
    leads = spark.createDataFrame([("L1",), ("L/2",)], "lead_id STRING")
    assert recordings.of_leads(found, leads).count() == 3


def test_files_are_listed_without_reading_them(spark, tmp_path):
    folder = tmp_path / "recordings" / "L9"
    folder.mkdir(parents=True)
    (folder / "1700000000000-call.wav").write_bytes(b"1234")
    (row,) = recordings.inventory(recordings.list_files(spark, str(tmp_path))).collect()
    assert (row.lead_key, row.name, row.size, row.uploaded_at) == ("L9", "call.wav", 4, at("2023-11-14 22:13:20").replace(tzinfo=None))


@pytest.mark.parametrize(
    ("rows", "error", "missing", "expected"),
    [(399, "", 0, "THIN"), (400, "", 0, "ok"), (0, "", 0, "EMPTY"), (999, "", 1, "COLS"), (999, "boom", 0, "FAILED")],
)
def test_run_verdicts(spark, rows, error, missing, expected):
    runs = spark.createDataFrame(
        [(at("2026-08-02"), 1000, "", 0), (at("2026-08-03"), rows, error, missing)],
        "run_at TIMESTAMP, rows BIGINT, error STRING, missing_columns INT",
    )
    assert [x.verdict for x in quality.run_verdict(runs).orderBy("run_at").collect()] == ["ok", expected]


@pytest.mark.parametrize(
    ("counts", "expected"),
    [
        ((0, 5, 9, 9, 0, 0), "ALL_EXCLUDED"),
        ((0, 0, 9, 9, 0, 0), "NONE_PARSED"),
        ((0, 0, 0, 9, 0, 0), "NO_SOURCE_ROWS"),
        ((5, 0, 9, 0, 0, 0), "EMPTY_MAP"),
        ((10, 0, 9, 9, 10, 0), "NO_MAILS"),
        ((10, 0, 9, 9, 9, 0), "JOIN_FAILURE"),
        ((10, 0, 9, 9, 0, 3), "HEALTHY"),
    ],
)
def test_pull_verdicts(spark, counts, expected):
    names = "queue_rows excluded_rows source_rows hierarchy_rows blank_mails lrms_in_both".split()
    row = spark.createDataFrame([counts], ", ".join(f"{n} BIGINT" for n in names))
    assert quality.pull_verdict(row).first().verdict == expected

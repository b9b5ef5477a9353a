"""Cases that earlier versions answered wrongly."""

from __future__ import annotations

from leadsieve.config import Clock
from leadsieve.operators.calls import manual_dials_today
from leadsieve.operators.org import tl_pick
from leadsieve.operators.quality import run_verdict
from leadsieve.operators.recordings import of_leads, orphaned
from leadsieve.sources.records import read_sheet
from conftest import at


def test_thin_after_a_failed_run(spark):
    runs = spark.createDataFrame(
        [("1", 1000, 0, ""), ("2", 0, 0, "broken"), ("3", 5, 0, ""), ("4", 0, 0, ""), ("5", 4, 0, "")],
        "run_at string, rows long, missing_columns int, error string",
    )
    verdicts = [r.verdict for r in run_verdict(runs).orderBy("run_at").collect()]
    assert verdicts == ["ok", "FAILED", "THIN", "EMPTY", "ok"]


def test_quoted_and_blank_cells(spark, tmp_path):
    (tmp_path / "a.csv").write_text('id,note,who\nL1,"said ""no"", twice",ann\nL2,"two\nlines",bob\n,,\nL3\n')
    rows = {r.id: (r.note, r.who) for r in read_sheet(spark, str(tmp_path)).collect()}
    assert rows == {"L1": ('said "no", twice', "ann"), "L2": ("two\nlines", "bob"), "L3": ("", "")}


def test_recordings_are_matched_by_their_folder(spark):
    stored = spark.createDataFrame([("file:/store/recordings/L1/1700000000000-a.mp3",), ("file:/store/recordings/L2/1700000000001-b.mp3",)], "path string")
    reviews = spark.createDataFrame([("https://blob.example.com/recordings/L1/1700000000000-a.mp3",), ("",)], "recording_url string")
    assert [r.path for r in orphaned(stored, reviews).collect()] == ["file:/store/recordings/L2/1700000000001-b.mp3"]


def test_the_total_holds_for_every_pass(spark):
    rows = [(f"L{c}{i}", "tl", f"c{c}", 10 * c + i, "2026-01-01", i) for c in range(5) for i in range(7)]
    df = spark.createDataFrame(rows, "lead_id string, tl_email string, category string, priority_key int, created_at string, days_overdue int")
    assert tl_pick(df, per_category=5).count() == 20
    assert tl_pick(df).count() == 20


def test_an_unknown_number_matches_no_lead(spark):
    clock = Clock(at("2026-08-03T09:30:00"))
    leads = spark.createDataFrame([("L1", None), ("L2", "98 7654 3210")], "lead_id string, customer_phone_number string")
    day = clock.as_of.strftime("%Y-%m-%dT%H:%M:%S.000Z")
    calls = spark.createDataFrame([(None, "Manual", day), ("", "Manual", day)], "call_to string, call_type string, created_at string")
    assert manual_dials_today(leads, calls, clock).count() == 0


def test_leads_of_one_safe_form_do_not_get_each_others_recordings(spark):
    stored = [("s/recordings/a_b/1-x.mp3", "a_b"), ("s/recordings/a_b/2-y.mp3", "a_b"), ("s/recordings/c/3-z.mp3", "c")]
    stored = spark.createDataFrame(stored, "path string, lead_key string")
    leads = spark.createDataFrame([("a b",), ("a/b",), ("c",)], "lead_id string")
    reviews = spark.createDataFrame([("a/b", "https://blob.example.com/recordings/a_b/1-x.mp3")], "lead_id string, recording_url string")
    rows = lambda df: sorted((r.path[-5:], r.lead_id, r.ambiguous) for r in df.collect())
    unresolved = [("y.mp3", "a b", True), ("y.mp3", "a/b", True), ("z.mp3", "c", False)]
    assert rows(of_leads(stored, leads, reviews)) == sorted([("x.mp3", "a/b", False), *unresolved])
    assert rows(of_leads(stored, leads)) == sorted([("x.mp3", "a b", True), ("x.mp3", "a/b", True), *unresolved])

"""Readers, kept tables and the daily run."""

from __future__ import annotations

from datetime import timedelta
from types import SimpleNamespace

import pytest
from conftest import CLOCK, at, make_tables
from pyspark.sql import functions as F

from leadsieve.config import Clock
from leadsieve.functions import text
from leadsieve.operators import quality
from leadsieve.operators.rules import COLUMNS_V7_8
from leadsieve.plans.daily import export_day
from leadsieve.plans.queue import build_queue
from leadsieve.session import scratch_path
from leadsieve.sources import records, schemas, snapshot


def column(spark, values, fn):
    df = spark.createDataFrame([(v,) for v in values], "v STRING")
    return [x.r for x in df.select(fn(F.col("v")).alias("r")).collect()]


def test_text_helpers(spark):
    assert column(spark, ["1,204", "", "n/a", None, " 7 ", "2.5e3", "1d", "-3"], text.number_from_text) == [
        1204, 0, 0, 0, 7, 2500, 0, -3,
    ]
    assert column(spark, ["TRUE", "true", "1", None, " true"], text.flag_from_text) == [True, True, False, False, False]
    assert column(spark, [" A@Homes.Example.com\t", "b@example.com", None], text.mail_key) == [
        "a@example.com", "b@example.com", None,
    ]
    assert column(spark, ["Ann-Marie  O'Neil 3", None], text.name_key) == ["ann marie o neil", ""]
    assert column(spark, ["a\r\n\tb", None], lambda c: text.one_line(c, 3)) == ["a b", ""]
    assert column(spark, ["a b/ç.mp3"], text.path_safe) == ["a_b__.mp3"]
    assert column(spark, ["A@x, b@Y\n c "], text.word_list) == [["a@x", "b@y", "c"]]
    assert column(spark, ["+91 98765-43210", "12", None], text.phone_key) == ["9876543210", "12", ""]


def test_column_keys():
    assert [text.column_key(n) for n in ("Audit Date", " (Lead) ID ", "a--b", "__x__")] == [
        "audit_date", "lead_id", "a_b", "x",
    ]


def test_colliding_columns_are_an_error(spark):
    df = spark.createDataFrame([(1, 2)], "`Lead ID` INT, lead_id INT")
    with pytest.raises(ValueError, match="lead_id"):
        records.key_columns(df)


def test_card_json_array_and_lines(spark, tmp_path):
    (tmp_path / "array.json").write_text('[{"Lead ID": "A"},\n {"Lead ID": "B", "Days": 3}]')
    (tmp_path / "lines.json").write_text('{"Lead ID": "A"}\n{"Lead ID": "B", "Days": 3}\n')
    for name, lines in (("array.json", False), ("lines.json", True)):
        rows = records.read_card_json(spark, str(tmp_path / name), lines=lines)
        assert sorted((x.lead_id, x.days) for x in rows.collect()) == [("A", None), ("B", 3)]


def test_ragged_sheet(spark, tmp_path):
    (tmp_path / "s.csv").write_text(' a ,b,c\n1\n\n2,,x\n3,y,z,extra\n')
    rows = records.read_sheet(spark, str(tmp_path / "s.csv")).drop("seq")
    assert rows.columns == ["a", "b", "c"]
    assert sorted(map(tuple, rows.collect())) == [("1", "", ""), ("2", "", "x"), ("3", "y", "z")]


def test_positions_beat_an_old_header(spark, tmp_path):
    (tmp_path / "log.csv").write_text("logged_at, Lead_ID ,audit_date\n2026,2026-08-03,A,Ann\n")
    (row,) = records.read_positional(spark, str(tmp_path / "log.csv"), schemas.RCA_LOG).collect()
    assert (row.logged_at, row.audit_date, row.lead_id, row.customer_name, row.category) == ("2026", "2026-08-03", "A", "Ann", "")


def test_fallback(spark, tmp_path):
    (tmp_path / "s.csv").write_text("a\n1\n")
    def sheet():
        return records.read_sheet(spark, str(tmp_path / "s.csv"))
    rows = records.with_fallback(lambda: records.read_card_json(spark, str(tmp_path / "none")), sheet)
    assert rows.first().source == "sheet"
    assert records.with_fallback(sheet, sheet).first().source == "card"


def session_like(master, shared=None):
    conf = SimpleNamespace(get=lambda key, default=None: shared or default)
    return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master))


def test_scratch_follows_the_session():
    assert scratch_path(session_like("spark://x", "/shared/work/"), "x").startswith("/shared/work/leadsieve/x-")
    assert scratch_path(session_like("local[2]", "/shared"), "x").startswith("/shared/leadsieve/x-")
    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        scratch_path(session_like("spark://x"), "x")


def test_column_diff(spark):
    df = spark.createDataFrame([(1, None, 2), (1, 5, 2)], "a INT, b INT, z INT")
    got = {x.column_name: (x.state, x.filled_rows) for x in snapshot.column_diff(df, ("a", "b", "c")).collect()}
    assert got == {"a": ("ok", 2), "b": ("ok", 1), "c": ("missing", 0), "z": ("unexpected", 2)}
    assert snapshot.fill_missing(df, ("c", "a")).columns == ["c", "a"]


def lead_tables(spark, n):
    events = [
        {"lead_id": f"L{i}", "stage": "Meeting Rescheduled", "created_at": at("2026-07-29"), "meeting_schedule_date": at("2026-08-06")}
        for i in range(n)
    ]
    return make_tables(
        spark,
        leads=[{"lead_id": f"L{i}"} for i in range(n)],
        events=events,
        users=[{"user_id": "u1", "first_name": "Ann", "emails": "A@homes.example.com"}],
    )


def test_daily_run(spark, tmp_path):
    root = str(tmp_path)

    def kept(name):
        return spark.read.parquet(f"{root}/{name}")

    def export(leads, clock=CLOCK, **options):
        return export_day(build_queue(lead_tables(spark, leads), clock), clock, root, **options)

    assert export(25).first().rows == 20
    first = kept("queue")
    assert sorted(first.columns) == sorted(COLUMNS_V7_8)
    assert {x.lrm_email for x in first.collect()} == {"a@example.com"}
    # a refresh replaces the day, a first-of-day run leaves it, and both runs stay in the log
    export(7, exported_at=CLOCK.as_of + timedelta(hours=1))
    assert kept("queue").count() == 7
    export(9, first_of_day=True)
    assert kept("queue").count() == 7
    assert sorted(x["count"] for x in kept("queue_log").groupBy("exported_at").count().collect()) == [7, 20]
    # an empty run changes nothing
    export(0)
    assert kept("queue").count() == 7 and kept("queue_log").count() == 27
    # the next day is added, and retention drops days that are too old
    export(5, Clock(CLOCK.as_of + timedelta(days=1)))
    assert kept("queue").count() == 12
    assert snapshot.drop_expired(spark, f"{root}/queue_log", Clock(CLOCK.as_of + timedelta(days=121))) == ["2026-08-03"]
    assert kept("queue_log").count() == 5
    assert kept("run_log").count() == 5


def test_failed_run_and_lost_column_are_logged(spark, tmp_path):
    root = str(tmp_path)
    queue = build_queue(lead_tables(spark, 5), CLOCK).withColumn("audit_date", F.col("audit_date").cast("string"))
    with pytest.raises(Exception, match="no such thing"):
        bad = queue.withColumn("cluster", F.raise_error(F.lit("no such thing")).cast("string"))
        export_day(bad, CLOCK, root)
    row = export_day(queue.drop("leak_code"), CLOCK, root, exported_at=CLOCK.as_of + timedelta(hours=1)).first()
    assert (row.rows, row.missing_columns) == (5, 1)
    assert {x.leak_code for x in spark.read.parquet(f"{root}/queue").collect()} == {None}
    runs = quality.run_verdict(spark.read.parquet(f"{root}/run_log")).orderBy("run_at").collect()
    assert [x.verdict for x in runs] == ["FAILED", "COLS"]


def test_run_that_fails_late(spark, tmp_path, monkeypatch):
    root, (one, two, three) = str(tmp_path), (CLOCK.as_of + timedelta(hours=h) for h in (1, 2, 3))
    queue = build_queue(lead_tables(spark, 5), CLOCK)

    def broken(*args):
        raise OSError("disk gone")

    with monkeypatch.context() as m:
        m.setattr(snapshot, "append_log", broken)
        with pytest.raises(OSError):
            export_day(queue, CLOCK, root, exported_at=one)
    # the day never reached the log, so a first-of-day run does it again
    with monkeypatch.context() as m:
        m.setattr(snapshot, "drop_expired", broken)
        with pytest.raises(OSError):
            export_day(queue, CLOCK, root, exported_at=two, first_of_day=True)
    assert spark.read.parquet(f"{root}/queue_log").count() == 5
    # now it is there, although the clean-up failed
    assert export_day(queue, CLOCK, root, exported_at=three, first_of_day=True).first().rows == 5
    assert spark.read.parquet(f"{root}/queue_log").count() == 5
    runs = spark.read.parquet(f"{root}/run_log").orderBy("run_at").collect()
    assert [(x.rows, x.error) for x in runs] == [(0, "disk gone"), (5, "disk gone"), (5, "")]


def test_write_once(spark, tmp_path):
    path = str(tmp_path / "q")
    days = spark.sql("SELECT DATE'2026-08-01' + CAST(id AS INT) AS audit_date, 'a' AS run FROM range(3)")
    assert snapshot.read_kept(spark, path) is None
    snapshot.write_once(days.limit(2), path)
    snapshot.write_once(days.withColumn("run", F.lit("b")), path)
    rows = {str(x.audit_date): x.run for x in spark.read.parquet(path).collect()}
    assert rows == {"2026-08-01": "a", "2026-08-02": "a", "2026-08-03": "b"}

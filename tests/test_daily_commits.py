"""A run that dies at any step: readers see whole runs, and the next run loses and doubles nothing."""

from __future__ import annotations

from datetime import timedelta

import pytest
from conftest import CLOCK
from pyspark.sql import functions as F

from leadsieve.config import Clock
from leadsieve.plans import daily
from leadsieve.sources import commits, snapshot

COLUMNS = ("audit_date", "lead_id", "run")


class Died(BaseException):
    """The process is gone: nothing after this line runs, no handler either."""


def queue(spark, run: str, n: int, clock=CLOCK):
    rows = spark.range(0, n, 1, 3).select(F.concat(F.lit("L"), F.col("id")).alias("lead_id"), F.lit(run).alias("run"))
    return rows.withColumn("audit_date", clock.today_col()).select(*COLUMNS)


def export(spark, root, run, n, hours, clock=CLOCK, **how):
    at = CLOCK.as_of + timedelta(hours=hours)
    return daily.export_day(queue(spark, run, n, clock), clock, root, expected=COLUMNS, exported_at=at, **how)


def held(df) -> dict:
    """Rows of each (day, run), and that no lead is there twice."""
    if df is None:
        return {}
    rows = df.groupBy(F.col("audit_date").cast("string").alias("d"), "run").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("lead_id").alias("u"))
    out = {}
    for x in rows.collect():
        assert x.n == x.u
        out[x.d, x.run] = x.n
    return out


def dies(monkeypatch, where, name, call=1, after=True):
    real, calls = getattr(where, name), []

    def wrapped(*args, **kwargs):
        calls.append(name)
        if len(calls) == call and not after:
            raise Died(name)
        out = real(*args, **kwargs)
        if len(calls) == call:
            raise Died(name)
        return out

    monkeypatch.setattr(where, name, wrapped)


#: Where a run may die, and whether the run has happened by then.
STEPS = {
    "staged": (commits, "stage", 1, True, False),
    "not marked": (commits, "mark", 1, False, False),
    "marked": (commits, "mark", 1, True, True),
    "before the queue": (snapshot, "replace_day", 1, False, True),
    "after the queue": (snapshot, "replace_day", 1, True, True),
    "log written aside": (snapshot, "append_log", 1, True, True),
    "log moved in": (commits, "append_run", 1, True, True),
    "log marked": (commits, "mark", 2, True, True),
    "expired": (snapshot, "drop_expired", 1, True, True),
    "closing": (commits, "close", 1, False, True),
    "closed": (commits, "close", 1, True, True),
}
TODAY, NEXT = "2026-08-03", "2026-08-04"


@pytest.mark.parametrize("step", STEPS)
def test_death_at_any_step(spark, tmp_path, monkeypatch, step):
    where, name, call, after, happened = STEPS[step]
    more = ("first", "empty") if step in ("staged", "after the queue", "log marked") else ()
    bases = {how: str(tmp_path / how) for how in ("again", "next", *more)}
    for root in bases.values():
        export(spark, root, "old", 4, 0, Clock(CLOCK.as_of - timedelta(days=1)))
        with monkeypatch.context() as m:
            dies(m, where, name, call, after)
            with pytest.raises(Died):
                export(spark, root, "dead", 7, 1)
    old = {("2026-08-02", "old"): 4}
    dead = {(TODAY, "dead"): 7} if happened else {}
    root = bases["again"]
    assert held(commits.read_queue(spark, root)) == {**old, **dead}
    logged = step in ("log marked", "expired", "closing", "closed")
    assert held(commits.read_log(spark, root)) == {**old, **(dead if logged else {})}

    # the same day again: its rows replace the day; the dead run stays in the log only if it got there whole
    export(spark, root, "again", 9, 2)
    assert held(spark.read.parquet(f"{root}/queue")) == {**old, (TODAY, "again"): 9}
    assert held(spark.read.parquet(f"{root}/queue_log")) == {**old, (TODAY, "again"): 9, **(dead if logged else {})}

    # a first-of-day run leaves a day that was logged and does the others again
    if root := bases.get("first"):
        export(spark, root, "first", 9, 2, first_of_day=True)
        kept = dead if logged else {(TODAY, "first"): 9}
        assert held(spark.read.parquet(f"{root}/queue")) == held(spark.read.parquet(f"{root}/queue_log")) == {**old, **kept}

    # the next day's run, or an empty one, ends what was left
    for how, day, n in (("next", NEXT, 5), ("empty", TODAY, 0)):
        if how not in bases:
            continue
        root = bases[how]
        export(spark, root, how, n, 26, Clock(CLOCK.as_of + timedelta(days=1)) if how == "next" else CLOCK)
        want = {**old, **dead, **({(day, how): n} if n else {})}
        assert held(spark.read.parquet(f"{root}/queue")) == held(spark.read.parquet(f"{root}/queue_log")) == want
        assert commits.pending(spark, root) == [] and held(commits.read_queue(spark, root)) == want


def test_a_log_moved_in_half(spark, tmp_path, monkeypatch):
    """The run dies between two of its files; finishing takes the first one out again."""
    root = str(tmp_path)
    made = []
    real = commits.append_run

    def half(rows, path, exported_at, run):
        real(rows, path, exported_at, run)
        log = commits.Folder(spark, path)
        names = [x for x in log.names(f"audit_date={TODAY}") if x.startswith(f"{run}-")]
        made.extend(names)
        log.delete(f"audit_date={TODAY}", names[0])
        raise Died

    with monkeypatch.context() as m:
        m.setattr(commits, "append_run", half)
        with pytest.raises(Died):
            export(spark, root, "dead", 7, 1)
    assert len(made) > 1
    assert held(commits.read_log(spark, root)) == {} and held(commits.read_queue(spark, root)) == {(TODAY, "dead"): 7}
    export(spark, root, "next", 5, 26, Clock(CLOCK.as_of + timedelta(days=1)))
    assert held(spark.read.parquet(f"{root}/queue_log")) == {(TODAY, "dead"): 7, (NEXT, "next"): 5}


def test_run_history(spark):
    t = [CLOCK.as_of + timedelta(days=i) for i in range(5)]
    runs = [(t[0], 100, "", 0), (t[1], 0, "", 0), (t[2], 30, "", 0), (t[3], 90, "", 2), (t[4], 0, "card gone", 0)]
    rows = daily.run_history(spark.createDataFrame(runs, "run_at TIMESTAMP, rows BIGINT, error STRING, missing_columns INT")).orderBy("run_at").collect()
    assert [(x.verdict, x.notes) for x in rows] == [
        ("ok", ""), ("EMPTY", "no rows; the last queue stays"), ("THIN", "30 rows after 100"), ("COLS", "2 columns did not come back"), ("FAILED", "card gone"),
    ]


def test_kept_picks(spark, tmp_path):
    def lists(day, n):
        rows = spark.range(n).select(*[F.lit("x").alias(c) for c in daily.PICK_COLUMNS[:4]], F.lit(1).alias("pick_pass"), F.col("id").alias("pick_rank"))
        return rows.withColumn("audit_date", F.lit(day).cast("date"))

    root = str(tmp_path)
    for day, n in (("2026-07-31", 3), ("2026-08-01", 4), ("2026-08-03", 5), ("2026-08-03", 6), ("2026-08-04", 7)):
        daily.export_picks(lists(day, n), root)
    kept = spark.read.parquet(f"{root}/{daily.PICKS}")
    month = daily.month_picks(kept, CLOCK)
    assert month.count() == 10
    assert "PartitionFilters: [isnotnull(audit_date" in month._jdf.queryExecution().toString()

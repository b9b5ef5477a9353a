"""One scheduled run: keep the day's queue, log it, and say how it went."""

from __future__ import annotations

import time
import uuid
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from leadsieve.config import Clock
from leadsieve.operators import quality
from leadsieve.operators.rules import COLUMNS_V7_8
from leadsieve.sources import commits, snapshot
from leadsieve.sources.schemas import RUN_LOG


def export_day(
    queue: DataFrame,
    clock: Clock,
    root: str,
    *,
    expected: tuple[str, ...] = COLUMNS_V7_8,
    exported_at: datetime | None = None,
    first_of_day: bool = False,
) -> DataFrame:
    """Write `queue`, `queue_log` and `run_log` under `root` and return this run's log row.

    The queue, built here or read from a report, is computed once: it is staged, and the day
    and the log are written from the staged rows. Columns that did not come back are written
    blank. With `first_of_day` a day that is already in the log stays as it is; otherwise it is
    replaced. An empty run leaves the last queue in place and logs no rows. A run that
    throws is logged, with its message and the rows that reached the log, before the error goes on.

    A run that dies between two writes leaves a marker (`sources.commits`), and the next one ends its
    work first, or undoes it if it has rows for the same day. `commits.read_queue` and `read_log` show
    whole runs at any time.
    """
    spark, run_at = queue.sparkSession, exported_at or clock.as_of
    begun = fetched = written = time.monotonic()
    missing = snapshot.missing_columns(queue, expected)
    run = uuid.uuid4().hex

    def log_run(rows: int, error: str) -> DataFrame:
        done = time.monotonic()
        phases = (fetched - begun, written - fetched, done - written, done - begun)
        row = spark.createDataFrame([(run_at, rows, *phases, error, len(missing))], RUN_LOG)
        row.write.mode("append").parquet(f"{root}/run_log")
        return row

    logged = 0
    try:
        today = clock.today.isoformat()
        left = commits.pending(spark, root)
        same_day = [m for m in left if not m.logged and m.days == (today,)]
        for marker in left:
            if marker not in same_day:
                commits.finish(spark, root, marker)
        # the log is written last, so a day in it is whole; a day in the queue alone is done again
        if first_of_day and day_rows(commits.read_log(spark, root), clock):
            return log_run(day_rows(commits.read_queue(spark, root), clock), "")
        rows = commits.stage(snapshot.fill_missing(queue, expected), root, run)
        days = tuple(r[0] for r in rows.select(F.col(snapshot.DAY).cast("string")).distinct().orderBy(snapshot.DAY).collect())
        count = rows.count()
        fetched = written = time.monotonic()
        if count:
            for marker in same_day:
                commits.undo(spark, root, marker)
            marker = commits.Marker(run, run_at.isoformat(), days)
            commits.mark(spark, root, marker)
            commits.to_queue(spark, root, marker)
            written = time.monotonic()
            marker = commits.to_log(spark, root, marker)
            logged = count
            snapshot.drop_expired(spark, f"{root}/{commits.LOG}", clock)
            commits.close(spark, root, marker)
        else:
            for marker in same_day:
                commits.finish(spark, root, marker)
            commits.Folder(spark, root).delete(commits.STAGING, run)
    except Exception as error:
        log_run(logged, str(error) or type(error).__name__)
        raise
    return log_run(count, "")


def day_rows(kept: DataFrame | None, clock: Clock) -> int:
    """Rows of the clock's day that are kept already; reads that partition only."""
    return 0 if kept is None else kept.filter(F.col(snapshot.DAY) == clock.today_col()).count()


def export_picks(worklists: DataFrame, root: str) -> None:
    """Keep the work lists of the days they hold; a day that is drawn again is replaced.

    Adherence counts what was on a list when it was handed out, so picks are kept and not drawn
    again from a later queue.
    """
    snapshot.replace_day(worklists.select(*PICK_COLUMNS), f"{root}/{PICKS}")


PICKS, PICK_COLUMNS = "picks", ("tl_email", "lrm_email", "lead_id", "category", "pick_pass", "pick_rank", snapshot.DAY)


def month_picks(kept: DataFrame, clock: Clock) -> DataFrame:
    """Kept picks of the local month so far, by the partition column: other months' files stay closed."""
    day = F.col(snapshot.DAY).cast("date")
    return kept.filter((day >= F.lit(clock.month_start)) & (day <= clock.today_col()))


def run_history(runs: DataFrame) -> DataFrame:
    """The run log as people read it: each run with its verdict and a note that says why."""
    judged = quality.run_verdict(runs)
    before = F.col("previous_rows").cast("string")
    notes = (
        F.when(F.col("verdict") == "FAILED", F.col("error"))
        .when(F.col("verdict") == "EMPTY", "no rows; the last queue stays")
        .when(F.col("verdict") == "COLS", F.concat(F.col("missing_columns").cast("string"), F.lit(" columns did not come back")))
        .when(F.col("verdict") == "THIN", F.concat(F.col("rows").cast("string"), F.lit(" rows after "), before))
        .otherwise("")
    )
    return judged.withColumn("notes", notes)

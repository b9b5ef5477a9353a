"""What makes a run's day appear in all kept tables at once, or not at all.

A run stages its rows under its own name, then puts down a marker with what it is about to do. From
there on the run happened, whatever breaks: readers take the marked days from the staged rows until
the kept tables hold them, and the next run finishes the work, or undoes it where it writes the same
day anew. Markers are small files that appear by one rename. One run at a time writes.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, replace
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsieve.config import instant
from leadsieve.sources import snapshot

MARKERS, STAGING, QUEUE, LOG = "commits", "staging", "queue", "queue_log"


@dataclass(frozen=True)
class Marker:
    """A run between its staging and its end. `logged` once the queue and the log hold its rows."""

    run: str
    exported_at: str
    days: tuple[str, ...]
    logged: bool = False

    @property
    def moment(self) -> datetime:
        return datetime.fromisoformat(self.exported_at)


class Folder:
    """Names and small files under a root that any Hadoop file system holds."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.path = spark._jvm.org.apache.hadoop.fs.Path
        self.files = self.path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, *parts: str):
        return self.path("/".join((self.root, *parts)))

    def names(self, *parts: str) -> list[str]:
        where = self.at(*parts)
        return sorted(x.getPath().getName() for x in self.files.listStatus(where)) if self.files.exists(where) else []

    def delete(self, *parts: str) -> None:
        self.files.delete(self.at(*parts), True)

    def move(self, source: tuple[str, ...], target: tuple[str, ...]) -> None:
        self.files.mkdirs(self.at(*target[:-1]))
        if not self.files.rename(self.at(*source), self.at(*target)):
            raise OSError(f"cannot move {'/'.join(source)} to {'/'.join(target)}")

    def write(self, text: str, *parts: str) -> None:
        """A whole file or none: written aside, then renamed."""
        aside = (*parts[:-1], f".{parts[-1]}.tmp")
        out = self.files.create(self.at(*aside), True)
        out.write(text.encode())
        out.close()
        self.files.delete(self.at(*parts), False)
        self.move(aside, parts)

    def read(self, *parts: str) -> str:
        return "\n".join(r["value"] for r in self.spark.read.text(self.at(*parts).toString()).collect())


def pending(spark: SparkSession, root: str) -> list[Marker]:
    """Runs that were marked and have not ended, oldest first."""
    folder = Folder(spark, root)
    found = [json.loads(folder.read(MARKERS, name)) for name in folder.names(MARKERS) if not name.startswith(".")]
    return sorted((Marker(**{**m, "days": tuple(m["days"])}) for m in found), key=lambda m: m.exported_at)


def mark(spark: SparkSession, root: str, marker: Marker) -> None:
    Folder(spark, root).write(json.dumps(asdict(marker)), MARKERS, f"{marker.run}.json")


def staged(spark: SparkSession, root: str, run: str) -> DataFrame:
    return spark.read.parquet(f"{root}/{STAGING}/{run}/rows")


def stage(queue: DataFrame, root: str, run: str) -> DataFrame:
    """The rows of a run, written once under its own name."""
    queue.write.parquet(f"{root}/{STAGING}/{run}/rows")
    return staged(queue.sparkSession, root, run)


def append_run(rows: DataFrame, path: str, exported_at: datetime, run: str) -> None:
    """Append a run to a kept log so that doing it again leaves the same rows.

    The files are written aside and moved in under the run's name; what an earlier try moved in is
    taken out first.
    """
    spark = rows.sparkSession
    remove_run(spark, path, run)
    aside = Folder(spark, f"{path}_aside/{run}")
    aside.delete()
    snapshot.append_log(rows, aside.root, exported_at)
    log = Folder(spark, path)
    for day in aside.names():
        if day.startswith(f"{snapshot.DAY}="):
            for name in aside.names(day):
                if name.endswith(".parquet"):
                    log.files.mkdirs(log.at(day))
                    if not log.files.rename(aside.at(day, name), log.at(day, f"{run}-{name}")):
                        raise OSError(f"cannot move {day}/{name} into {path}")
    aside.delete()


def remove_run(spark: SparkSession, path: str, run: str) -> None:
    """Take a run's files out of a kept log."""
    log = Folder(spark, path)
    for day in log.names():
        if day.startswith(f"{snapshot.DAY}="):
            for name in log.names(day):
                if name.startswith(f"{run}-"):
                    log.delete(day, name)


def to_queue(spark: SparkSession, root: str, marker: Marker) -> None:
    snapshot.replace_day(staged(spark, root, marker.run), f"{root}/{QUEUE}")


def to_log(spark: SparkSession, root: str, marker: Marker) -> Marker:
    append_run(staged(spark, root, marker.run), f"{root}/{LOG}", marker.moment, marker.run)
    marker = replace(marker, logged=True)
    mark(spark, root, marker)
    return marker


def finish(spark: SparkSession, root: str, marker: Marker) -> None:
    """Do what a marked run had left to do; each step may have been done before, in whole or in part."""
    if not marker.logged:
        to_queue(spark, root, marker)
        marker = to_log(spark, root, marker)
    close(spark, root, marker)


def close(spark: SparkSession, root: str, marker: Marker) -> None:
    """End a run: its marker goes, then its staged rows."""
    folder = Folder(spark, root)
    folder.delete(MARKERS, f"{marker.run}.json")
    folder.delete(STAGING, marker.run)


def undo(spark: SparkSession, root: str, marker: Marker) -> None:
    """Forget a marked run that did not reach the log whole; another run is about to replace its days."""
    remove_run(spark, f"{root}/{LOG}", marker.run)
    close(spark, root, marker)


def read_queue(spark: SparkSession, root: str) -> DataFrame | None:
    """The kept queue: days that a run has marked are read from its staged rows, whole."""
    kept, open_runs = snapshot.read_kept(spark, f"{root}/{QUEUE}"), [m for m in pending(spark, root) if not m.logged]
    for marker in open_runs:
        rows = staged(spark, root, marker.run)
        if kept is not None:
            day = F.col(snapshot.DAY).cast("string")
            rows = kept.filter(~day.isin(*marker.days)).unionByName(rows.select(*kept.columns))
        kept = rows
    return kept


def read_log(spark: SparkSession, root: str) -> DataFrame | None:
    """The history of runs without what an unfinished run has brought in so far."""
    kept = snapshot.read_kept(spark, f"{root}/{LOG}")
    open_runs = [m.moment for m in pending(spark, root) if not m.logged]
    if kept is None or not open_runs:
        return kept
    return kept.filter(~F.col("exported_at").isin(*[instant(x) for x in open_runs]))

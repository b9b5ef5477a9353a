"""The kept newest stage equals the batch answer, whatever the order and however often events arrive."""

from __future__ import annotations

import random
from datetime import timedelta

import pytest
from conftest import CLOCK

from leadsieve.operators.history import latest_stage
from leadsieve.sources import commits
from leadsieve.sources.schemas import LEAD_HISTORY
from leadsieve.streaming import latest


def events(n: int, seed: int):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lead = "hot" if rng.random() < 0.4 else f"L{rng.randrange(40)}"
        at = None if rng.random() < 0.05 else CLOCK.as_of - timedelta(minutes=rng.randrange(300))
        out.append((f"e{seed}-{i:04d}", lead, at, f"s{rng.randrange(9)}", None, None, None, None))
    return out


def rows(df) -> list:
    return sorted(map(tuple, df.collect()), key=str)


def arrive(spark, folder, batch) -> None:
    spark.createDataFrame(batch, LEAD_HISTORY).coalesce(1).write.mode("append").parquet(folder)


def run(spark, tmp_path, checkpoint="seen", **how) -> None:
    query = latest.follow(spark, str(tmp_path / "in"), LEAD_HISTORY, str(tmp_path / "kept"), str(tmp_path / checkpoint), parts=4, **how)
    query.awaitTermination()


def test_follows_late_and_replayed_events(spark, tmp_path):
    root, seen = str(tmp_path / "kept"), []
    assert latest.read_latest(spark, root) is None
    for seed in (1, 2, 3):
        batch = events(80, seed)
        seen += batch
        arrive(spark, str(tmp_path / "in"), batch)
        run(spark, tmp_path, files_per_batch=1)
        want = latest_stage(spark.createDataFrame(seen, LEAD_HISTORY))
        assert rows(latest.read_latest(spark, root)) == rows(want)
    run(spark, tmp_path)  # nothing new
    run(spark, tmp_path, checkpoint="lost")  # the checkpoint is gone: everything is merged again
    assert rows(latest.read_latest(spark, root)) == rows(want)


def test_a_batch_that_dies_is_done_again(spark, tmp_path, monkeypatch):
    root = str(tmp_path / "kept")
    first, second = events(60, 7), events(60, 8)
    arrive(spark, str(tmp_path / "in"), first)
    run(spark, tmp_path)
    arrive(spark, str(tmp_path / "in"), second)

    def broken(*args):
        raise OSError("disk gone")

    with monkeypatch.context() as m:
        m.setattr(commits.Folder, "write", broken)
        with pytest.raises(Exception, match="disk gone"):
            run(spark, tmp_path)
    assert rows(latest.read_latest(spark, root)) == rows(latest_stage(spark.createDataFrame(first, LEAD_HISTORY)))
    run(spark, tmp_path)
    assert rows(latest.read_latest(spark, root)) == rows(latest_stage(spark.createDataFrame(first + second, LEAD_HISTORY)))


def test_only_touched_parts_are_written(spark, tmp_path):
    root = str(tmp_path / "kept")
    latest.merge(spark.createDataFrame(events(200, 5), LEAD_HISTORY), root, "one", parts=8)
    latest.merge(spark.createDataFrame([e for e in events(200, 6) if e[1] == "hot"], LEAD_HISTORY), root, "two", parts=8)
    versions = latest.manifest(spark, root)["versions"]
    assert sorted(versions.values()).count("two") == 1 and len(versions) == 8
    latest.merge(spark.createDataFrame([], LEAD_HISTORY), root, "three", parts=8)
    assert latest.manifest(spark, root)["versions"] == versions
    with pytest.raises(ValueError, match="8 parts"):
        latest.merge(spark.createDataFrame(events(5, 9), LEAD_HISTORY), root, "four", parts=4)

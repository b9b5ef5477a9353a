"""Review files are short, and reviews carry only the cells that are asked for."""

from __future__ import annotations

import csv
import glob

from checks import queries_org
from leadsieve.operators import review
from leadsieve.sources.schemas import RCA_COLUMNS


def test_files_with_line_breaks_are_short(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(queries_org, "FILE_ROWS", 10)
    monkeypatch.setattr(queries_org, "scratch_path", lambda spark, label: f"{tmp_path}/{label}")
    rows = spark.range(95).selectExpr("id AS seq", "concat('a\n', id) AS cell")
    found = []
    for name in sorted(glob.glob(f"{queries_org.file_of(rows, 'x')}/*.csv")):
        with open(name, newline="") as file:
            cells = list(csv.reader(file))[1:]
        assert len(cells) <= 10
        found += cells
    assert found == [[f"a\n{i}"] for i in range(95)]


def test_newest_reviews_carry_only_what_is_asked(spark):
    log = [(i, *[{"lead_id": "A", "audit_date": "2026-08-01", "logged_at": f"t{i}", "note": "n" * 99}.get(c, "") for c in RCA_COLUMNS]) for i in range(3)]
    rows = review.newest_reviews(spark.createDataFrame(log, ["seq", *RCA_COLUMNS]), ["lead_id", "logged_at"])
    assert [tuple(r) for r in rows.collect()] == [("A", "t2")]
    assert "note" not in rows._jdf.queryExecution().optimizedPlan().toString().split("LogicalRDD")[0]

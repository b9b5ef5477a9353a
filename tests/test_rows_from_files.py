"""Rows as they arrive: order, awkward headers and cells, cards that break their contract."""

from __future__ import annotations

import pytest

from leadsieve.operators import review
from leadsieve.plans import serve
from leadsieve.sources import records, schemas


def put(folder, name: str, text: str) -> str:
    folder.mkdir(exist_ok=True)
    (folder / name).write_text(text)
    return str(folder)


def test_dotted_headers_and_places(spark, tmp_path):
    text = 'S.No,"Emp. Name",a`b\n1,"Ann\n""x"", y"\n\n,,\n2,Bob,q,extra\n'
    rows = records.read_sheet(spark, put(tmp_path / "s", "one file.csv", text))
    assert rows.columns == ["seq", "S.No", "Emp. Name", "a`b"]
    assert [tuple(r)[1:] for r in rows.orderBy("seq").collect()] == [("1", 'Ann\n"x", y', ""), ("2", "Bob", "q")]
    with pytest.raises(ValueError, match="seq"):
        records.read_sheet(spark, put(tmp_path / "own", "a.csv", "seq,x\n1,2\n"))
    own = records.read_sheet(spark, str(tmp_path / "own"), place="row")
    assert own.first().asDict() == {"row": 0, "seq": "1", "x": "2"}


def test_files_follow_each_other_by_name(spark, tmp_path):
    # the larger file is read first by Spark, the smaller name comes first here
    put(tmp_path / "s", "b.csv", "v\n" + "".join(f"b{i}\n" for i in range(500)))
    put(tmp_path / "s", "a.csv", "v\na0\na1\n")
    folder = put(tmp_path / "s", "c d.csv", "v\nc0\n")
    got = [r.v for r in records.read_sheet(spark, folder).orderBy("seq").collect()]
    assert got == ["a0", "a1", *[f"b{i}" for i in range(500)], "c0"]


def test_chart_and_reviews_from_files(spark, tmp_path):
    sheet = 'S.No,Email IDs,LRM Name,TL Email\n1,a@x.y,"Ann\nLee",t1@x.y\n2,b@x.y,Bob,t1@x.y\n3,A@X.Y,Ann,t2@x.y\n'
    tab = "lrm_email,old\nb@x.y,,t9@x.y\nb@x.y,Robert\n"
    overrides = records.read_positional(
        spark, put(tmp_path / "o", "t.csv", tab), schemas.columns(", ".join(f"{c} STRING" for c in schemas.MAPPING_COLUMNS)), header="lrm_email"
    )
    chart = serve.build_hierarchy(records.read_sheet(spark, put(tmp_path / "s", "s.csv", sheet)), overrides)
    rows = [(r.lrm_email, r.lrm_name, r.tl_email, r.overridden) for r in chart.orderBy("seq").collect()]
    assert rows == [("a@x.y", "Ann", "t2@x.y", False), ("b@x.y", "Robert", "t9@x.y", True)]
    log = "logged_at,lead_id\n2,2026-08-03,A,,,,,,,,,first\n2,2026-08-03,A,,,,,,,,,second\n1,2026-08-03,A,,,,,,,,,third\n"
    newest = review.newest_reviews(records.read_positional(spark, put(tmp_path / "r", "r.csv", log), schemas.RCA_LOG))
    assert [r.reason for r in newest.collect()] == ["second"]


CARD = schemas.columns("lead_id STRING, days_overdue DOUBLE, category_rank BIGINT")


def test_card_contract(spark, tmp_path):
    lines = '{"Lead ID":"A","Days Overdue":"2.5","gone":1}\n[{"lead_id":"B","category_rank":3},{"lead_id":"C"}]\n\n[]\n'
    card = records.read_card(spark, put(tmp_path / "c", "c.json", lines), CARD)
    rows = sorted(tuple(r) for r in records.unbroken(card).collect())
    assert rows == [("A", 2.5, None), ("B", None, 3), ("C", None, None)]
    whole = put(tmp_path / "w", "w.json", '[{"lead_id":"A"},\n {"lead_id":"B"}]')
    assert {r.lead_id for r in records.read_card(spark, whole, CARD, lines=False).collect()} == {"A", "B"}


@pytest.mark.parametrize("bad", ['{"lead_id":', "5", "null", '[{"lead_id":"B"}, 7]', '{"days_overdue":"soon"}'])
def test_a_broken_record_means_the_sheet(spark, tmp_path, bad):
    sheet = put(tmp_path / "s", "s.csv", "lead_id\nS\n")
    good = "".join(f'{{"lead_id":"{i}"}}\n' for i in range(50))

    def read(text: str):
        path = put(tmp_path / "c", "c.json", text)
        return records.with_fallback(lambda: records.read_card(spark, path, CARD), lambda: records.read_sheet(spark, sheet))

    assert {r.source for r in read(good).collect()} == {"card"}
    assert [(r.lead_id, r.source) for r in read(good + bad + "\n" + good).collect()] == [("S", "sheet")]


def test_keys_that_meet_mean_the_sheet(spark, tmp_path):
    sheet = put(tmp_path / "s", "s.csv", "lead_id\nS\n")
    path = put(tmp_path / "c", "c.json", '{"lead_id":"A"}\n{"lead_id":"A","Lead ID":"B"}\n')
    rows = records.with_fallback(lambda: records.read_card(spark, path, CARD), lambda: records.read_sheet(spark, sheet))
    assert rows.first().source == "sheet"


def test_a_card_is_read_once(spark, tmp_path):
    path = put(tmp_path / "c", "c.json", '{"lead_id":"A"}\n')
    before = spark.sparkContext.statusTracker().getJobIdsForGroup(None)
    records.read_card(spark, path, CARD)  # no job to find a schema
    assert spark.sparkContext.statusTracker().getJobIdsForGroup(None) == before

"""Reporting chain, serving, work lists and upserts."""

from __future__ import annotations

from datetime import date

import pytest
from conftest import at

from leadsieve.operators import org
from leadsieve.plans import serve
from leadsieve.sources.schemas import MAPPING_FIELDS

SHEET = "seq BIGINT, `LRM Email` STRING, Name STRING, City STRING, `TL Email` STRING, DZSM STRING, Status STRING"
QUEUE = (
    "audit_date DATE, lead_id STRING, lrm_id STRING, lrm_email STRING, lrm_name STRING, cluster STRING, "
    "category STRING, lrm_category_rank INT, priority_key BIGINT, days_overdue BIGINT, created_at TIMESTAMP"
)


def sheet(spark, *rows):
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], SHEET)


def mapping(spark, *rows):
    fields = ["lrm_email", *MAPPING_FIELDS, "updated_by", "updated_at"]
    data = [(i, *[r.get(f, "") for f in fields]) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, "seq BIGINT, " + ", ".join(f"{f} STRING" for f in fields))


def queue(spark, *rows):
    default = {
        "audit_date": date(2026, 8, 3), "lrm_id": "u", "lrm_email": "a@example.com", "lrm_name": "", "cluster": "",
        "category": "mcch_past", "lrm_category_rank": 1, "priority_key": 0, "days_overdue": 0,
        "created_at": at("2026-07-01"),
    }
    names = [c.split()[0] for c in QUEUE.split(", ")]
    data = [tuple({**default, "lead_id": f"L{i}", **r}[n] for n in names) for i, r in enumerate(rows)]
    return spark.createDataFrame(data, QUEUE)


BASE = ("A@homes.example.com", "Ann B.", "Pune", " TL@Example.com ", "z@example.com", "")


def test_sheet_is_normalised_and_the_last_row_wins(spark):
    rows = org.hierarchy_from_sheet(
        sheet(
            spark,
            BASE,
            ("b@example.com", "Bo", "Pune", "tl@example.com", "", "inactive"),
            ("a@example.com", "Ann Again", "Goa", "tl2@example.com", "", "Active"),
            ("", "Nobody", "", "", "", ""),
        )
    ).collect()
    assert [(x.seq, x.lrm_email, x.lrm_name, x.cluster, x.tl_email, x.hr_status) for x in rows] == [
        (0, "a@example.com", "Ann Again", "Goa", "tl2@example.com", "Active")
    ]


def test_overrides_patch_add_and_remove(spark):
    chart = serve.build_hierarchy(
        sheet(spark, BASE, ("b@example.com", "Bo", "Pune", "tl@example.com", "", "")),
        mapping(
            spark,
            {"lrm_email": "a@example.com", "tl_email": "New@homes.example.com", "cluster": "X"},
            {"lrm_email": "A@example.com", "tl_email": "", "cluster": "Y\nZ "},
            {"lrm_email": "b@example.com", "hr_status": "Inactive"},
            {"lrm_email": "c@example.com", "tl_email": "tl@example.com"},
        ),
    )
    got = {x.lrm_email: (x.tl_email, x.cluster, x.lrm_name, x.overridden, x.added_in_app) for x in chart.collect()}
    assert got == {
        "a@example.com": ("new@example.com", "Y Z", "Ann B.", True, False),
        "c@example.com": ("tl@example.com", "", "", True, True),
    }


def test_serving(spark):
    chart = serve.build_hierarchy(sheet(spark, BASE))
    rows = queue(
        spark,
        {"audit_date": date(2026, 8, 2)},
        {"lrm_email": None, "lrm_name": "  ANN   b"},
        {"lrm_email": None, "lrm_name": "Zed", "cluster": ""},
        {"lrm_email": None, "lrm_name": "Zed", "cluster": "Goa", "lrm_category_rank": 2},
        {"lrm_email": "x@example.com", "lrm_name": "X"},
        *[{"priority_key": i, "lrm_category_rank": 20 - i} for i in range(14)],
    )
    served = serve.serve_queue(rows, chart)
    kept = served.queue.collect()
    assert len(kept) == 12 and {x.lrm_email for x in kept} == {"a@example.com"}
    assert sorted(x.priority_key for x in kept) == list(range(2, 14))
    by_name = served.in_org.filter("lrm_email_source = 'name'").collect()
    assert [x.lead_id for x in by_name] == ["L1"]
    lost = [(x.owner_key, x.lrm_email, x.cluster, x.leads) for x in served.unmapped.collect()]
    assert lost == [("name:Zed", "", "Goa", 2), ("x@example.com", "x@example.com", "", 1)]


def test_undated_queue_is_kept_whole(spark):
    rows = spark.createDataFrame([("", "A"), (None, "B")], "audit_date STRING, lead_id STRING")
    assert org.newest_day_only(rows).count() == 2
    mixed = spark.createDataFrame([("", "A"), ("2026-08-03T01:00", "B"), ("2026-08-02", "C")], rows.schema)
    assert [x.lead_id for x in org.newest_day_only(mixed).collect()] == ["B"]


def worklist(spark, **sizes):
    rows = []
    for category, n in sizes.items():
        for i in range(n):
            rows.append(
                {"lead_id": f"{category}{i}", "category": category, "priority_key": 100 - i,
                 "days_overdue": 0 if category == "mcch_future" else 50 - i}
            )
    return queue(spark, *rows).selectExpr("*", "'t@example.com' AS tl_email")


def test_pick_fills_up_from_the_most_overdue(spark):
    rows = worklist(spark, mcch_past=6, followup_missed=9, not_qualified=2, mcch_future=3)
    picked = org.tl_pick(rows).collect()
    assert len(picked) == 20
    first = [x for x in picked if x.pick_pass == 1]
    assert len(first) == 13
    more = org.tl_pick(worklist(spark, mcch_past=30, mcch_future=9)).collect()
    assert len(more) == 20
    assert sum(x.category == "mcch_past" for x in more) == 16 and sum(x.category == "mcch_future" for x in more) == 4


def test_full_first_pass_leaves_nothing_to_fill(spark):
    rows = worklist(
        spark, mcch_past=9, followup_missed=9, not_qualified=9, mcch_future=9, not_interested=9
    )
    picked = org.tl_pick(rows).collect()
    assert len(picked) == 20 and {x.pick_pass for x in picked} == {1}


def patches(spark, *rows):
    names = ["lrm_email", "clear", *MAPPING_FIELDS]
    data = [(i, *[r.get(n) for n in names]) for i, r in enumerate(rows)]
    kinds = ", ".join(f"{f} STRING" for f in MAPPING_FIELDS)
    return spark.createDataFrame(data, f"seq BIGINT, lrm_email STRING, clear BOOLEAN, {kinds}")


def test_mapping_upsert(spark):
    current = org.mapping_latest(
        mapping(
            spark,
            {"lrm_email": "a@example.com", "tl_email": "t@example.com", "cluster": "X", "updated_by": "old"},
            {"lrm_email": "b@example.com", "cluster": "B", "updated_by": "old"},
            {"lrm_email": "c@example.com", "cluster": "C", "updated_by": "old"},
            {"lrm_email": "d@example.com", "cluster": "D", "updated_by": "old"},
        )
    )
    asked = patches(
        spark,
        {"lrm_email": "A@example.com", "cluster": ""},
        {"lrm_email": "a@example.com", "tl_name": "Tee"},
        {"lrm_email": "b@example.com", "cluster": ""},
        {"lrm_email": "c@example.com", "tl_name": "lost"},
        {"lrm_email": "c@example.com", "clear": True},
        {"lrm_email": "c@example.com", "tl_name": "after"},
        {"lrm_email": "nobody", "tl_name": "refused"},
        {"lrm_email": "new@example.com", "zsm_email": "Z@homes.example.com"},
    )
    rows = org.mapping_upsert(current, asked, "me@example.com", "now").collect()
    got = {x.lrm_email: (x.tl_email, x.tl_name, x.cluster, x.zsm_email, x.updated_by) for x in rows}
    assert list(got) == ["a@example.com", "c@example.com", "d@example.com", "new@example.com"]
    assert got == {
        "a@example.com": ("t@example.com", "Tee", "", "", "me@example.com"),
        "c@example.com": ("", "after", "", "", "me@example.com"),
        "d@example.com": ("", "", "D", "", "old"),
        "new@example.com": ("", "", "", "z@example.com", "me@example.com"),
    }


@pytest.mark.parametrize("hot", [2000])
def test_one_team_lead_with_most_rows(spark, hot):
    rows = queue(
        spark,
        *[
            {"lead_id": f"L{i:05d}", "category": ["mcch_past", "not_qualified"][i % 2], "priority_key": i, "days_overdue": i}
            for i in range(hot)
        ],
    ).selectExpr("*", "'t@example.com' AS tl_email")
    picked = {x.lead_id for x in org.tl_pick(rows).collect()}
    assert picked == {f"L{i:05d}" for i in range(hot - 20, hot)}

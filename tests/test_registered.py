"""Every registered query against its SQL on the smallest data set, and the queue's invariants."""

from __future__ import annotations

import pytest

import __spark_entry__ as entry
from checks.compare import difference
from checks.registry import oracle_sql, queries
from leadsieve.operators.rules import CATEGORIES, CURRENT

NAMES = sorted(queries())


def test_every_query_has_its_sql():
    assert set(oracle_sql()) == set(NAMES)


@pytest.mark.parametrize("name", NAMES)
def test_rows_agree(spark, sf_dir, name):
    _, problem = difference(entry.queries()[name](spark, sf_dir), sf_dir, entry.oracle_sql()[name])
    assert problem == ""


def test_queue_invariants(spark, sf_dir):
    rows = entry.queries()["audit_queue"](spark, sf_dir).collect()
    assert len({x.lead_id for x in rows}) == len(rows)
    assert {x.category for x in rows} <= set(CATEGORIES)
    assert not {(x.lead_stage or "").strip().lower() for x in rows} & set(CURRENT.blocked)
    groups: dict = {}
    for x in rows:
        groups.setdefault((x.lrm_id, x.category), []).append(x.lrm_category_rank)
    for ranks in groups.values():
        assert sorted(ranks) == list(range(1, len(ranks) + 1)) and len(ranks) <= 20


def test_entry(spark):
    assert entry.entry(spark).count() > 0

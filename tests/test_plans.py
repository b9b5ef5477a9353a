"""What the plans must look like, and that the ways beyond the broadcast limit agree."""

from __future__ import annotations

import re

import pytest

import __spark_entry__ as entry
from checks import crm_views as crm
from checks.compare import difference
from leadsieve.operators import population
from leadsieve.operators import rules as r
from leadsieve.operators.calls import call_stats
from leadsieve.operators.history import history_facts
from leadsieve.plans import queue as plan
from leadsieve.sources import tables


def explained(df) -> str:
    return df._jdf.queryExecution().explainString(
        df.sparkSession._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    )


@pytest.fixture(scope="module")
def stored(spark, sf_dir, tmp_path_factory):
    root = str(tmp_path_factory.mktemp("crm"))
    made = crm.crm_tables(spark, sf_dir)
    for name, df in (
        ("lead", made.lead), ("lead_history", made.history), ("call_log", made.call_log), ("geo", made.geo),
        ("users", made.users),
    ):
        df.write.parquet(f"{root}/{name}")
    return tables.read_tables(spark, root)


def test_population_filter_reaches_the_scan(stored):
    text = explained(population.open_funnel(stored.lead, crm.CLOCK, r.CURRENT).select("lead_id"))
    pushed = next(line for line in text.splitlines() if "PushedFilters" in line)
    for part in ("GreaterThanOrEqual(created_at", "GreaterThanOrEqual(updated_at", "EqualTo(is_delete,0)", "In(status"):
        assert part in pushed
    schema = next(line for line in text.splitlines() if "ReadSchema" in line)
    assert "customer_phone_number" not in schema and "reschedule" not in schema


def test_dial_bound_reaches_the_scan(stored):
    text = explained(call_stats(plan.scoped_leads(stored, crm.CLOCK), stored.call_log, crm.CLOCK))
    assert "GreaterThanOrEqual(created_at,2024-01-01)" in text


def test_history_is_read_once(spark, sf_dir, stored):
    base = plan.scoped_leads(stored, crm.CLOCK)
    text = explained(history_facts(stored.history, base.select("lead_id"), r.CURRENT))
    head = text[: text.index("\n(1)")]
    assert text.count("meeting_schedule_date:timestamp") == 1
    # one for the facts, one for the filter of the ids
    assert len(re.findall(r"^.*\bExchange\b", head, re.M)) == 2


def test_queue_plan(stored):
    text = explained(plan.build_queue(stored, crm.CLOCK, sort=False))
    assert text.count("WindowGroupLimit") >= 2
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text
    assert "Python" not in text


def test_time_line_is_shuffled_once(stored):
    stats = call_stats(plan.scoped_leads(stored, crm.CLOCK), stored.call_log, crm.CLOCK)
    stats.collect()
    text = explained(stats)
    final = text[: text.index("Initial Plan")] if "Initial Plan" in text else text
    assert "ReusedExchange" in final
    # one reading of the dials in the plan that ran
    assert len(re.findall(r"Location: .*call_log", text[text.index("\n(1)") :])) <= 3


BIG_PATH = ("audit_queue", "place_and_names", "join_calls", "semi_base", "name_fallback", "tl_pick", "scope_queue", "rules_v1", "serve_from_files", "review_from_files")


@pytest.mark.parametrize("name", BIG_PATH)
def test_without_any_broadcast(spark, sf_dir, name):
    """Nothing fits: every lookup is shuffled."""
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        _, problem = difference(entry.queries()[name](spark, sf_dir), sf_dir, entry.oracle_sql()[name])
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert problem == ""


def scans(df) -> int:
    text = explained(df)
    return len(re.findall(r"^.*\bScan parquet\b", text[: text.index("\n(1)")], re.M))


@pytest.mark.parametrize("name", ["distinct_counts", "pull_verdict", "scope_payload"])
def test_metrics_read_kept_tables(spark, sf_dir, name):
    assert scans(entry.queries()[name](spark, sf_dir)) <= 10


def test_lead_and_history_are_read_once_by_a_queue_and_by_two_rule_sets(stored):
    """The open leads are stored once, before the plan below; what it reads is that table."""
    for df in (plan.build_queue(stored, crm.CLOCK, sort=False), plan.rule_migration(stored, crm.CLOCK, r.V6, r.V7_8)):
        text = explained(df)
        places = re.findall(r"Location: InMemoryFileIndex ?\[(\S+?)\]", text)
        assert sum(x.endswith("/lead") for x in places) == 0
        assert sum(x.endswith("/lead_history") for x in places) == 1


def test_two_rule_sets_over_one_row_are_the_two_queues(stored):
    for before, after in ((r.V6, r.V7_8), (r.V1, r.V3), (r.V2, r.V7_4)):
        both = plan.categories_by_set(stored, crm.CLOCK, [before, after])
        for i, rules in enumerate((before, after)):
            alone = plan.flagged_leads(stored, crm.CLOCK, rules).select("lead_id", "category")
            joint = both.filter(f"c{i} IS NOT NULL").select("lead_id", f"c{i}")
            assert sorted(map(tuple, joint.collect())) == sorted(map(tuple, alone.collect()))

"""The daily audit queue: which leads stalled, who owns them, how urgent they are."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.config import DEFAULT_ALIAS, Clock, MailAlias
from leadsieve.operators import enrich
from leadsieve.operators.calls import call_stats, manual_dials_today
from leadsieve.operators.history import history_facts, history_facts_of_all
from leadsieve.operators.population import is_open, open_funnel
from leadsieve.operators.rules import CURRENT, RuleSet, category
from leadsieve.operators.skew import ordering, rank_in_group, top_in_group
from leadsieve.session import written
from leadsieve.sources.schemas import LEAD

RANK = "lrm_category_rank"


@dataclass(frozen=True)
class CrmTables:
    """The five base tables, typed as in `leadsieve.sources.schemas`."""

    lead: DataFrame
    history: DataFrame
    call_log: DataFrame
    geo: DataFrame
    users: DataFrame


def scoped_leads(tables: CrmTables, clock: Clock, rules: RuleSet = CURRENT) -> DataFrame:
    return open_funnel(tables.lead, clock, rules)


def stored_scope(leads: DataFrame) -> DataFrame:
    """Open leads with the columns of the lead schema, written once.

    Ids, phones, assignment times and the wide row are all read from it, so the lead table is scanned
    and filtered a single time.
    """
    return written(leads.select(*[c for c in leads.columns if c in LEAD.names or c.startswith("_")]), "scope")


def audited_facts(
    tables: CrmTables, clock: Clock, rules: RuleSet = CURRENT, keep_dials: Column | None = None
) -> DataFrame:
    """Every lead in scope, its facts, silence and stage flags; blocked stages are gone.

    Leads and history meet on lead_id once. The blocklist runs before the dial totals join.
    """
    base = stored_scope(scoped_leads(tables, clock, rules))
    history = history_facts(tables.history, base.select("lead_id"), rules)
    facts = enrich.not_blocked(enrich.lead_facts(base, history, rules), rules)
    stats = None
    if rules.uses_calls:
        stats = call_stats(
            base,
            tables.call_log,
            clock,
            days=rules.call_days,
            since_assignment=rules.calls_since_assignment,
            keep=keep_dials,
        )
    if rules.attempt_from_manual_dials:
        dialled = manual_dials_today(base, tables.call_log, clock).withColumn("_dialled", F.lit(True))
        facts = facts.join(dialled, "lead_id", "left").withColumn(
            "attempt_today", F.coalesce("_dialled", F.lit(False))
        )
    facts = enrich.with_calls(facts, stats)
    return enrich.with_stage_flags(enrich.with_silence(facts, rules, clock), rules)


def flagged_leads(
    tables: CrmTables, clock: Clock, rules: RuleSet = CURRENT, keep_dials: Column | None = None
) -> DataFrame:
    return enrich.categorised(audited_facts(tables, clock, rules, keep_dials), rules, clock)


def ranked(flagged: DataFrame, rules: RuleSet = CURRENT) -> DataFrame:
    if rules.top is not None:
        return top_in_group(flagged, rules.rank_group, rules.rank_order, rules.top, RANK)
    return all_ranks(flagged, rules)


def all_ranks(flagged: DataFrame, rules: RuleSet = CURRENT) -> DataFrame:
    """Ranks of every flagged lead, which are stored first because ranking reads them twice."""
    return rank_in_group(written(flagged, "flagged"), rules.rank_group, rules.rank_order, RANK)


def project(rows: DataFrame, rules: RuleSet, clock: Clock) -> DataFrame:
    made = {
        "audit_date": clock.today_col(),
        "lead_stage": F.col("current_stage"),
        "lead_status": F.col("current_status"),
        "lead_table_status": F.col("current_status"),
        "stage_changed_at_audit": F.col("current_stage_at"),
        "priority_key": F.col("rank_key"),
        "days_silent": F.col("quiet_days"),
        "days_overdue": F.col("overdue_days"),
        "crm_touch_at": F.col("crm_updated_at"),
        "category_rank": F.col(RANK),
    }
    if not rules.customer_named:
        made["customer_name"] = F.lit(None).cast("string")
    new_names = dict(rules.renamed)
    return rows.select(*[made.get(c, F.col(c)).alias(new_names.get(c, c)) for c in rules.columns])


def build_queue(
    tables: CrmTables,
    clock: Clock,
    rules: RuleSet = CURRENT,
    *,
    alias: MailAlias = DEFAULT_ALIAS,
    keep_dials: Column | None = None,
    sort: bool = True,
) -> DataFrame:
    """The queue of one day under one rule set. The open leads are stored when this is called (and,
    under the first rule set, which has no cut, the flagged ones); the rest runs when it is written.

    Owner and place are only shown, never tested, so they are looked up after the cut to the
    top rows of each owner and category.
    """
    top = ranked(flagged_leads(tables, clock, rules, keep_dials), rules)
    shown = enrich.with_owner(enrich.with_geo(top, tables.geo, rules), tables.users, alias)
    queue = project(shown, rules, clock)
    return final_sort(queue) if sort else queue


def output_order(queue: DataFrame) -> list[tuple[str, str]]:
    if "lrm_email" in queue.columns:
        return [("lrm_email", "asc_nulls_last"), ("category", "asc"), (RANK, "asc"), ("lead_id", "asc")]
    return [("category", "asc"), ("category_rank", "asc"), ("lead_id", "asc")]


def final_sort(queue: DataFrame) -> DataFrame:
    return queue.orderBy(*ordering(output_order(queue)))


def final_places(queue: DataFrame) -> DataFrame:
    """The rows of a stored queue in output order, with `place` from 1: sorted by range, numbered by offsets."""
    return rank_in_group(queue, [], output_order(queue), "place").orderBy("place")


def categories_by_set(tables: CrmTables, clock: Clock, sets: Sequence[RuleSet]) -> DataFrame:
    """(lead_id, c0, c1, ...): each lead's category under each rule set, NULL where it is in no queue.

    One pass for all sets: the lead table is filtered by any of their scopes and stored, the history
    is aggregated once, dials once for each way of counting them, and then every rule set reads the
    same row.
    """
    scopes = [is_open(clock, rules) for rules in sets]
    marks = {f"_open{i}": F.coalesce(scope, F.lit(False)) for i, scope in enumerate(scopes)}
    base = stored_scope(tables.lead.filter(reduce(or_, scopes)).withColumns(marks))
    wide = base.join(history_facts_of_all(tables.history, base.select("lead_id"), sets), "lead_id", "left")
    ways = list(dict.fromkeys((x.call_days, x.calls_since_assignment) for x in sets if x.uses_calls))
    for n, (days, since) in enumerate(ways):
        stats = call_stats(base, tables.call_log, clock, days=days, since_assignment=since)
        wide = wide.join(stats.select("lead_id", F.struct("last_call_at", "calls_30d", "connects_30d").alias(f"_calls{n}")), "lead_id", "left")
    if any(x.attempt_from_manual_dials for x in sets):
        dialled = manual_dials_today(base, tables.call_log, clock).withColumn("_dialled", F.lit(True))
        wide = wide.join(dialled, "lead_id", "left")
    rows = wide.select(F.struct("*").alias("_w"))
    done: list[str] = []
    for i, rules in enumerate(sets):
        view = rows.select("_w", *done, *[F.col(f"_w.{c}") for c in base.columns], f"_w.f{i}.*")
        carry = ["_w", *done, f"_open{i}"]
        if rules.uses_calls:
            n = ways.index((rules.call_days, rules.calls_since_assignment))
            view = view.select("*", f"_w._calls{n}.*")
            facts = enrich.facts_row(view, rules, [*carry, "last_call_at"])
        else:
            facts = enrich.with_calls(enrich.facts_row(view, rules, carry), None)
        if rules.attempt_from_manual_dials:
            facts = facts.withColumn("attempt_today", F.coalesce("_w._dialled", F.lit(False)))
        facts = enrich.with_stage_flags(enrich.with_silence(facts, rules, clock), rules)
        queued = F.col(f"_open{i}") & ~F.col("stage_lc").isin(rules.blocked) if rules.blocked else F.col(f"_open{i}")
        rows = facts.select("_w", *done, F.when(queued, category(rules, clock)).alias(f"c{i}"))
        done.append(f"c{i}")
    return rows.select(F.col("_w.lead_id").alias("lead_id"), *done)


def rule_migration(tables: CrmTables, clock: Clock, before: RuleSet, after: RuleSet) -> DataFrame:
    """How many leads move from one category to another between two rule sets."""
    out = F.lit("(none)")
    return (
        categories_by_set(tables, clock, [before, after])
        .filter(F.col("c0").isNotNull() | F.col("c1").isNotNull())
        .groupBy(F.coalesce("c0", out).alias("old_category"), F.coalesce("c1", out).alias("new_category"))
        .agg(F.count(F.lit(1)).alias("leads"))
    )

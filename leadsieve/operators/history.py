"""Per-lead facts from the stage history, in one pass over it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.functions.text import matches_any, null_to_blank
from leadsieve.operators.skew import prefilter

MILESTONES = ("meeting_confirmed_datetime", "meeting_schedule_date", "meeting_done_date")


def newest(*fields: str) -> Column:
    """Fields of the newest event; missing times are oldest and the event id breaks ties."""
    return F.max_by(F.struct(*fields), F.struct("created_at", "event_id"))


def latest_stage(history: DataFrame) -> DataFrame:
    return (
        history.groupBy("lead_id")
        .agg(newest("stage", "created_at").alias("n"))
        .select("lead_id", F.col("n.stage").alias("audit_stage"), F.col("n.created_at").alias("audit_stage_at"))
    )


def closing_times(rules) -> dict[str, Column]:
    """When the lead last became not interested / not qualified, by the event's own stage."""
    return {
        "ni_at": F.max(F.when(matches_any(F.col("stage"), rules.ni_patterns), F.col("created_at"))),
        "nq_at": F.max(F.when(matches_any(F.col("stage"), rules.nq_patterns), F.col("created_at"))),
    }


def milestone_maxima() -> dict[str, Column]:
    """Largest value per date: events are sparse, so the newest row alone would lose them."""
    return {"last_stage_at": F.max("created_at"), **{m: F.max(m) for m in MILESTONES}}


def event_counts(rules) -> dict[str, Column]:
    stage = null_to_blank(F.col("stage"))
    turn = matches_any(F.col("stage"), rules.loop_patterns)
    if rules.loop_status_patterns:
        turn = turn | matches_any(F.col("status"), rules.loop_status_patterns)
    if rules.confirmed_is_prefix:
        confirmed = stage.ilike("meeting confirmed%")
    else:
        confirmed = stage == "Meeting Confirmed - Customer Home"
    return {
        "loop_turns": F.count_if(turn),
        "mcch_events": F.count_if(confirmed),
        "dev_events": F.count_if(stage == "DEV Scheduled"),
        "md_events": F.count_if(stage.ilike("meeting done%")),
    }


def _named(measures: dict[str, Column], suffix: str = "") -> list[Column]:
    return [c.alias(f"{name}{suffix}") for name, c in measures.items()]


def closing_dates(history: DataFrame, rules) -> DataFrame:
    return history.groupBy("lead_id").agg(*_named(closing_times(rules)))


def milestones(history: DataFrame) -> DataFrame:
    return history.groupBy("lead_id").agg(*_named(milestone_maxima()))


def loop_counts(history: DataFrame, rules) -> DataFrame:
    return history.groupBy("lead_id").agg(*_named(event_counts(rules)))


def _measures(rules) -> dict[str, Column]:
    """What a rule set needs of a lead's events; `n` holds fields of the newest."""
    if rules.milestones_from_newest:
        # these rule sets put a missing time first
        order = F.struct(F.col("created_at").isNull(), "created_at", "event_id")
        return {"n": F.max_by(F.struct("created_at", *MILESTONES), order), **event_counts(rules)}
    return {"n": newest("stage", "created_at"), **milestone_maxima(), **closing_times(rules), **event_counts(rules)}


def _facts(rules, suffix: str = "") -> dict[str, Column]:
    """The named facts of a rule set over its aggregated measures."""
    n, plain = F.col(f"n{suffix}"), [x for x in _measures(rules) if x != "n"]
    kept = {x: F.col(f"{x}{suffix}") for x in plain}
    if rules.milestones_from_newest:
        return {"last_stage_at": n["created_at"], **{m: n[m] for m in MILESTONES}, **kept}
    return {**kept, "audit_stage": n["stage"], "audit_stage_at": n["created_at"]}


def history_facts(history: DataFrame, lead_ids: DataFrame, rules) -> DataFrame:
    """Newest stage, milestones, closing dates and counts: one scan and one shuffle.

    Events of other leads are dropped where they are read, but for a few that a join with the leads
    drops. The grouping combines map-side, so a lead with very many events ships one partial row per
    map task, however many leads there are. Only the columns the rule set reads are kept.
    """
    found = prefilter(history, lead_ids, "lead_id").groupBy("lead_id").agg(*_named(_measures(rules)))
    return found.select("lead_id", *[c.alias(name) for name, c in _facts(rules).items()])


def history_facts_of_all(history: DataFrame, lead_ids: DataFrame, sets: Sequence) -> DataFrame:
    """(lead_id, f0, f1, ...): the facts of several rule sets, a struct each, from one pass.

    Measures that rule sets share are computed once.
    """
    grouped = prefilter(history, lead_ids, "lead_id").groupBy("lead_id")
    found = grouped.agg(*[c for i, rules in enumerate(sets) for c in _named(_measures(rules), f"__{i}")])
    structs = [F.struct(*[c.alias(name) for name, c in _facts(rules, f"__{i}").items()]).alias(f"f{i}") for i, rules in enumerate(sets)]
    return found.select("lead_id", *structs)

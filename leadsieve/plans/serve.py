"""What the review application is served: the scoped, mapped and trimmed queue."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from leadsieve.config import DEFAULT_ALIAS, MailAlias
from leadsieve.operators import org
from leadsieve.session import written


@dataclass(frozen=True)
class Served:
    """Every stage of the pull, so that a diagnosis reads what the application reads."""

    all_rows: DataFrame
    in_org: DataFrame
    queue: DataFrame
    hierarchy: DataFrame
    unmapped: DataFrame


def build_hierarchy(
    sheet: DataFrame, mapping_rows: DataFrame | None = None, alias: MailAlias = DEFAULT_ALIAS
) -> DataFrame:
    base = org.hierarchy_from_sheet(sheet, alias)
    if mapping_rows is None:
        return org.without_overrides(base)
    return org.apply_overrides(base, org.mapping_latest(mapping_rows, alias))


def serve_queue(queue: DataFrame, hierarchy: DataFrame, per_owner: int = org.PER_LRM_CATEGORY) -> Served:
    """Newest day, owner address by name where blank, mapped owners only, trimmed per owner."""
    rows = org.name_fallback(org.newest_day_only(queue), hierarchy)
    kept = org.in_org(rows, hierarchy)
    return Served(
        all_rows=rows,
        in_org=kept,
        queue=org.trim_per_owner(kept, per_owner),
        hierarchy=hierarchy,
        unmapped=org.unmapped_owners(rows, hierarchy),
    )


def kept(served: Served) -> Served:
    """Every stage of the day's pull as a stored table, each computed once.

    What is asked of a pull afterwards, its counts, each viewer's payload, the lists only admins get,
    reads these tables instead of deriving chart and queue again.
    """
    hierarchy = written(served.hierarchy, "chart")
    rows = written(served.all_rows, "pull")
    scoped = org.in_org(rows, hierarchy)
    return Served(
        all_rows=rows,
        in_org=scoped,
        queue=written(org.trim_per_owner(scoped), "served"),
        hierarchy=hierarchy,
        unmapped=written(org.unmapped_owners(rows, hierarchy), "unmapped"),
    )


def team_worklists(served: Served) -> DataFrame:
    return org.tl_pick(org.with_hierarchy(served.queue, served.hierarchy, ["tl_email", "tl_name"]))

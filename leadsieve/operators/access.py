"""Who may see what: roles, visible team leads and the visible part of the queue."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.config import DEFAULT_ALIAS, MailAlias
from leadsieve.functions.text import mail_key, null_to_blank, one_line
from leadsieve.operators.skew import lookup_join
from leadsieve.sources.schemas import ACCESS_COLUMNS, ACCESS_ROLES

NOTE = 300
LINES = {"tl": "tl_email", "zsm": "zsm_email", "ados": "ados_email"}


def access_latest(rows: DataFrame, alias: MailAlias = DEFAULT_ALIAS) -> DataFrame:
    """The last row of each address, taken whole."""
    cells = rows.select(
        "seq",
        mail_key(F.col("email"), alias).alias("email"),
        F.lower(null_to_blank(F.col("role"))).alias("role"),
        *[null_to_blank(F.col(c)).alias(c) for c in ACCESS_COLUMNS[2:]],
    ).filter(F.col("email") != "")
    return cells.groupBy("email").agg(F.max_by(F.struct(*ACCESS_COLUMNS[1:]), "seq").alias("r")).select("email", "r.*")


def access_upsert(
    current: DataFrame, items: DataFrame, by: str, at: str, alias: MailAlias = DEFAULT_ALIAS
) -> DataFrame:
    """Set or clear (blank role) access per address and return the new table, sorted.

    Unknown roles and addresses without an at-sign are refused. The last item of an address
    wins. `current` has one row per address, as from `access_latest`.
    """
    asked = items.select(
        "seq",
        mail_key(F.col("email"), alias).alias("email"),
        F.lower(null_to_blank(F.col("role"))).alias("role"),
        one_line(F.col("scope"), NOTE).alias("scope"),
        one_line(F.col("note"), NOTE).alias("note"),
    ).filter(F.col("email").contains("@") & F.col("role").isin("", *ACCESS_ROLES))
    last = (
        asked.groupBy("email")
        .agg(F.max_by(F.struct("role", "scope", "note"), "seq").alias("r"))
        .select("email", "r.*", F.lit(by).alias("updated_by"), F.lit(at).alias("updated_at"))
    )
    kept = current.select(*ACCESS_COLUMNS).join(last.select("email"), "email", "left_anti")
    return kept.unionByName(last.filter(F.col("role") != "")).orderBy("email")


def plain_mail(address: str, alias: MailAlias) -> str:
    """`mail_key` of a configured address."""
    return address.strip().lower().replace(f"@{alias.alias}", f"@{alias.main}", 1)


def reporting_lines(hierarchy: DataFrame) -> DataFrame:
    """(line, viewer_email, tl_email): who leads a row as tl, zsm or ados, and its team lead."""
    held = [F.struct(F.lit(line).alias("line"), F.col(c).alias("viewer_email")) for line, c in LINES.items()]
    rows = hierarchy.select(F.explode(F.array(*held)).alias("h"), "tl_email")
    return rows.select("h.line", "h.viewer_email", "tl_email")


def resolve_roles(
    viewers: DataFrame,
    hierarchy: DataFrame,
    overrides: DataFrame,
    admins: Sequence[str] = (),
    alias: MailAlias = DEFAULT_ALIAS,
) -> DataFrame:
    """(viewer_email, role, override_role) of each viewer.

    An override decides first, and `none` blocks; then the chart, from team lead upwards.
    """
    people = viewers.select(mail_key(F.col("viewer_email"), alias).alias("viewer_email")).distinct()
    given = overrides.select(F.col("email").alias("viewer_email"), F.col("role").alias("override_role"))
    out = people.join(given, "viewer_email", "left")
    held = reporting_lines(hierarchy).groupBy("viewer_email").agg(
        *[F.bool_or(F.col("line") == name).alias(f"_{name}") for name in LINES]
    )
    out = lookup_join(out, held, "viewer_email")
    given_role = F.col("override_role")
    role = F.when(given_role == "none", "blocked").when(
        F.col("viewer_email").isin(*[plain_mail(a, alias) for a in admins]) | (given_role == "admin"), "admin"
    )
    for name in ("auditor", "zsm", "ados", "tl"):
        role = role.when(given_role == name, name)
    for name in LINES:
        role = role.when(F.col(f"_{name}"), name)
    return out.select(
        "viewer_email", role.otherwise("none").alias("role"), null_to_blank(given_role).alias("override_role")
    )


def team_grants(roles: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(viewer_email, tl_email): the team leads whose teams a limited viewer sees."""
    own = roles.filter(F.col("role") == "tl").select("viewer_email", F.col("viewer_email").alias("tl_email"))
    above = reporting_lines(hierarchy).filter(F.col("line") != "tl").withColumnRenamed("line", "role").distinct()
    managed = roles.join(above, ["viewer_email", "role"]).select("viewer_email", "tl_email")
    return own.unionByName(managed)


def visibility(roles: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Roles with `see_all` and the number of team leads a limited viewer sees.

    Admins and auditors see everything. So does a zsm or ados by override who has no
    reporting lines: the grant would mean nothing otherwise.
    """
    counts = team_grants(roles, hierarchy).groupBy("viewer_email").agg(F.count(F.lit(1)).alias("team_leads"))
    joined = roles.join(counts, "viewer_email", "left").withColumn(
        "team_leads", F.coalesce("team_leads", F.lit(0)).cast("bigint")
    )
    lineless = F.col("override_role").isin("zsm", "ados") & F.col("role").isin("zsm", "ados")
    see_all = F.col("role").isin("admin", "auditor") | (lineless & (F.col("team_leads") == 0))
    return joined.withColumn("see_all", see_all)


def visible_owners(grants: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """(viewer_email, lrm_email) pairs: as many as the chart has reporting lines."""
    return grants.join(hierarchy.select("tl_email", "lrm_email"), "tl_email").select("viewer_email", "lrm_email").distinct()


def scope_queue(queue: DataFrame, hierarchy: DataFrame, grants: DataFrame) -> DataFrame:
    """Queue rows of every limited viewer. Viewers who see everything read the queue itself."""
    return lookup_join(queue, visible_owners(grants, hierarchy), "lrm_email", how="inner")


def scope_payload(
    queue: DataFrame,
    hierarchy: DataFrame,
    unmapped: DataFrame,
    roles: DataFrame,
    mapping: DataFrame,
    overrides: DataFrame,
) -> DataFrame:
    """What each viewer is served: rows of queue and chart, and the lists only admins get.

    Pass kept tables (`serve.kept`): queue and chart are each read more than once.
    """
    shown = visibility(roles, hierarchy)
    grants = team_grants(roles, hierarchy)
    per_owner = queue.groupBy("lrm_email").agg(F.count(F.lit(1)).alias("rows"))
    limited = (
        visible_owners(grants, hierarchy)
        .join(per_owner, "lrm_email", "left")
        .groupBy("viewer_email")
        .agg(F.sum("rows").alias("own_rows"), F.count(F.lit(1)).alias("own_reps"))
    )
    zero = F.lit(0).cast("bigint")
    admin = F.col("role") == "admin"
    # one row of totals: each list says what it is, and one aggregate counts them all
    lists = {"queue": queue, "chart": hierarchy, "unmapped": unmapped, "mapping": mapping, "auditors": overrides.filter(F.col("role") == "auditor")}
    tagged = reduce(DataFrame.unionByName, [df.select(F.lit(name).alias("list")) for name, df in lists.items()])
    totals = tagged.agg(F.struct(*[F.count_if(F.col("list") == name).alias(name) for name in lists]).alias("t")).scalar()

    return shown.join(limited, "viewer_email", "left").select(
        "viewer_email",
        "role",
        "override_role",
        "see_all",
        F.when(F.col("see_all"), totals["queue"]).otherwise(F.coalesce("own_rows", zero)).alias("queue_rows"),
        F.when(F.col("see_all"), totals["chart"]).otherwise(F.coalesce("own_reps", zero)).alias("hierarchy_rows"),
        F.when(admin, totals["unmapped"]).otherwise(zero).alias("unmapped_rows"),
        F.when(admin, totals["mapping"]).otherwise(zero).alias("mapping_rows"),
        totals["auditors"].alias("auditors"),
        F.when(F.col("role") == "tl", F.col("viewer_email")).otherwise("").alias("me_email"),
    )

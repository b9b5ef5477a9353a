"""The reporting chain: building it, patching it, and joining the queue to it."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from leadsieve.config import DEFAULT_ALIAS, MailAlias
from leadsieve.functions.text import blank_to_null, mail_key, name_key, null_to_blank, one_line_trimmed
from leadsieve.operators.skew import lookup_join, top_in_group
from leadsieve.sources.records import alias_columns
from leadsieve.sources.schemas import HIERARCHY_HEADERS, MAPPING_FIELDS, MAPPING_MAIL_FIELDS

PER_LRM_CATEGORY = 12
UNMAPPED_LIMIT = 400
PICK_PER_CATEGORY = 4
PICK_PER_TL = 20
CELL = 200


def active(rows: DataFrame) -> DataFrame:
    """Rows with an address whose status is not inactive; a blank status counts as active."""
    return rows.filter((F.col("lrm_email") != "") & (F.lower("hr_status") != "inactive"))


def hierarchy_from_sheet(sheet: DataFrame, alias: MailAlias = DEFAULT_ALIAS) -> DataFrame:
    """Sheet rows as one active record per rep. `seq` is the row's place in the sheet: the
    last row of an address gives the record, the first gives its place."""
    rows = alias_columns(sheet, HIERARCHY_HEADERS)
    for name in ("lrm_email", *MAPPING_MAIL_FIELDS):
        rows = rows.withColumn(name, mail_key(F.col(name), alias))
    rows = active(rows.withColumn("hr_status", F.coalesce(blank_to_null(F.col("hr_status")), F.lit("Active"))))
    fields = [c for c in HIERARCHY_HEADERS if c != "lrm_email"]
    return (
        rows.groupBy("lrm_email")
        .agg(F.max_by(F.struct(*fields), "seq").alias("r"), F.min("seq").alias("seq"))
        .select("seq", "lrm_email", "r.*")
    )


def mapping_cell(name: str, alias: MailAlias) -> Column:
    cell = F.col(name)
    return mail_key(cell, alias) if name in MAPPING_MAIL_FIELDS else one_line_trimmed(cell, CELL)


def mapping_latest(rows: DataFrame, alias: MailAlias = DEFAULT_ALIAS) -> DataFrame:
    """Per address and field the last non-blank value; who and when come from the last row."""
    cells = rows.select(
        "seq",
        mail_key(F.col("lrm_email"), alias).alias("lrm_email"),
        *[blank_to_null(mapping_cell(f, alias)).alias(f) for f in MAPPING_FIELDS],
        null_to_blank(F.col("updated_by")).alias("updated_by"),
        null_to_blank(F.col("updated_at")).alias("updated_at"),
    ).filter(F.col("lrm_email") != "")
    return (
        cells.groupBy("lrm_email")
        .agg(
            *[F.max_by(f, F.when(F.col(f).isNotNull(), F.col("seq"))).alias(f) for f in MAPPING_FIELDS],
            F.max_by(F.struct("updated_by", "updated_at"), "seq").alias("u"),
            F.min("seq").alias("seq"),
        )
        .select("seq", "lrm_email", *[null_to_blank(F.col(f)).alias(f) for f in MAPPING_FIELDS], "u.*")
    )


def apply_overrides(hierarchy: DataFrame, overrides: DataFrame) -> DataFrame:
    """Patch reporting lines field by field. A rep known only to the overrides is added."""
    base = hierarchy.select(
        F.col("seq").alias("_seq"), "lrm_email", "sseid", *[F.col(f).alias(f"_{f}") for f in MAPPING_FIELDS]
    )
    patch = overrides.select(F.col("seq").alias("_patch"), "lrm_email", *MAPPING_FIELDS)
    both = base.join(patch, "lrm_email", "full_outer")
    added = F.col("_seq").isNull()
    patched = {f: F.coalesce(blank_to_null(F.col(f)), F.col(f"_{f}"), F.lit("")) for f in MAPPING_FIELDS}
    patched["hr_status"] = F.coalesce(blank_to_null(F.col("hr_status")), F.col("_hr_status"), F.lit("Active"))
    return active(
        both.select(
            F.coalesce("_seq", "_patch").alias("seq"),
            "lrm_email",
            null_to_blank(F.col("sseid")).alias("sseid"),
            *[patched[f].alias(f) for f in MAPPING_FIELDS],
            F.col("_patch").isNotNull().alias("overridden"),
            added.alias("added_in_app"),
        )
    )


def without_overrides(hierarchy: DataFrame) -> DataFrame:
    return hierarchy.withColumns({"overridden": F.lit(False), "added_in_app": F.lit(False)})


def name_fallback(queue: DataFrame, hierarchy: DataFrame) -> DataFrame:
    """Fill a blank owner address from the hierarchy by loose name; the first such rep wins.

    Only rows without an address and with a name are joined; the others, nearly the whole queue, stay
    where they are instead of meeting under one NULL key.
    """
    by_name = (
        hierarchy.withColumn("_name", name_key(F.col("lrm_name")))
        .filter(F.col("_name") != "")
        .groupBy("_name")
        .agg(F.min_by("lrm_email", F.struct("added_in_app", "seq")).alias("_found"))
    )
    mail, name = null_to_blank(F.col("lrm_email")), name_key(F.col("lrm_name"))
    asks = (mail == "") & (name != "")
    found = lookup_join(queue.filter(asks).withColumn("_name", name), by_name, "_name").withColumns(
        {
            "lrm_email": F.coalesce("_found", F.lit("")),
            "lrm_email_source": F.when(F.col("_found").isNotNull(), "name").otherwise(""),
        }
    )
    rest = queue.filter(~asks).withColumns({"lrm_email": mail, "lrm_email_source": F.lit("")})
    return rest.unionByName(found.drop("_name", "_found"))


def newest_day_only(queue: DataFrame) -> DataFrame:
    """Rows of the newest audit day, compared as text; all rows when none is dated."""
    day = F.substring(null_to_blank(F.col("audit_date").cast("string")), 1, 10)
    newest = queue.select(day.alias("d")).agg(F.coalesce(F.max("d"), F.lit(""))).scalar()
    return queue.filter(day == newest)


def in_org(queue: DataFrame, hierarchy: DataFrame) -> DataFrame:
    return lookup_join(queue, hierarchy.select("lrm_email"), "lrm_email", how="left_semi")


def out_of_org(queue: DataFrame, hierarchy: DataFrame) -> DataFrame:
    return lookup_join(queue, hierarchy.select("lrm_email"), "lrm_email", how="left_anti")


def owner_key() -> Column:
    """Address of the owner, or the name where there is no address."""
    name = F.coalesce(blank_to_null(F.col("lrm_name")), F.lit("?"))
    return F.coalesce(blank_to_null(F.col("lrm_email")), F.concat(F.lit("name:"), name))


def unmapped_owners(queue: DataFrame, hierarchy: DataFrame, limit: int = UNMAPPED_LIMIT) -> DataFrame:
    """Owners outside the hierarchy with the number of leads stranded behind each."""
    place = F.struct("category", "lrm_category_rank", "lead_id")
    cluster = blank_to_null(F.col("cluster"))
    return (
        out_of_org(queue, hierarchy)
        .groupBy(owner_key().alias("owner_key"))
        .agg(
            F.min_by(null_to_blank(F.col("lrm_email")), place).alias("lrm_email"),
            F.min_by(null_to_blank(F.col("lrm_name")), place).alias("lrm_name"),
            F.coalesce(F.min_by(cluster, F.when(cluster.isNotNull(), place)), F.lit("")).alias("cluster"),
            F.count(F.lit(1)).alias("leads"),
        )
        .orderBy(F.desc("leads"), "owner_key")
        .limit(limit)
    )


def with_hierarchy(queue: DataFrame, hierarchy: DataFrame, fields: Sequence[str] = MAPPING_FIELDS) -> DataFrame:
    """Queue rows with their owner's reporting line; rows without one are dropped."""
    added = [f for f in fields if f not in queue.columns]
    return lookup_join(queue, hierarchy.select("lrm_email", *added), "lrm_email", how="inner")


def trim_per_owner(queue: DataFrame, per: int = PER_LRM_CATEGORY) -> DataFrame:
    order = [
        ("priority_key", "desc_nulls_last"),
        ("days_overdue", "desc_nulls_last"),
        ("lrm_category_rank", "asc"),
        ("lead_id", "asc"),
    ]
    return top_in_group(queue, ["lrm_email", "category"], order, per, "served_rank")


def tl_pick(
    rows: DataFrame,
    per_category: int = PICK_PER_CATEGORY,
    per_tl: int = PICK_PER_TL,
    by: Sequence[str] = ("tl_email",),
) -> DataFrame:
    """The work list of each team lead over all of the team's reps.

    `by` are the columns that make a list: with the audit day among them the lists of many days are
    drawn at once.

    First the best few of every category, newer leads first among equals; then, up to the
    total, the most overdue of the rest. Meetings still ahead are overdue by 0 days and so
    come last. Each pass is a top-k per group, so no team's rows are gathered whole.
    """
    best = [("priority_key", "desc_nulls_last"), ("created_at", "desc_nulls_last"), ("lead_id", "asc")]
    first = top_in_group(rows, [*by, "category"], best, per_category, "pick_rank").withColumn(
        "pick_pass", F.lit(1)
    )
    # the total holds for the first pass too, should it be less than all categories together
    first = top_in_group(first, by, best, per_tl, "_place").drop("_place")
    taken = first.select(*by, "lead_id")
    left = rows.join(taken, [*by, "lead_id"], "left_anti")
    late = [("days_overdue", "desc_nulls_last"), ("created_at", "desc_nulls_last"), ("lead_id", "asc")]
    spare = top_in_group(left, by, late, per_tl, "pick_rank").withColumn("pick_pass", F.lit(2))
    sizes = first.groupBy(*by).agg(F.count(F.lit(1)).alias("_picked"))
    fill = spare.join(sizes, [*by]).filter(F.col("pick_rank") <= per_tl - F.col("_picked"))
    return first.unionByName(fill.drop("_picked"))


def mapping_upsert(
    current: DataFrame, patches: DataFrame, by: str, at: str, alias: MailAlias = DEFAULT_ALIAS
) -> DataFrame:
    """Merge patches into the stored overrides and return the new table, sorted by address.

    A NULL field leaves the stored value, a blank clears it, `clear` removes the record, and
    a record left without fields goes too. Patches apply in `seq` order; an address without
    an at-sign is ignored. `current` has one row per address, as from `mapping_latest`.
    """
    valid = patches.withColumn("lrm_email", mail_key(F.col("lrm_email"), alias)).filter(
        F.col("lrm_email").contains("@")
    )
    wiped = F.max(F.when(F.col("clear"), F.col("seq")))
    # the last present value of a field, as (value, when); a later clear outweighs it
    merged = valid.groupBy("lrm_email").agg(
        wiped.alias("_wiped"),
        *[
            F.max(
                F.when(
                    F.col(f).isNotNull() & ~F.coalesce("clear", F.lit(False)),
                    F.struct("seq", mapping_cell(f, alias).alias("v")),
                )
            ).alias(f"_{f}")
            for f in MAPPING_FIELDS
        ],
    )
    both = current.select("lrm_email", *MAPPING_FIELDS, "updated_by", "updated_at").join(
        merged.withColumn("_touched", F.lit(True)), "lrm_email", "full_outer"
    )

    def value(f: str) -> Column:
        live = F.col(f"_{f}").isNotNull() & (F.col("_wiped").isNull() | (F.col(f"_{f}.seq") > F.col("_wiped")))
        kept = F.when(F.col("_wiped").isNull(), F.col(f))
        return null_to_blank(F.when(live, F.col(f"_{f}.v")).otherwise(kept))

    touched = F.coalesce("_touched", F.lit(False))
    out = both.select(
        "lrm_email",
        *[value(f).alias(f) for f in MAPPING_FIELDS],
        F.when(touched, F.lit(by)).otherwise(F.col("updated_by")).alias("updated_by"),
        F.when(touched, F.lit(at)).otherwise(F.col("updated_at")).alias("updated_at"),
        touched.alias("_t"),
    )
    return out.filter(~F.col("_t") | (F.concat(*MAPPING_FIELDS) != "")).drop("_t").orderBy("lrm_email")

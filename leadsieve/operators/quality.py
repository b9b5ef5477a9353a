"""Censuses, probes and verdicts: where did the rows go, and does the data still fit the rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsieve.config import Clock, instant
from leadsieve.functions.text import PHONE_DIGITS, blank_to_null, matches_any, null_to_blank, phone_key
from leadsieve.operators.org import out_of_org, owner_key
from leadsieve.operators.population import not_set

THIN_SHARE = 0.4
NULL_LABEL = "(null)"


def value_census(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """How often each value occurs, most frequent first."""
    counts = df.groupBy(F.coalesce(F.col(column), F.lit(NULL_LABEL)).alias("val")).agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "val").limit(limit) if limit else counts


def format_census(df: DataFrame, column: str, limit: int | None = None) -> DataFrame:
    """Frequencies of the first ten characters of a text date."""
    filled = df.filter(F.trim(column) != "").select(F.substring(column, 1, 10).alias("fmt"))
    counts = filled.groupBy("fmt").agg(F.count(F.lit(1)).alias("n"))
    return counts.orderBy(F.desc("n"), "fmt").limit(limit) if limit else counts


def fill_rate(df: DataFrame, columns: dict[str, str]) -> DataFrame:
    """Rows, rows that fill each column, and rows that fill none; `columns` maps name to alias."""
    filled = {alias: null_to_blank(F.col(c).cast("string")) != "" for c, alias in columns.items()}
    none = F.lit(True)
    for test in filled.values():
        none = none & ~test
    return df.agg(
        F.count(F.lit(1)).alias("leads"),
        *[F.count_if(test).alias(alias) for alias, test in filled.items()],
        F.count_if(none).alias("has_none"),
    )


def recent_undeleted(leads: DataFrame, clock: Clock, months: int) -> DataFrame:
    return leads.filter(not_set("is_delete") & (F.col("created_at") >= instant(clock.months_ago(months))))


def source_disagreement(leads: DataFrame, left: str, right: str, days: float = 1.0) -> DataFrame:
    """Leads whose two instants for the same thing differ by more than a day."""
    gap = F.abs(F.unix_micros(left) - F.unix_micros(right)) / F.lit(86_400e6)
    return leads.filter(gap > days).withColumn("gap_days", gap)


def phone_match_probe(leads: DataFrame, call_log: DataFrame, newest: int | None = None) -> DataFrame:
    """Number of (lead, dial) pairs that share a phone, without building a pair.

    `newest` limits the probe to that many recently touched leads.
    """
    if newest is not None:
        leads = leads.orderBy(F.desc("updated_at"), "lead_id").limit(newest)

    def per_phone(df: DataFrame, column: str, out: str) -> DataFrame:
        keys = df.select(phone_key(F.col(column)).alias("ph10"))
        return keys.groupBy("ph10").agg(F.count(F.lit(1)).alias(out))

    both = per_phone(leads, "customer_phone_number", "leads").join(per_phone(call_log, "call_to", "dials"), "ph10")
    full = F.length("ph10") == PHONE_DIGITS
    return both.filter(full).agg(
        F.coalesce(F.sum(F.col("leads") * F.col("dials")), F.lit(0)).alias("matching_pairs"),
        F.count(F.lit(1)).alias("matching_phones"),
    )


def category_profile(queue: DataFrame) -> DataFrame:
    return queue.groupBy("category", "leak_code").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("days_silent"), 1).alias("avg_silent"),
        F.round(F.avg("days_overdue"), 1).alias("avg_overdue"),
    )


def count_by_category(queue: DataFrame) -> DataFrame:
    return queue.groupBy("category").agg(F.count(F.lit(1)).alias("n"))


def column_search(df: DataFrame, patterns: tuple[str, ...]) -> DataFrame:
    """Columns whose name matches a pattern, their type and how many rows fill them."""
    kinds = dict(df.dtypes)
    counts = df.agg(*[F.count(c).alias(c) for c in df.columns]).unpivot([], df.columns, "column_name", "filled_rows")
    kind = F.element_at(F.create_map(*[F.lit(x) for pair in kinds.items() for x in pair]), F.col("column_name"))
    return counts.filter(matches_any(F.col("column_name"), patterns)).withColumn("data_type", kind)


def run_verdict(runs: DataFrame) -> DataFrame:
    """Verdict of each run from its rows and those of the last run before it that had any.

    A failed or empty run sets no standard: after one, a thin run is still thin. `runs` has a few
    rows per day, so ordering it whole is cheap.
    """
    failed = null_to_blank(F.col("error")) != ""
    earlier = Window.orderBy("run_at").rowsBetween(Window.unboundedPreceding, -1)
    before = F.last(F.when(~failed & (F.col("rows") > 0), F.col("rows")), ignorenulls=True).over(earlier)
    verdict = (
        F.when(failed, "FAILED")
        .when(F.col("rows") == 0, "EMPTY")
        .when(F.col("missing_columns") > 0, "COLS")
        .when(F.col("rows") < F.col("previous_rows") * THIN_SHARE, "THIN")
        .otherwise("ok")
    )
    return runs.withColumn("previous_rows", before).withColumn("verdict", verdict)


def run_changes(runs: DataFrame) -> DataFrame:
    """(run_at, change): rows of each run against the run just before it, whatever its verdict."""
    before = F.lag("rows").over(Window.orderBy("run_at"))
    return runs.select("run_at", (F.col("rows") - before).alias("change")).filter(F.col("change").isNotNull())


def mail_set(df: DataFrame, column: str = "lrm_email") -> DataFrame:
    return df.select(blank_to_null(F.col(column)).alias("lrm_email")).filter(F.col("lrm_email").isNotNull()).distinct()


def pull_counts(all_rows: DataFrame, served: DataFrame, hierarchy: DataFrame, source_rows: Column) -> DataFrame:
    """One row of counts along the pipeline: source, queue, hierarchy, the two joined.

    `all_rows` are the day's rows before they were scoped to the hierarchy and `served` those
    after; pass kept tables. Every row names its values, (space, value, side), once; one grouping by
    space and value, combined map-side, tells which sides know a value, and one sum over it gives all
    counts, the distinct ones too. A hot value is one partial row per task.
    """

    def item(space: str, value: Column, **sides: Column) -> Column:
        flags = {x: sides.get(x, F.lit(0)).cast("int") for x in ("queue", "named", "chart", "lost")}
        return F.struct(F.lit(space).alias("space"), null_to_blank(value).alias("value"), *[c.alias(x) for x, c in flags.items()])

    def items(df: DataFrame, *found: Column) -> DataFrame:
        return df.select(F.explode(F.array(*found)).alias("i")).select("i.*")

    one, mail = F.lit(1), F.col("lrm_email")
    by_name = F.coalesce(F.col("lrm_email_source") == "name", F.lit(False))
    everything = (
        items(served, item("mail", mail, queue=one, named=by_name), item("name", F.trim("lrm_name"), queue=one))
        .unionByName(items(hierarchy, item("mail", mail, chart=one), item("tl", F.col("tl_email"), chart=one)))
        .unionByName(items(out_of_org(all_rows, hierarchy), item("owner", owner_key(), lost=one)))
    )
    known = everything.groupBy("space", "value").agg(*[F.sum(x).alias(x) for x in ("queue", "named", "chart", "lost")])
    space, filled = F.col("space"), F.col("value") != ""
    in_queue, in_chart = F.col("queue") > 0, F.col("chart") > 0
    is_mail = space == "mail"

    def total(test: Column, side: str) -> Column:
        return F.coalesce(F.sum(F.when(test, F.col(side))), F.lit(0)).cast("bigint")

    return known.agg(
        total(is_mail, "queue").alias("queue_rows"),
        total(is_mail & ~filled, "queue").alias("blank_mails"),
        total(is_mail, "named").alias("resolved_by_name"),
        total(space == "owner", "lost").alias("excluded_rows"),
        F.count_if(space == "owner").alias("excluded_lrms"),
        total(is_mail, "chart").alias("hierarchy_rows"),
        F.count_if(is_mail & filled & in_queue).alias("lrms_in_queue"),
        F.count_if(is_mail & filled & in_chart).alias("lrms_in_map"),
        F.count_if(is_mail & filled & in_queue & in_chart).alias("lrms_in_both"),
        F.count_if(is_mail & filled & in_queue & ~in_chart).alias("lrms_unmatched"),
        F.count_if((space == "tl") & filled).alias("tls_in_map"),
        F.count_if((space == "name") & filled).alias("names_in_queue"),
    ).withColumn("source_rows", source_rows)


def pull_verdict(counts: DataFrame) -> DataFrame:
    """The first broken step, in the order in which the pipeline can fail."""
    no_rows = F.col("queue_rows") == 0
    verdict = (
        F.when(no_rows & (F.col("excluded_rows") > 0), "ALL_EXCLUDED")
        .when(no_rows & (F.col("source_rows") > 0), "NONE_PARSED")
        .when(no_rows, "NO_SOURCE_ROWS")
        .when(F.col("hierarchy_rows") == 0, "EMPTY_MAP")
        .when(F.col("blank_mails") > F.col("queue_rows") * 0.9, "NO_MAILS")
        .when(F.col("lrms_in_both") == 0, "JOIN_FAILURE")
        .otherwise("HEALTHY")
    )
    return counts.withColumn("verdict", verdict)


def sample_values(df: DataFrame, column: str, n: int) -> DataFrame:
    """The first few distinct non-blank values in sort order."""
    values = df.select(blank_to_null(F.trim(column)).alias("val")).filter(F.col("val").isNotNull())
    return values.distinct().orderBy("val").limit(n)

"""Readers for rows that arrive as exported JSON or as sheet cells."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

from leadsieve.config import DEFAULT_ALIAS, MailAlias
from leadsieve.functions.text import (
    blank_to_null,
    column_key,
    flag_from_text,
    mail_key,
    null_to_blank,
    number_from_text,
)
from leadsieve.operators.rules import COLUMNS_V7_8
from leadsieve.session import written
from leadsieve.sources.schemas import HIERARCHY_HEADERS

# how each column of the queue is read from text
FLAG_COLUMNS = ("stage_mismatch", "attempt_today")
NUMBER_COLUMNS = (
    "priority_key",
    "lrm_category_rank",
    "days_silent",
    "hours_silent",
    "calls_30d",
    "connects_30d",
    "loop_turns",
    "mcch_events",
    "dev_events",
    "days_overdue",
)
TIME_COLUMNS = (
    "stage_changed_at_audit",
    "created_at",
    "order_closed_at",
    "crm_touch_at",
    "meeting_confirmed_at",
    "meeting_schedule_date",
    "meeting_done_date",
    "follow_up_at",
    "follow_up_datetime_raw",
    "reschedule_date_raw",
    "qualified_at",
    "status_changed_at",
    "last_activity_at",
    "crm_updated_at",
)


# columns that a served queue may carry besides those of the newest rule set
QUEUE_COLUMNS = tuple(dict.fromkeys((*COLUMNS_V7_8, "lead_object_id", "order_closed_at", "crm_touch_at")))
#: Names the place of a row in the files it was read from, and the record that broke a card's contract.
PLACE, BROKEN = "seq", "broken_record"
_INDEX_BITS = 33


class BrokenCard(ValueError):
    """A card holds records that are not what its schema promises."""


def key_columns(df: DataFrame) -> DataFrame:
    """Snake-case every column name; two names that meet are an error, not a silent loss."""
    keys = [column_key(c) for c in df.columns]
    clashes = sorted(k for k, n in Counter(keys).items() if n > 1)
    if clashes:
        raise ValueError(f"columns collide after renaming: {clashes}")
    return df.toDF(*keys)


def read_card_json(spark: SparkSession, path: str, schema: StructType | None = None, lines: bool = True) -> DataFrame:
    """Exported report rows as JSON objects, one per line or as one array."""
    reader = spark.read.option("multiLine", not lines)
    if schema is not None:
        reader = reader.schema(schema)
    return key_columns(reader.json(path))


def read_card(spark: SparkSession, path: str, schema: StructType, lines: bool = True) -> DataFrame:
    """Exported report rows as JSON against a fixed list of columns; the input is read once.

    A record is an object or an array of objects, one per line or one per file; its keys may be
    spelled like headers. Absent cells are NULL, unknown ones are left out. What is no object, or has
    a cell that does not fit its type, is kept in `broken_record` with NULL cells. Keys of one object
    that meet after renaming fail the read.
    """
    value = F.trim("value")
    many, one = F.from_json("value", "array<map<string,string>>"), F.array(F.from_json("value", "map<string,string>"))
    nothing = F.lit(None).cast("map<string,string>")
    found = F.coalesce(F.when(value.startswith("["), many).otherwise(one), F.array(nothing))
    rows = spark.read.text(path, wholetext=not lines).filter(value != "")
    cells = rows.select("value", F.explode(found).alias("c")).select("value", F.transform_keys("c", lambda k, _: key_of(k)).alias("c"))
    given = {f.name: F.col("c")[f.name] for f in schema}
    typed = {f.name: given[f.name] if isinstance(f.dataType, StringType) else given[f.name].try_cast(f.dataType) for f in schema}
    broken = F.col("c").isNull()
    for name, cell in typed.items():
        broken = broken | (given[name].isNotNull() & cell.isNull())
    return cells.select(*[typed[f.name].alias(f.name) for f in schema], F.when(broken, F.col("value")).alias(BROKEN))


def key_of(name: Column) -> Column:
    """`column_key` of a name that is data."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), "[^a-z0-9]+", "_"), "^_|_$", "")


def unbroken(card: DataFrame) -> DataFrame:
    """A stored card without `broken_record`, or BrokenCard if any record broke the contract."""
    if BROKEN not in card.columns:
        return card
    bad = card.filter(F.col(BROKEN).isNotNull()).agg(F.count(F.lit(1)).alias("n"), F.min(F.substring(BROKEN, 1, 200)).alias("one")).first()
    if bad["n"]:
        raise BrokenCard(f"{bad['n']} broken records, such as {bad['one']}")
    return card.drop(BROKEN)


def read_sheet(spark: SparkSession, path: str, place: str = PLACE) -> DataFrame:
    """Header row plus ragged rows, every cell text, absent cells blank, blank rows dropped.

    Cells follow RFC 4180: quoted ones may hold commas, doubled quotes and line breaks. A file with
    line breaks in cells can't be split, so each file is one task. `seq` grows with a row's place:
    files in the order of their names, rows as they stand in them.
    """
    df = _csv(spark).option("header", True).option("inferSchema", False).csv(path)
    names = [c.strip() for c in df.columns]
    if place in names:
        raise ValueError(f"the sheet has a column {place} of its own; name another `place`")
    return _not_blank(_placed(df, names, place), place)


def _csv(spark: SparkSession):
    return spark.read.option("mode", "PERMISSIVE").option("quote", '"').option("escape", '"').option("multiLine", True)


def quoted(name: str) -> Column:
    """A column by its whole name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def _placed(df: DataFrame, names: list[str], place: str) -> DataFrame:
    """`df`, just read, with blanks for NULLs, its columns renamed and the place of each row.

    The place is the file's number among the files' names, then the row's number in the task that
    reads the file. Both come from what the scan knows: no row is counted or moved.
    """
    path = F.regexp_replace("_metadata.file_path", "^file:/+", "file:/")
    index = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _INDEX_BITS) - 1))
    cells = [F.coalesce(quoted(c), F.lit("")).alias(n) for c, n in zip(df.columns, names, strict=True)]
    read = df.select(path.alias("_file"), index.alias("_index"), *cells)
    files = sorted({re.sub("^file:/+", "file:/", x) for x in df.inputFiles()})
    number = F.lit(0)
    if len(files) > 1:
        numbers = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(files)], "_file string, _number long")
        read, number = read.join(numbers, "_file"), F.col("_number")
    return read.select((F.shiftleft(number.cast("long"), _INDEX_BITS) + F.col("_index")).alias(place), *[quoted(n) for n in names])


def _not_blank(df: DataFrame, place: str) -> DataFrame:
    return df.filter(F.trim(F.concat(*[quoted(c) for c in df.columns if c != place])) != "")


def read_positional(spark: SparkSession, path: str, schema: StructType, header: str = "lead_id", place: str = PLACE) -> DataFrame:
    """Cells read by position against our own column list, whatever header the file carries.

    A stored header row, recognised by its `header` cell, is dropped. `seq` as in `read_sheet`.
    """
    df = _csv(spark).schema(schema).option("header", False).csv(path)
    rows = _not_blank(_placed(df, df.columns, place), place)
    names = F.array(*[F.lower(F.trim(quoted(c))) for c in df.columns])
    return rows.filter(~F.array_contains(names, header))


def with_fallback(primary: Callable[[], DataFrame], backup: Callable[[], DataFrame]) -> DataFrame:
    """The primary source, or the backup when it cannot be read; `source` says which.

    The primary is read once, into the scratch folder, so that a source that breaks at any row, or
    breaks its contract, counts as unreadable and not only one whose schema cannot be had.
    """
    try:
        return unbroken(written(primary(), "card")).withColumn("source", F.lit("card"))
    except (PySparkException, Py4JJavaError, BrokenCard):
        return backup().withColumn("source", F.lit("sheet"))


def alias_columns(df: DataFrame, headers: dict[str, tuple[str, ...]] = HIERARCHY_HEADERS) -> DataFrame:
    """One column per field: its first non-blank value among the accepted headers, else blank."""
    present = set(df.columns)
    kept = [c for c in ("seq",) if c in present]
    fields = [
        F.coalesce(*[blank_to_null(F.col(f"`{n}`")) for n in names if n in present], F.lit("")).alias(field)
        for field, names in headers.items()
    ]
    return df.select(*kept, *fields)


def coerce_queue(rows: DataFrame, alias: MailAlias = DEFAULT_ALIAS) -> DataFrame:
    """Type queue rows that came as text; rows without a lead or a category are dropped."""
    present = set(rows.columns)
    if "category_rank" in present and "lrm_category_rank" in present:
        rank = F.coalesce(blank_to_null(F.col("lrm_category_rank").cast("string")), F.col("category_rank"))
        rows = rows.withColumn("lrm_category_rank", rank)
    elif "category_rank" in present:
        rows = rows.withColumnRenamed("category_rank", "lrm_category_rank")

    def typed(name: str):
        if name not in rows.columns:
            cell = F.lit(None).cast("string")
        else:
            cell = F.col(name)
        if name in FLAG_COLUMNS:
            return flag_from_text(cell)
        if name in NUMBER_COLUMNS:
            return number_from_text(cell)
        if name in TIME_COLUMNS:
            return blank_to_null(cell.cast("string"))
        if name == "lrm_email":
            return null_to_blank(mail_key(cell, alias))
        return null_to_blank(cell.cast("string"))

    typed_rows = rows.select(*[typed(c).alias(c) for c in QUEUE_COLUMNS])
    return typed_rows.filter((F.col("lead_id") != "") & (F.col("category") != ""))

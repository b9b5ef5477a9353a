"""Joins and ranks that hold when one key owns a large share of the rows."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsieve.session import written

#: Words of 64 bits in a key filter: its table has at most so many rows, whatever the keys.
FILTER_WORDS = 1 << 18


def key_filter(ids: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """(_word, _bits): one bit for the hash of each key, at most `words` rows."""
    h = F.xxhash64(key)
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), h.bitwiseAND(F.lit(63)).cast("int"))
    return ids.filter(F.col(key).isNotNull()).groupBy(_word(h, words)).agg(F.bit_or(bit).alias("_bits"))


def _word(h: Column, words: int) -> Column:
    return F.pmod(F.shiftright(h, 6), F.lit(words)).alias("_word")


def prefilter(facts: DataFrame, ids: DataFrame, key: str, words: int = FILTER_WORDS) -> DataFrame:
    """The fact rows whose key may be in `ids`: all that are, and few that are not.

    A bitmap of the ids' hashes, bounded whatever their number, goes to every task, so facts are
    reduced where they are read. Aggregate them next and join the ids then: a key of any weight sends
    one partial row per task, and raw rows are never shuffled.
    """
    names = facts.columns
    h = F.xxhash64(key)
    marked = facts.withColumns({"_word": _word(h, words), "_bit": h.bitwiseAND(F.lit(63)).cast("int")})
    kept = marked.join(F.broadcast(key_filter(ids, key, words)), "_word")  # at most `words` rows of 16 bytes
    return kept.filter(F.getbit("_bits", F.col("_bit")) == 1).select(*names)


def lookup_join(facts: DataFrame, lookup: DataFrame, keys: str | Sequence[str], *, how: str = "left") -> DataFrame:
    """Join facts to a table with few rows per key, whatever the key distribution of the facts.

    Spark broadcasts a lookup that it knows or measures to be small. Beyond that both sides are
    shuffled on the keys and the adaptive skew join cuts an oversized partition of facts, one hot
    key or all the NULL keys, into pieces that each meet the same few lookup rows.
    """
    return facts.join(lookup, keys, how)


def ordering(spec: Sequence[tuple[str, str]]) -> list[Column]:
    """Sort columns with the null position written out: `("quiet_days", "desc_nulls_last")`."""
    return [getattr(F.col(name), direction)() for name, direction in spec]


def rank_in_group(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, str]], out: str) -> DataFrame:
    """Exact row number of every row of a group, without putting a group into one task.

    Rows are sorted by range over group and order at once: cut points come from a sample, so ranges
    hold about as many rows each, also where all rows are one group with one leading value. A row's
    number in its range and how many rows of its group lie in earlier ranges make its rank. The
    sorted rows are written to the scratch folder; pass a stored table, since sampling reads it too.
    End the order with a unique column. Where only the first few are wanted, `top_in_group` is
    cheaper, because Spark then drops rows before the shuffle.
    """
    spec = [*(F.col(g).asc_nulls_first() for g in group), *ordering(order)]
    sorted_rows = df.repartitionByRange(*spec).sortWithinPartitions(*spec)
    number = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
    placed = written(sorted_rows.withColumns({"_range": F.spark_partition_id(), "_number": number}), "ranked")
    # one row for each range that a group reaches into
    parts = placed.groupBy(*group, "_range").agg(F.min("_number").alias("_from"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = parts.select(
        *[F.col(g).alias(f"_o_{g}") for g in group],
        F.col("_range").alias("_o_range"),
        (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_from") + 1).alias("_offset"),
    )
    same = reduce(and_, [F.col(g).eqNullSafe(F.col(f"_o_{g}")) for g in group], F.col("_range") == F.col("_o_range"))
    return placed.join(offsets, same).withColumn(out, F.col("_number") + F.col("_offset")).select(*df.columns, out)


def top_in_group(
    df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, str]], limit: int, out: str
) -> DataFrame:
    """The first `limit` rows of each group with their rank.

    Spark plans the filter on row_number as a group limit on both sides of the shuffle, so a
    hot group sends at most `limit` rows per map task.
    """
    window = Window.partitionBy(*group).orderBy(*ordering(order))
    return df.withColumn(out, F.row_number().over(window)).filter(F.col(out) <= limit)

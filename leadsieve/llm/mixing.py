"""Mix sources to target weights by Pareto order sampling.

A source's target is dealt to its documents as expected copies, at most two of each and more of
short documents than of long ones, so that repeats don't rest on a few huge texts: `L` times the
rate of the document's length, with the one level `L` at which the source's expected words are its
target. The whole part of a document's copies is allocated for certain; the rest is the probability
p with which one more copy is included. Documents are ranked by random odds u / (1 - u) divided by
inclusion odds p / (1 - p) (Rosen's Pareto order sampling), and the sample is the head of that
order whose words come nearest to what the target still lacks: its size is fixed in words, the
probabilities are unequal, the draws are not independent.

The order is never one sort: ranks are cut into slices of (0, 1), slices are summed, and only the
slice in which the target falls is ordered by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsieve.llm.common import WORD_SQL, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
SLICES = 4096
#: The rate of a length with k binary digits is RATE div (k + 1): whole numbers, whose sums are exact.
RATE = 2520


def n_words(text: Column) -> Column:
    """Words of a text; NULL has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD_SQL)), F.lit(0)).cast("long")


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) that depends on the key alone: 52 bits of its md5 digest."""
    digest = F.md5(F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit(""))).cast("binary"))
    return (F.conv(F.substring(digest, 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(16**13))


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """(source, source_size, target): `share` of all words dealt by weight, at most `most` times a size.

    The excess of a source at its limit is dealt to the others by weight until none is above. That
    is one level L with target = least(most * size, L * weight): sources in the order of
    limit / weight reach their limits first, so L follows from running sums over that order.
    One row per source; the windows without a key run over that table only.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_k") % len(weights) + 1).cast("int"))
    per = per.withColumn("_k", F.row_number().over(by_name) - 1).withColumn("_w", weight)
    per = per.withColumn("_limit", F.col("source_size") * F.lit(float(most)))

    order = Window.orderBy(F.col("_limit") / F.col("_w"), "_k")
    up_to, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    everything = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    level = (F.lit(share) * F.sum("source_size").over(everything) - F.coalesce(F.sum("_limit").over(up_to), F.lit(0.0))) / F.sum("_w").over(after)
    per = per.withColumn("_level", level)
    # the level is right from the first source that stays below its limit on
    stays = F.when(F.col("_level") <= F.col("_limit") / F.col("_w"), F.struct("_place", "_level"))
    per = per.withColumn("_place", F.row_number().over(order)).withColumn("_level", F.min(stays).over(everything)["_level"])
    target = F.least(F.col("_limit"), F.coalesce(F.col("_level") * F.col("_w"), F.col("_limit")))
    return per.select("source", "source_size", target.alias("target"))


def length_class(size: Column) -> Column:
    """Binary digits of a size."""
    return F.length(F.bin(size)).cast("int")


def expected_copies(sized: DataFrame, targets: DataFrame, most: int = MOST) -> DataFrame:
    """(source, class, copies, source_size, target): expected copies of a document of each length.

    As sources above, classes of a source reach `most` copies in the order of most / rate, that is from
    the shortest on; the level of the others follows from running sums. A source has one row for each
    binary length, 64 at most.
    """
    per = sized.groupBy("source", length_class(F.col("size")).alias("class")).agg(F.sum("size").cast("double").alias("_words"))
    per = per.join(targets.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")
    per = per.withColumn("_rate", F.floor(F.lit(RATE) / (F.col("class") + 1)).cast("double"))
    order = Window.partitionBy("source").orderBy("class")
    up_to, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    full = F.coalesce(F.sum(F.col("_words") * F.lit(float(most))).over(up_to), F.lit(0.0))
    rest = F.sum(F.col("_words") * F.col("_rate")).over(after)
    per = per.withColumn("_level", F.when(rest > 0, (F.col("target") - full) / rest))
    stays = F.when(F.col("_level") * F.col("_rate") <= most, F.struct("class", "_level"))
    level = F.min(stays).over(Window.partitionBy("source"))["_level"]
    copies = F.coalesce(F.least(F.greatest(level, F.lit(0.0)) * F.col("_rate"), F.lit(float(most))), F.lit(float(most)))
    copies = F.when(F.col("source_size") > 0, copies).otherwise(0.0)
    return per.select("source", "class", copies.alias("copies"), "source_size", "target", "_words")


def mix(sized: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST, seed: str = "mix-1", slices: int = SLICES) -> DataFrame:
    """(doc_id, source, size) with source_size, target, copies and taken = copies * size.

    Sources are joined NULL-safe. Repeated rows have equal random odds and are drawn one by one.
    """
    rates = expected_copies(sized, source_targets(sized, weights, share, most), most).withColumn("_whole", F.floor("copies").cast("long"))
    certain = F.sum(F.col("_whole") * F.col("_words")).over(Window.partitionBy("source"))
    rates = rates.select(
        F.col("source").alias("_source"),
        F.col("class").alias("_class"),
        "source_size",
        "target",
        "_whole",
        (F.col("copies") - F.col("_whole")).alias("_p"),
        (F.col("target") - certain).alias("_lack"),
    )
    rates = stored(rates, "mix-rates")

    same = F.col("source").eqNullSafe(F.col("_source")) & (length_class(F.col("size")) == F.col("_class"))
    docs = sized.join(rates, same).drop("_source", "_class")
    u, p = uniform(F.col("doc_id"), seed), F.col("_p")
    odds = u / (1 - u) * (1 - p) / p  # random odds over inclusion odds
    key = F.when(p > 0, odds / (1 + odds))
    docs = docs.withColumn("_key", key).withColumn("_slice", F.floor(F.col("_key") * slices).cast("int"))

    sums = docs.where(F.col("_slice").isNotNull()).groupBy("source", "_slice", "_lack").agg(F.sum("size").alias("_words"))
    so_far = Window.partitionBy("source").orderBy("_slice").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = sums.withColumn("_end", F.sum("_words").over(so_far))
    # wholly below the target, or the one slice that the target falls into
    cut = sums.where(F.col("_end") > F.col("_lack")).groupBy("source").agg(F.min(F.struct("_slice", "_end", "_words")).alias("_cut"))
    cut = cut.select(F.col("source").alias("_source"), F.col("_cut._slice").alias("_cut"), (F.col("_cut._end") - F.col("_cut._words")).alias("_begin"))
    cut = stored(cut, "mix-cuts")

    docs = docs.join(cut, F.col("source").eqNullSafe(F.col("_source")), "left").drop("_source")
    at_cut = F.coalesce(F.col("_slice") == F.col("_cut"), F.lit(False))
    below = F.col("_slice").isNotNull() & (F.col("_cut").isNull() | (F.col("_slice") < F.col("_cut")))
    clear = docs.where(~at_cut).withColumn("_extra", F.coalesce(below, F.lit(False)))
    in_order = Window.partitionBy("source").orderBy("_key", "doc_id", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    end = F.col("_begin") + F.sum("size").over(in_order)
    nearest = end + end - F.col("size") <= F.lit(2.0) * F.col("_lack")  # nearer with this document than without
    split = docs.where(at_cut).withColumn("_extra", nearest)
    copies = F.col("_whole") + F.col("_extra").cast("long")
    return clear.unionByName(split).select(
        "doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken")
    )


def mix_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **how) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, copies, taken.

    NULL and empty texts have size 0 and take 0 words; NULL is a source of its own, after all
    others; an empty table gives an empty one. Other columns are not read. Runs small jobs when
    called: sizes, targets and cuts are written to the shared scratch folder.
    """
    sized = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"))
    return mix(stored(sized, "mix-sizes"), **how)


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         md5('mix-1' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h
  FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + ((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3]::DOUBLE AS w FROM s),
l AS (
  -- every source in turn as the first that stays below its limit; right is the first whose level holds
  SELECT arg_min((1.5 * (SELECT sum(source_size) FROM s) - coalesce(b.full_, 0)) / b.rest, b.ratio) AS level
  FROM (SELECT c.source, c.source_size * 2.0 / c.w AS ratio,
               (SELECT sum(x.source_size * 2.0) FROM w x WHERE x.source_size * 2.0 / x.w < c.source_size * 2.0 / c.w) AS full_,
               (SELECT sum(x.w) FROM w x WHERE x.source_size * 2.0 / x.w >= c.source_size * 2.0 / c.w) AS rest
        FROM w c) b
  WHERE (1.5 * (SELECT sum(source_size) FROM s) - coalesce(b.full_, 0)) / b.rest <= b.ratio),
t AS (SELECT source, source_size, least(source_size * 2.0, coalesce(level * w, source_size * 2.0)) AS target FROM w, l),
k AS (
  -- lengths of a source by binary digits, with the words of all shorter ones and the rated words from here on
  SELECT *, sum(words * rate) OVER (PARTITION BY source) - coalesce(sum(words * rate) OVER shorter, 0) AS rest,
         coalesce(sum(words * 2.0) OVER shorter, 0) AS full_
  FROM (SELECT source, len(bin(size)) AS digits, sum(size)::DOUBLE AS words, (2520 // (len(bin(size)) + 1))::DOUBLE AS rate FROM d GROUP BY ALL)
  WINDOW shorter AS (PARTITION BY source ORDER BY digits ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
v AS (
  SELECT k.source, arg_min(greatest(0, (target - full_) / rest), digits) AS level
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source WHERE rest > 0 AND (target - full_) / rest * rate <= 2 GROUP BY k.source),
e AS (
  SELECT k.source, digits, words, source_size, target, CASE WHEN source_size > 0 THEN coalesce(least(level * rate, 2), 2) ELSE 0 END AS copies
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source LEFT JOIN v ON k.source IS NOT DISTINCT FROM v.source),
i AS (SELECT *, floor(copies) AS whole, copies - floor(copies) AS p, target - sum(floor(copies) * words) OVER (PARTITION BY source) AS lack FROM e),
r AS (
  SELECT d.doc_id, d.size, i.source_size, i.target, d.source, whole, lack, p,
         (CAST(('0x' || substr(h, 1, 13)) AS BIGINT) + 0.5) / 4503599627370496.0 AS u
  FROM d JOIN i ON d.source IS NOT DISTINCT FROM i.source AND len(bin(d.size)) = i.digits),
o AS (SELECT *, CASE WHEN p > 0 THEN u / (1 - u) * (1 - p) / p END AS odds FROM r),
c AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY odds / (1 + odds) NULLS LAST, doc_id, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM o)
SELECT doc_id, size, source_size, target,
       CAST(size * (whole + CASE WHEN p > 0 AND upto + upto - size <= 2.0 * lack THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""

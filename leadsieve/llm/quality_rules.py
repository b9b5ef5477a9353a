"""Quality rules with thresholds that follow the corpus, in built-in functions only.

Every document is measured once. Each measure of each (language, source) goes into a mergeable
quantile sketch, a log-linear histogram: a value keeps its five leading bits, so a count sits in a
bucket at most 1/16 of its value wide, and sketches of parts are merged by adding counts, in any
order and with the same result. A threshold is an upper Tukey fence read from the sketch; a source's
fence is drawn to that of its language, and a language's to that of the corpus, as if PRIOR more
documents had shown it, so that small groups borrow and large ones stand alone. Those sketches are
the same counts added up further. Documents then meet their thresholds in a join. A measure is a
share of a document's words or lines and as uncertain as these are few: a document is over a fence
if it is so by more than REACH sampling errors of its own length. No cutoff is fixed.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from leadsieve.llm.common import BLANKS, stored

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEATED_PERCENT = 50

#: Each is so many per mille of a document: (what is counted, of what).
MEASURES = {
    "symbols": ("n_symbols", "n_words"),
    "repeats": ("n_repeat_words", "n_words"),
    "dup_lines": ("n_dup_lines", "n_lines"),
    "word_length": ("word_chars", "n_words"),
}
#: A fence is q75 + REACH * (q75 - q25); documents clear it by REACH sampling errors.
REACH = 3.0
#: Documents as which the fence of the wider group counts. Few: a language of unlike sources has a wide one.
PRIOR = 10
LEADING_BITS = 5


def _pairs(array: Column, how) -> Column:
    """how(a, b) over neighbours of an array."""
    n = F.size(array)
    return F.zip_with(F.slice(array, F.lit(1), F.greatest(n - 1, F.lit(0))), F.slice(array, F.lit(2), F.greatest(n - 1, F.lit(0))), how)


def measured(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words).

    Repeated 3-word windows are found by sorting, so a text of n words takes O(n log n): the hash
    of a window and its place share one long, equal hashes become neighbours, and only windows with
    an equal hash are compared as words.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    df = docs.select(F.col(id_col).alias("doc_id"), *[F.col(x) for x in ("lang", "source")], text.alias("_text"))
    df = df.withColumn("_words", F.array_remove(F.split(F.translate("_text", BLANKS, " " * len(BLANKS)), " "), ""))
    lines = F.filter(F.split("_text", "\n"), lambda x: F.length(F.btrim(x, F.lit(BLANKS))) > 0)
    df = df.select(
        "doc_id",
        "lang",
        "source",
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.length(F.translate("_text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("_text") - F.length(F.translate("_text", SYMBOLS, ""))).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.transform("_words", lambda x: F.xxhash64(x)).alias("_hash"),
    )
    n = F.size("_hash")
    # bits that hold a place; the hash keeps the others
    bits = F.length(F.bin(n.cast("long"))).cast("int")
    two = _pairs(F.col("_hash"), lambda a, b: F.xxhash64(a, b))
    three = F.zip_with(
        F.slice(two, F.lit(1), F.greatest(n - 2, F.lit(0))),
        F.slice("_hash", F.lit(3), F.greatest(n - 2, F.lit(0))),
        lambda a, b: F.xxhash64(a, b),
    )
    df = df.select(
        *[x for x in df.columns if x not in ("_lines", "_hash")],
        F.size("_lines").cast("long").alias("n_lines"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        bits.alias("_bits"),
        three.alias("_three"),
    )
    keyed = F.transform(
        "_three", lambda x, i: F.call_function("shiftleft", F.call_function("shiftright", x, F.col("_bits")), F.col("_bits")) + i.cast("long")
    )
    df = df.withColumn("_sorted", F.sort_array(keyed)).drop("_three")
    place = lambda x: (x - F.call_function("shiftleft", F.call_function("shiftright", x, F.col("_bits")), F.col("_bits"))).cast("int")
    head = lambda x: F.call_function("shiftright", x, F.col("_bits"))
    twins = _pairs(F.col("_sorted"), lambda a, b: F.when(head(a) == head(b), F.array(place(a), place(b))))
    df = df.withColumn("_maybe", F.array_distinct(F.flatten(F.filter(twins, lambda x: x.isNotNull())))).drop("_sorted", "_bits")
    window = lambda i: F.concat_ws(" ", F.slice(F.col("_words"), i + 1, 3))
    named = F.sort_array(F.transform("_maybe", lambda i: F.struct(window(i).alias("w"), i.alias("i"))))
    df = df.withColumn("_named", F.when(F.size("_maybe") > 0, named)).drop("_maybe", "_words")
    same = _pairs(F.col("_named"), lambda a, b: F.when(a["w"] == b["w"], F.array(a["i"], b["i"])))
    df = df.withColumn("_places", F.sort_array(F.array_distinct(F.flatten(F.filter(same, lambda x: x.isNotNull()))))).drop("_named")
    # a window covers three words, or as many as there are before the next one begins
    steps = _pairs(F.col("_places"), lambda a, b: F.least(b - a, F.lit(3)))
    covered = F.aggregate(steps, F.lit(3), lambda s, x: s + x)
    repeats = F.when(F.size("_places") > 0, covered).otherwise(0).cast("long")
    return df.withColumn("n_repeat_words", F.coalesce(repeats, F.lit(0).cast("long"))).drop("_places")


def with_base(df: DataFrame) -> DataFrame:
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEATED_PERCENT * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _per_mille() -> dict[str, Column]:
    share = lambda a, b: F.when(F.col(b) > 0, F.expr(f"{a} * 1000L div {b}")).otherwise(F.lit(0).cast("long"))
    return {m: share(*of) for m, of in MEASURES.items()}


def sampling_error(n: Column) -> Column:
    """Per mille by which a share of n words or lines is uncertain."""
    return F.lit(1000.0) / F.sqrt(F.greatest(n, F.lit(1)).cast("double"))


def bucket(value: Column, bits: int = LEADING_BITS) -> Column:
    """The largest value of the sketch's bucket that a non-negative long falls into."""
    drop = F.greatest(F.length(F.bin(value)) - bits, F.lit(0)).cast("int")
    low = F.call_function("shiftleft", F.call_function("shiftright", value, drop), drop)
    return low + F.call_function("shiftleft", F.lit(1).cast("long"), drop) - 1


def sketches(df: DataFrame) -> DataFrame:
    """(lang, source, measure, bucket, n): one sketch for each measure of each language and source."""
    rows = F.explode(F.array(*[F.struct(F.lit(k).alias("measure"), bucket(v).alias("bucket")) for k, v in _per_mille().items()]))
    return (
        df.where(F.col("n_words") > 0)
        .select("lang", "source", rows.alias("_m"))
        .groupBy("lang", "source", "_m.measure", "_m.bucket")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _fences(sketch: DataFrame, keys: list[str], reach: float) -> DataFrame:
    """(keys, measure, total, fence) of the sketches merged over all other keys."""
    by = [*keys, "measure"]
    merged = sketch.groupBy(*by, "bucket").agg(F.sum("n").alias("n"))
    in_order = Window.partitionBy(*by).orderBy("bucket")
    merged = merged.withColumn("_end", F.sum("n").over(in_order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    merged = merged.withColumn("total", F.sum("n").over(Window.partitionBy(*by)))
    quantile = lambda q: F.min(F.when(F.col("_end") * 100 >= F.col("total") * q, F.col("bucket")))
    out = merged.groupBy(*by, "total").agg(quantile(25).alias("_low"), quantile(75).alias("_high"))
    return out.select(*by, "total", (F.col("_high") + F.lit(reach) * (F.col("_high") - F.col("_low"))).alias("fence"))


def thresholds(sketch: DataFrame, prior: int = PRIOR, reach: float = REACH) -> DataFrame:
    """(lang, source, one column for each measure): a row for each language and source."""
    own = _fences(sketch, ["lang", "source"], reach)
    lang = _fences(sketch, ["lang"], reach).select(F.col("lang").alias("_l"), F.col("measure").alias("_m"), F.col("total").alias("_lt"), F.col("fence").alias("_lf"))
    corpus = _fences(sketch, [], reach).select(F.col("measure").alias("_m2"), F.col("fence").alias("_cf"))
    both = own.join(lang, F.col("lang").eqNullSafe(F.col("_l")) & (F.col("measure") == F.col("_m"))).join(corpus, F.col("measure") == F.col("_m2"))
    drawn = lambda n, fence, wider: (n * fence + prior * wider) / (n + prior)
    both = both.withColumn("_wider", drawn(F.col("_lt"), F.col("_lf"), F.col("_cf")))
    both = both.select("lang", "source", "measure", drawn(F.col("total"), F.col("fence"), F.col("_wider")).alias("fence"))
    return both.groupBy("lang", "source").agg(*[F.max(F.when(F.col("measure") == m, F.col("fence"))).alias(f"max_{m}") for m in MEASURES])


def quality_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prior: int = PRIOR, reach: float = REACH) -> DataFrame:
    """doc_id, lang, source, the base counts, base_failed, a flag for each measure over its fence, kept.

    A NULL or empty text has no words and fails the base rule. NULL languages and sources are groups
    of their own. Repeated rows stay; an empty table gives an empty one. Other columns are not read.
    Runs two jobs when called: counts and thresholds are written to the shared scratch folder. The
    thresholds are one row for each language and source; Spark broadcasts that table if its files
    are small enough and shuffles with skew handling if not.
    """
    counts = stored(with_base(measured(docs, id_col, text_col)), "rule-counts")
    limits = stored(thresholds(sketches(counts), prior, reach), "rule-limits").select(
        F.col("lang").alias("_lang"), F.col("source").alias("_source"), *[f"max_{m}" for m in MEASURES]
    )
    joined = counts.join(limits, F.col("lang").eqNullSafe(F.col("_lang")) & F.col("source").eqNullSafe(F.col("_source")), "left")
    least = {m: F.col(f"max_{m}") + F.lit(reach) * sampling_error(F.col(of)) for m, (_, of) in MEASURES.items()}
    over = {m: F.coalesce(v > least[m], F.lit(False)) for m, v in _per_mille().items()}
    kept = ~F.col("base_failed") & ~reduce(lambda a, b: a | b, [F.col(f"over_{m}") for m in MEASURES])
    return joined.select(*counts.columns, *[c.alias(f"over_{m}") for m, c in over.items()]).withColumn("kept", kept)

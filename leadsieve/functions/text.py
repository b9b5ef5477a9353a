"""Text normalisers: phone keys, mail addresses, name keys, cell cleaners."""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column
from pyspark.sql import functions as F

from leadsieve.config import DEFAULT_ALIAS, MailAlias

PHONE_DIGITS = 10
PLAIN_NUMBER = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$"


def blank_to_null(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def null_to_blank(c: Column) -> Column:
    return F.coalesce(c, F.lit(""))


def strip_space(c: Column) -> Column:
    """Strip every kind of leading and trailing white space, not only spaces."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def digits(c: Column) -> Column:
    return F.regexp_replace(null_to_blank(c), r"\D", "")


def phone_key(c: Column) -> Column:
    """The last ten digits; shorter when the number has fewer."""
    return F.right(digits(c), F.lit(PHONE_DIGITS))


def number_from_text(c: Column) -> Column:
    """`"1,204"` is 1204; blanks and anything that is not a number are 0."""
    plain = F.trim(F.replace(null_to_blank(c.cast("string")), F.lit(","), F.lit("")))
    return F.coalesce(F.when(plain.rlike(PLAIN_NUMBER), plain.try_cast("double")), F.lit(0.0))


def flag_from_text(c: Column) -> Column:
    """True only for the word `true`, in any case."""
    return F.coalesce(F.lower(c.cast("string")) == "true", F.lit(False))


def mail_key(c: Column, alias: MailAlias = DEFAULT_ALIAS) -> Column:
    """Trimmed, lower-cased address with the alias domain folded into the main one.

    Only the first occurrence is folded. NULL stays NULL.
    """
    first = r"(?s)^(.*?)@" + re.escape(alias.alias)
    return F.regexp_replace(F.lower(strip_space(c)), first, "$1@" + alias.main)


def name_key(c: Column) -> Column:
    """Letters only, so case, punctuation and spacing do not matter."""
    return F.trim(F.regexp_replace(F.lower(null_to_blank(c)), "[^a-z]+", " "))


def one_line(c: Column, limit: int) -> Column:
    """Fold line breaks and tabs into single spaces and cut at `limit` characters."""
    return F.substring(F.regexp_replace(null_to_blank(c), r"[\r\n\t]+", " "), 1, limit)


def one_line_trimmed(c: Column, limit: int) -> Column:
    folded = F.regexp_replace(null_to_blank(c), r"[\r\n\t]+", " ")
    return F.substring(strip_space(folded), 1, limit)


def path_safe(c: Column) -> Column:
    return F.substring(F.regexp_replace(null_to_blank(c), "[^a-zA-Z0-9._-]", "_"), 1, 120)


def word_list(c: Column) -> Column:
    """Lower-cased items of a comma- or space-separated list, blanks dropped."""
    return F.filter(F.split(F.lower(null_to_blank(c)), r"[,\s]+"), lambda x: x != "")


def matches_any(c: Column, patterns: tuple[str, ...]) -> Column:
    """Case-blind LIKE against any of the patterns; NULL text matches none."""
    if not patterns:
        return F.lit(False)
    text = null_to_blank(c)
    return reduce(or_, [text.ilike(p) for p in patterns])


def column_key(name: str) -> str:
    """`"Lead ID "` becomes `lead_id`."""
    return re.sub(r"^_|_$", "", re.sub(r"[^a-z0-9]+", "_", name.strip().lower()))

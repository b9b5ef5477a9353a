"""How queries are registered next to the SQL they must agree with."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks import oracle_org  # noqa: F401  (adds its fragments)
from checks.oracle_crm import with_parts
from leadsieve.functions.times import iso_text

QUERIES: dict = {}
SQL: dict[str, str] = {}


def register(name: str, sql: str | None, parts: dict[str, str] | None = None):
    def keep(fn):
        if name in QUERIES:
            raise ValueError(f"{name} is registered twice")
        QUERIES[name] = fn
        if sql is not None:
            SQL[name] = with_parts(sql, parts)
        return fn

    return keep


def texts(df: DataFrame) -> DataFrame:
    """Instants as ISO text and days as text, so that both engines print them alike."""
    kinds = dict(df.dtypes)
    cols = []
    for c in df.columns:
        if kinds[c] == "timestamp":
            cols.append(iso_text(F.col(c)).alias(c))
        elif kinds[c] == "date":
            cols.append(F.col(c).cast("string").alias(c))
        else:
            cols.append(F.col(c))
    return df.select(*cols)

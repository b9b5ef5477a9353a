"""Scans of the five base tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from leadsieve.plans.queue import CrmTables
from leadsieve.sources.schemas import BASE_TABLES


def typed(df: DataFrame, schema: StructType) -> DataFrame:
    """Columns in schema order. A stored time without a zone is taken as UTC."""
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema.fields])


def read_tables(spark: SparkSession, root: str) -> CrmTables:
    """Parquet folders named after the tables."""
    frames = {name: typed(spark.read.parquet(f"{root}/{name}"), schema) for name, schema in BASE_TABLES.items()}
    return as_tables(frames)


def read_jdbc_tables(
    spark: SparkSession, url: str, options: dict[str, str], split_on: dict[str, dict[str, str]]
) -> CrmTables:
    """The same tables from a database; `split_on` gives each table's partitioning options.

    Filters and column choices reach the database as part of its query.
    """
    frames = {}
    for name, schema in BASE_TABLES.items():
        reader = spark.read.format("jdbc").option("url", url).option("dbtable", name).options(**options)
        frames[name] = typed(reader.options(**split_on.get(name, {})).load(), schema)
    return as_tables(frames)


def as_tables(frames: dict[str, DataFrame]) -> CrmTables:
    return CrmTables(
        lead=frames["lead"],
        history=frames["lead_history"],
        call_log=frames["call_log"],
        geo=frames["geo"],
        users=frames["users"],
    )

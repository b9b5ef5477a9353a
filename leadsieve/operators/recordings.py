"""The store of call recordings, read as a listing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsieve.functions.text import null_to_blank, path_safe
from leadsieve.sources.schemas import AUDIO_EXTENSIONS

STORED = r"recordings/([^/]+)/(\d+)-([^/]+)$"


def list_files(spark: SparkSession, root: str) -> DataFrame:
    """(path, size, stored_at) of the files under a folder; contents are never read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return files.select("path", F.col("length").alias("size"), F.col("modificationTime").alias("stored_at"))


def is_audio(content_type: Column, name: Column) -> Column:
    """Any audio type, three video containers, or a known audio extension."""
    plain = F.regexp_extract(null_to_blank(content_type), "^([^;]*)", 1)
    extension = F.lower(F.element_at(F.split(null_to_blank(name), r"\."), -1))
    return plain.startswith("audio/") | plain.rlike("^video/(mp4|webm|3gpp)$") | extension.isin(*AUDIO_EXTENSIONS)


def inventory(listing: DataFrame) -> DataFrame:
    """Stored recordings with lead, upload time and file name taken from the path."""
    kind = F.col("content_type") if "content_type" in listing.columns else F.lit("")
    parts = listing.withColumns(
        {
            "lead_key": F.regexp_extract("path", STORED, 1),
            "uploaded_at": F.timestamp_millis(F.regexp_extract("path", STORED, 2).try_cast("bigint")),
            "name": F.regexp_extract("path", STORED, 3),
        }
    )
    return parts.filter((F.col("lead_key") != "") & is_audio(kind, F.col("name")))


def orphaned(recordings: DataFrame, reviews: DataFrame) -> DataFrame:
    """Recordings that no review points at.

    The listing has paths of one store and the log has public addresses, so both are compared from
    the `recordings/` folder on.
    """
    tail = lambda c: F.regexp_extract(c, STORED, 0)
    linked = reviews.select(tail("recording_url").alias("_tail")).filter(F.col("_tail") != "").distinct()
    return recordings.withColumn("_tail", tail("path")).join(linked, "_tail", "left_anti").drop("_tail")


def of_leads(recordings: DataFrame, leads: DataFrame, reviews: DataFrame | None = None) -> DataFrame:
    """Recordings with their lead; folders carry the path-safe form of the lead id.

    Where the review log names one lead of that form for a recording, it belongs to that lead only.
    Otherwise every lead of the form gets it, and `ambiguous` tells that there is more than one.
    """
    keys = leads.select("lead_id", path_safe(F.col("lead_id")).alias("lead_key"))
    shared = keys.groupBy("lead_key").agg((F.min("lead_id") != F.max("lead_id")).alias("ambiguous"))
    found = recordings.join(keys.join(shared, "lead_key"), "lead_key")
    if reviews is None:
        return found
    tail = lambda c: F.regexp_extract(c, STORED, 0)
    named = reviews.select(tail("recording_url").alias("_tail"), F.col("lead_id").alias("_lead"))
    named = named.filter(F.regexp_extract("_tail", STORED, 1) == path_safe(F.col("_lead")))
    owners = named.groupBy("_tail").agg(F.min("_lead").alias("_owner"), F.max("_lead").alias("_other")).filter("_owner = _other")
    found = found.withColumn("_tail", tail("path")).join(owners, "_tail", "left").filter("_owner IS NULL OR _owner = lead_id")
    return found.withColumn("ambiguous", F.col("ambiguous") & F.col("_owner").isNull()).drop("_tail", "_owner", "_other")

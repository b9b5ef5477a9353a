"""CRM tables derived from the driver's star schema by integer arithmetic.

`checks.oracle` states the same derivation in SQL. One lead per order, one history event per
line item, one dial per event, one employee and one place per supplier. Every row of the
driver's tables takes part.
"""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from leadsieve.config import Clock
from leadsieve.plans.queue import CrmTables, build_queue
from leadsieve.session import scratch_path
from leadsieve.sources.schemas import RCA_COLUMNS
from leadsieve.sources.snapshot import replace_day

AS_OF = datetime(2024, 1, 31, 9, 30, tzinfo=timezone.utc)
CLOCK = Clock(AS_OF)
EPOCH = int(AS_OF.timestamp())

STAGES = (
    "Assigned",
    "Lead - Not Interested",
    "Call Later",
    "Meeting Confirmed - Customer Home",
    "Lead - Not Qualified",
    "Meeting Scheduled (BD)",
    "Call Not Connected",
    "Future Followup Required",
    "Meeting Done - Hot",
    "Meeting - Not Qualified",
    "Followup On Call",
    "Meeting Rescheduled",
    "On-Hold",
    "Meeting - Not Interested",
    " call later ",
    "DEV Scheduled",
    "Design Created",
    "Speed Order",
    "NI",
    "NQ",
    "",
    "DEV Done",
    "Lost In Qualification",
)
#: A third of the leads and of the dials are on this number; the others grow with the tables.
HOT_PHONE = 7
CALL_TYPES = ("Manual", "Progressive", "IVR", "Inbound")
TIMES = ("09:30 AM", "9:30pm", "13:00 PM", "soon")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ago(days: Column | int, hours: Column | int = 0) -> Column:
    """AS_OF minus whole days and hours; a negative count looks ahead."""
    seconds = F.lit(days).cast("bigint") * 86400 + F.lit(hours).cast("bigint") * 3600
    return F.timestamp_seconds(F.lit(EPOCH) - seconds)


def iso(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'Z'")


def nth(values: tuple[str, ...], index: Column) -> Column:
    return F.element_at(F.array(*[F.lit(v) for v in values]), (index + 1).cast("int"))


def padded(n: Column) -> Column:
    return F.lpad(n.cast("string"), 8, "0")


def lead(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    day = k * 37 % 300
    pin = (c % 30).cast("string")
    return table(spark, sf_dir, "orders").select(
        F.concat(F.lit("L"), k).alias("lead_id"),
        F.when(k % 41 == 0, 1).when(k % 3 == 0, 0).cast("int").alias("is_delete"),
        F.when(k % 43 == 0, 1).cast("int").alias("customer_is_delete"),
        ago(day, k % 24).alias("created_at"),
        F.greatest(ago(day), ago(k * 11 % 60)).alias("updated_at"),
        F.when(k % 29 == 0, "Booked")
        .when(k % 31 == 0, "Closed - Won")
        .when(k % 13 == 0, "Closed - Not Interested")
        .when(k % 17 == 0, "Closed - Not Qualified")
        .when(F.col("o_orderstatus") == "F", "Closed - Lost")
        .when(k % 7 != 0, "Open")
        .alias("status"),
        F.when(k % 37 == 0, "Order Confirmed")
        .when(k % 53 == 0, "Booking Processing")
        .when(k % 59 != 0, nth(STAGES, k % len(STAGES)))
        .alias("stage"),
        F.col("o_orderpriority").alias("customer_first_name"),
        F.when(k % 4 == 0, "M").alias("customer_middle_name"),
        F.concat(F.lit("C"), c).alias("customer_last_name"),
        F.when(k % 19 != 0, F.concat(F.lit("+91 98"), padded(F.when(k % 3 == 0, HOT_PHONE).otherwise(c)))).alias("customer_phone_number"),
        F.when(k % 23 != 0, F.concat(F.lit("s"), c % 100)).alias("assigned_lrm"),
        F.when(k % 27 == 0, "n/a").when(k % 5 != 0, iso(ago(k * 5 % 40, k % 7))).alias("lrm_assigned_at"),
        F.when(k % 2 == 0, F.when(k % 5 == 0, F.concat(pin, F.lit(" "))).otherwise(pin))
        .when(k % 9 == 0, " ")
        .alias("site_address_pin_code"),
        F.when(k % 3 == 0, pin).alias("meeting_address_pin_code"),
        F.when(k % 11 < 6, F.concat(F.lit(" Town "), c % 12)).alias("site_address_city"),
        F.when(k % 11 < 9, F.concat(F.lit("Plaza "), c % 9)).alias("meeting_address_city"),
        F.when(k % 3 == 0, ago(28 - k * 17 % 41)).alias("reschedule_date"),
        F.when(k % 5 < 4, nth(TIMES, F.least(k % 5, F.lit(3)))).alias("reschedule_time"),
        F.when(k % 4 == 1, ago(24 - k * 19 % 31)).alias("lrm_queue_entry_next_action_at"),
        F.when(k % 5 == 2, ago(24 - k * 23 % 31)).alias("follow_up_datetime"),
        F.when(k % 4 == 0, iso(ago(k % 90))).when(k % 4 == 1, "31/01/2024").alias("qualified_datetime"),
        F.when(k % 5 == 0, ago(k % 50)).alias("order_closure_datetime"),
        F.when(k % 17 == 0, ago(k * 7 % 60)).alias("first_meeting_done_date"),
        F.when(k % 6 == 0, 1).when(k % 6 < 5, 0).cast("int").alias("lrm_queue_entry_attempts_today"),
    )


def lead_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, pk = F.col("l_orderkey"), F.col("l_partkey")
    n = F.col("l_linenumber").cast("bigint")
    stage = nth(STAGES, (pk + n * 5) % len(STAGES))
    return table(spark, sf_dir, "lineitem").select(
        F.concat_ws("-", padded(k), padded(n), padded(pk)).alias("event_id"),
        F.concat(F.lit("L"), k).alias("lead_id"),
        ago((k * 13 + n * 29 + pk) % 90, pk % 24).alias("created_at"),
        stage.alias("stage"),
        F.when((pk + n) % 6 == 0, "CNC 2").when((pk + n) % 6 == 1, "Could not connect").alias("status"),
        F.when(stage.startswith("Meeting Confirmed"), ago(pk % 30)).alias("meeting_confirmed_datetime"),
        F.when((pk + n) % 4 == 0, ago(22 - pk % 37)).alias("meeting_schedule_date"),
        F.when((pk + n) % 9 == 0, ago(24 - pk % 37)).alias("meeting_done_date"),
    )


def call_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    return table(spark, sf_dir, "events").select(
        F.concat(F.lit("098"), padded(F.when(e % 3 == 0, HOT_PHONE).otherwise(F.col("user_id")))).alias("call_to"),
        F.when(e % 97 == 0, "not dialled").otherwise(at).alias("created_at"),
        F.when(
            e % 11 != 0,
            F.concat(F.lit("00:00:"), F.lpad((F.floor("value") % 60).cast("string"), 2, "0")),
        ).alias("response_call_duration"),
        nth(CALL_TYPES, e % 4).alias("call_type"),
    )


def geo(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, pin = F.col("s_suppkey"), F.col("s_nationkey").cast("string")
    return table(spark, sf_dir, "supplier").select(
        F.when(s % 5 == 0, F.concat(pin, F.lit(" "))).otherwise(pin).alias("pin_code"),
        F.when(s % 6 != 0, F.concat(F.lit("Zone "), s % 7)).alias("cluster"),
        F.concat(F.lit("City "), pin).alias("city"),
        F.when(s % 7 == 0, "inactive").otherwise("active").alias("pincode_status"),
        F.when(s % 13 == 0, 1).when(s % 2 == 0, 0).cast("int").alias("is_delete"),
    )


def supplier_mail() -> Column:
    """Mixed case; every fourth address is on the alias domain; every eleventh is missing."""
    s = F.col("s_suppkey")
    domain = F.when(s % 4 == 0, "@homes.example.com").otherwise("@example.com")
    return F.when(s % 11 != 0, F.concat(F.lit("Rep."), s, domain))


def supplier_first_name() -> Column:
    """Two words of letters that differ for every key, so a name key can find its owner."""
    return F.concat(F.lit("Rep "), F.translate(F.col("s_suppkey").cast("string"), "0123456789", "abcdefghij"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = F.col("s_suppkey")
    return table(spark, sf_dir, "supplier").select(
        F.concat(F.lit("s"), s).alias("user_id"),
        supplier_first_name().alias("first_name"),
        F.when(s % 3 != 0, F.concat(F.lit("of "), F.translate(F.col("s_nationkey").cast("string"), "0123456789", "abcdefghij"))).alias("last_name"),
        supplier_mail().alias("emails"),
    )


def crm_tables(spark: SparkSession, sf_dir: str) -> CrmTables:
    return CrmTables(
        lead=lead(spark, sf_dir),
        history=lead_history(spark, sf_dir),
        call_log=call_log(spark, sf_dir),
        geo=geo(spark, sf_dir),
        users=users(spark, sf_dir),
    )


_SNAPSHOTS: dict[tuple[str, str], str] = {}


def queue_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The written queue of the day, which everything downstream of the export reads.

    The first query of a session that asks for it writes it.
    """
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _SNAPSHOTS:
        path = scratch_path(spark, "queue")
        replace_day(build_queue(crm_tables(spark, sf_dir), CLOCK, sort=False), path)
        _SNAPSHOTS[key] = path
    return spark.read.parquet(_SNAPSHOTS[key])


# ---- reporting chain, reviews, recordings, runs ----------------------------------------


def letters(n: Column) -> Column:
    return F.translate(n.cast("string"), "0123456789", "abcdefghij")


def hierarchy_sheet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The reporting sheet under its own headers: a row per supplier, and a later second row
    of another team lead for suppliers in debt. Every 13th has no address."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    chain = table(spark, sf_dir, "supplier").join(
        F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey")
    )
    zone = F.when(s % 5 != 0, F.concat(F.lit("Zone "), s % 7)).otherwise("")

    def rows(df: DataFrame, first: int, nation: Column) -> DataFrame:
        lead_mail = F.concat(F.lit("tl."), nation, F.lit("@homes.example.com"))
        return df.select(
            (F.lit(first) + s).alias("seq"),
            F.when(s % 13 != 0, F.concat(F.lit(" Rep."), s, F.lit("@Example.com"))).otherwise("").alias("Email IDs"),
            F.concat(
                F.lit("REP-"), letters(s), F.when(s % 3 != 0, F.concat(F.lit(" -- Of  "), letters(n))).otherwise("")
            ).alias("LRM Name"),
            F.concat(F.lit("E"), s).alias("SSEID"),
            zone.alias("Cluster"),
            F.concat(F.lit("City "), n).alias("City"),
            F.when(s % 9 != 0, lead_mail).otherwise("").alias("LRM TL Email ID"),
            F.upper(lead_mail).alias("TL Email"),
            F.concat(F.lit("Lead "), nation).alias("TL Name"),
            F.concat(F.lit("zsm."), F.col("n_regionkey"), F.lit("@example.com")).alias("DZSM"),
            F.concat(F.lit("ados."), F.col("n_regionkey") % 2, F.lit("@example.com")).alias("ADOS Email"),
            F.when(s % 17 == 0, "Inactive").when(s % 4 == 0, "").otherwise("Active").alias("HR Status"),
        )

    return rows(chain, 0, n).unionByName(rows(chain.filter(F.col("s_acctbal") < 0), 10_000_000, (n + 1) % 25))


def mapping_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two override rows for each supplier in good standing; the second has other gaps."""
    s = F.col("s_suppkey")
    rich = table(spark, sf_dir, "supplier").filter(F.col("s_acctbal") > 5000)
    mail = F.concat(F.lit("REP."), s, F.lit("@homes.example.com"))

    def rows(second: int, fields: dict[str, Column]) -> DataFrame:
        return rich.select(
            (s * 2 + second).alias("seq"),
            mail.alias("lrm_email"),
            *[
                fields.get(f, F.lit("")).alias(f)
                for f in (
                    "lrm_name", "tl_email", "tl_name", "zsm_email", "zsm_name",
                    "ados_email", "ados_name", "cluster", "hr_status",
                )
            ],
            F.lit("admin@example.com").alias("updated_by"),
            F.concat(F.lit("2024-01-0"), F.lit(second + 1)).alias("updated_at"),
        )

    first = {
        "lrm_name": F.concat(F.lit("Patched "), letters(s)),
        "tl_email": F.when(s % 2 == 0, F.concat(F.lit("TL."), s % 7, F.lit("@homes.example.com"))).otherwise(""),
        "cluster": F.concat(F.lit(" Patch\n"), s % 5),
        "hr_status": F.when(s % 19 == 0, "INACTIVE").otherwise(""),
    }
    later = {
        "tl_name": F.when(s % 2 == 0, F.concat(F.lit("Lead "), s % 7)).otherwise(""),
        "zsm_email": F.when(s % 8 == 0, "Zsm.9@example.com").otherwise(""),
        "cluster": F.when(s % 3 == 0, F.concat(F.lit("Patch B"), s % 5)).otherwise(""),
    }
    return rows(0, first).unionByName(rows(1, later))


ACCESS_CYCLE = ("tl", "zsm", "none", "auditor", "ados", "admin", "", "TL")


def access_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    email = (
        F.when(s % 5 == 0, F.concat(F.lit("TL."), n, F.lit("@homes.example.com")))
        .when(s % 5 == 1, F.concat(F.lit("zsm."), n % 7, F.lit("@example.com")))
        .otherwise(F.concat(F.lit("rep."), s, F.lit("@example.com")))
    )
    return table(spark, sf_dir, "supplier").select(
        s.alias("seq"),
        email.alias("email"),
        nth(ACCESS_CYCLE, s % 8).alias("role"),
        F.lit("").alias("scope"),
        F.concat(F.lit("note\n"), s).alias("note"),
        F.lit("admin@example.com").alias("updated_by"),
        F.lit("2024-01-02").alias("updated_at"),
    )


ADMINS = ("Boss@example.com", "ados.1@example.com")


def viewers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everybody who could sign in: reps, team leads and their managers."""
    s, n = F.col("s_suppkey"), F.col("s_nationkey")
    kinds = F.array(
        F.concat(F.lit("Rep."), s, F.lit("@example.com")),
        F.concat(F.lit("tl."), n, F.lit("@homes.example.com")),
        F.concat(F.lit("zsm."), s % 8, F.lit("@example.com")),
        F.concat(F.lit("ados."), s % 3, F.lit("@example.com")),
    )
    return table(spark, sf_dir, "supplier").select(F.explode(kinds).alias("viewer_email"))


def review_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of urgent orders, a second one for those part-shipped, and one per chat turn."""
    k = F.col("o_orderkey")
    urgent = table(spark, sf_dir, "orders").filter(F.col("o_orderpriority").isin("1-URGENT", "2-HIGH"))

    def rows(df: DataFrame, seq: Column, fields: dict[str, Column]) -> DataFrame:
        return df.select(
            seq.cast("bigint").alias("seq"), *[fields.get(c, F.lit("")).alias(c) for c in RCA_COLUMNS]
        )

    first = {
        "logged_at": iso(ago(k % 3, k % 5)),
        "audit_date": F.when(k % 4 != 0, "2024-01-31").when(k % 8 == 4, "2024-01-30T09:30:00Z").otherwise(""),
        "lead_id": F.concat(F.lit("L"), k),
        "tl_email": F.concat(F.lit("tl."), F.col("o_custkey") % 25, F.lit("@example.com")),
        "reason": F.lit("No call back"),
        "review_verdict": F.when(k % 5 == 0, "Needs rework").when(k % 5 < 3, "Accepted").otherwise(""),
        "reviewer_email": F.concat(F.lit("qa."), k % 3, F.lit("@example.com")),
        "recording_url": F.when(k % 6 == 0, recording_path()).otherwise(""),
    }
    again = {**first, "reason": F.lit("Second look"), "review_verdict": F.lit("needs Rework again")}
    conv, turn = F.col("conv_id"), F.col("turn")
    chat = {
        "logged_at": iso(F.timestamp_seconds(F.lit(EPOCH) - (20 - turn) * 60)),
        "audit_date": F.date_format(ago(conv % 60), "yyyy-MM-dd"),
        "lead_id": F.concat(F.lit("L"), conv),
        "tl_email": F.concat(F.lit("tl."), conv % 25, F.lit("@example.com")),
        "reason": F.col("role"),
        "note": F.col("text"),
        "reviewer_email": F.lit("qa.0@example.com"),
    }
    return (
        rows(urgent, k, first)
        .unionByName(rows(urgent.filter(F.col("o_orderstatus") == "P"), k + 1_000_000_000, again))
        .unionByName(rows(table(spark, sf_dir, "conversations"), conv * 1000 + turn + 2_000_000_000, chat))
    )


EXTENSIONS = ("mp3", "txt", "MP4", "pdf", "wav")
CONTENT_TYPES = ("audio/mpeg; rate=8", "application/octet-stream", "video/mp4", "video/x", "text/plain", "", "audio/wav")


def recording_path() -> Column:
    k = F.col("o_orderkey")
    return F.concat(
        F.lit("store/recordings/L"), k, F.lit("/"), k + 1_700_000_000_000, F.lit("-call_"), k % 9,
        F.lit("."), nth(EXTENSIONS, k % 5),
    )


def recording_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        recording_path().alias("path"),
        (k * 37 % 1000 + 1).alias("size"),
        nth(CONTENT_TYPES, k % 7).alias("content_type"),
    )


def run_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One export run per hour of events; purchases stand for exported rows."""
    hour = F.date_trunc("hour", F.col("ts").cast("timestamp"))
    return (
        table(spark, sf_dir, "events")
        .groupBy(hour.alias("run_at"))
        .agg(
            F.count_if(F.col("event_type") == "purchase").alias("rows"),
            F.when(F.min("event_id") % 13 == 0, "timeout").otherwise("").alias("error"),
            (F.count_if(F.col("event_type") == "error") % 5 == 4).cast("int").alias("missing_columns"),
        )
    )

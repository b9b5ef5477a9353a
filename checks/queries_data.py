"""Registered queries: readers, kept tables, censuses, probes and verdicts."""

from __future__ import annotations

from datetime import timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import crm_views as crm
from checks.oracle_crm import AS_OF, digits_of, iso, mail_key
from checks.queries_queue import scoped
from checks.registration import register, texts
from leadsieve.config import Clock
from leadsieve.operators import calls, quality, review
from leadsieve.operators.enrich import user_names
from leadsieve.operators.rules import COLUMNS_V7_8
from leadsieve.session import scratch_path
from leadsieve.sources import records, schemas, snapshot, tables

CLOCK = crm.CLOCK


def union_all(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for frame in frames[1:]:
        out = out.unionByName(frame)
    return out


# ---- readers ---------------------------------------------------------------------------


@register(
    "src_tables",
    """SELECT 'lead' AS table_name, count(*) AS n_rows, count(stage) AS filled FROM crm_lead
    UNION ALL SELECT 'lead_history', count(*), count(meeting_schedule_date) FROM crm_event
    UNION ALL SELECT 'call_log', count(*), count(response_call_duration) FROM crm_call
    UNION ALL SELECT 'geo', count(*), count(cluster) FROM crm_geo
    UNION ALL SELECT 'users', count(*), count(emails) FROM crm_user""",
)
def src_tables(spark, sf_dir):
    """Write the five tables as parquet and scan them back under their schemas."""
    root = scratch_path(spark, "tables")
    made = crm.crm_tables(spark, sf_dir)
    stored = {
        "lead": made.lead, "lead_history": made.history, "call_log": made.call_log, "geo": made.geo, "users": made.users
    }
    for name, df in stored.items():
        df.write.parquet(f"{root}/{name}")
    read = tables.read_tables(spark, root)
    counted = {
        "lead": (read.lead, "stage"),
        "lead_history": (read.history, "meeting_schedule_date"),
        "call_log": (read.call_log, "response_call_duration"),
        "geo": (read.geo, "cluster"),
        "users": (read.users, "emails"),
    }
    return union_all(
        [
            df.agg(
                F.lit(name).alias("table_name"), F.count(F.lit(1)).alias("n_rows"), F.count(column).alias("filled")
            )
            for name, (df, column) in counted.items()
        ]
    )


@register(
    "src_card_json",
    f"""SELECT lead_id, {iso('created_at')} AS created_at, status AS lead_status, stage AS lead_stage,
    assigned_lrm AS lrm_id FROM crm_lead""",
)
def src_card_json(spark, sf_dir):
    path = scratch_path(spark, "card")
    card = crm.lead(spark, sf_dir).select(
        F.col("lead_id").alias("Lead ID"),
        crm.iso(F.col("created_at")).alias(" Created At"),
        F.col("status").alias("(Lead) Status"),
        F.col("stage").alias("Lead  Stage"),
        F.col("assigned_lrm").alias("LRM Id"),
    )
    card.write.json(path)
    contract = schemas.columns("lead_id STRING, created_at STRING, lead_status STRING, lead_stage STRING, lrm_id STRING")
    return records.unbroken(records.read_card(spark, path, contract))


SHEET_SQL = """SELECT trim(email_ids) AS lrm_email_cell, lrm_name, cluster_head AS cluster, city_head AS city,
    lrm_tl_head AS tl_cell, hr_head AS hr_status FROM org_sheet"""


def written_sheet(spark: SparkSession, sf_dir: str) -> str:
    path = scratch_path(spark, "sheet")
    sheet = crm.hierarchy_sheet(spark, sf_dir).drop("seq").withColumnRenamed("Cluster", " Cluster ")
    sheet.write.option("header", True).csv(path)
    return path


def sheet_cells(df: DataFrame) -> DataFrame:
    return df.select(
        F.trim("Email IDs").alias("lrm_email_cell"),
        F.col("LRM Name").alias("lrm_name"),
        F.col("Cluster").alias("cluster"),
        F.col("City").alias("city"),
        F.col("LRM TL Email ID").alias("tl_cell"),
        F.col("HR Status").alias("hr_status"),
        *[c for c in ("source",) if c in df.columns],
    )


@register("src_sheet_records", SHEET_SQL)
def src_sheet_records(spark, sf_dir):
    return sheet_cells(records.read_sheet(spark, written_sheet(spark, sf_dir)))


SHEET_CARD = schemas.columns(
    "email_ids STRING, lrm_name STRING, cluster STRING, city STRING, lrm_tl_email_id STRING, hr_status STRING"
)


def card_or_sheet(spark: SparkSession, sf_dir: str, lines: DataFrame | None) -> DataFrame:
    """The sheet's rows from a card of these lines (none: the card is absent), else from the sheet."""
    card, sheet = scratch_path(spark, "card"), written_sheet(spark, sf_dir)
    if lines is not None:
        lines.write.text(card)

    def from_card() -> DataFrame:
        cells = records.read_card(spark, card, SHEET_CARD)
        named = ["Email IDs", "LRM Name", "Cluster", "City", "LRM TL Email ID", "HR Status", *cells.columns[len(SHEET_CARD) :]]
        return cells.toDF(*named)

    return sheet_cells(records.with_fallback(from_card, lambda: records.read_sheet(spark, sheet)))


def sheet_as_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheet = crm.hierarchy_sheet(spark, sf_dir)
    return sheet.select("seq", F.to_json(F.struct(*[c for c in sheet.columns if c != "seq"])).alias("value"))


@register("src_fallback", SHEET_SQL.replace("SELECT ", "SELECT 'sheet' AS source, "))
def src_fallback(spark, sf_dir):
    """The card's path does not exist, so its schema cannot be read and the sheet steps in."""
    return card_or_sheet(spark, sf_dir, None)


@register("src_fallback_card", SHEET_SQL.replace("SELECT ", "SELECT 'card' AS source, "))
def src_fallback_card(spark, sf_dir):
    """The card can be read and keeps its contract."""
    return card_or_sheet(spark, sf_dir, sheet_as_json(spark, sf_dir).select("value"))


@register("src_fallback_broken", SHEET_SQL.replace("SELECT ", "SELECT 'sheet' AS source, "))
def src_fallback_broken(spark, sf_dir):
    """Some records of the card are cut off half-way, which shows only while its rows are read."""
    cut = F.when(F.col("seq") % 50 == 7, F.substring("value", 1, 40)).otherwise(F.col("value"))
    return card_or_sheet(spark, sf_dir, sheet_as_json(spark, sf_dir).select(cut.alias("value")))


def chat_reviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    given = {
        "lead_id": F.concat(F.lit("L"), F.col("conv_id")),
        "reason": F.col("role"),
        "note": F.col("text"),
        "audit_date": F.date_format(crm.ago(F.col("conv_id") % 60), "yyyy-MM-dd"),
        "reviewed_at": F.col("turn").cast("string"),
    }
    items = crm.table(spark, sf_dir, "conversations").select(
        *[given.get(c, F.lit(None).cast("string")).alias(c) for c in schemas.RCA_COLUMNS]
    )
    return review.new_reviews(items, "2024-01-31T09:30:00Z")


@register(
    "src_positional_records",
    """SELECT 'L' || conv_id AS lead_id, role AS reason, '' || turn AS reviewed_at,
    length(left(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), 900)) AS note_chars, 'open' AS action_status
    FROM conversations""",
)
def src_positional_records(spark, sf_dir):
    """Stored cells under an outdated header row: the names shift, the positions do not."""
    path = scratch_path(spark, "log")
    rows = chat_reviews(spark, sf_dir)
    old_names = ["lead_id", *[f"old_{i}" for i in range(1, len(rows.columns))]]
    writer = rows.toDF(*old_names).write.option("header", True).option("emptyValue", "")
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    log = records.read_positional(spark, path, schemas.RCA_LOG)
    return log.select("lead_id", "reason", "reviewed_at", F.length("note").alias("note_chars"), "action_status")


@register(
    "alias_columns",
    """SELECT email_ids AS lrm_email, lrm_name, sseid, coalesce(nullif(cluster_head, ''), city_head) AS cluster,
    coalesce(nullif(lrm_tl_head, ''), tl_head) AS tl_email, tl_name, dzsm AS zsm_email, '' AS zsm_name,
    ados_head AS ados_email, '' AS ados_name, hr_head AS hr_status FROM org_sheet""",
)
def alias_columns(spark, sf_dir):
    return records.alias_columns(crm.hierarchy_sheet(spark, sf_dir)).drop("seq")


@register(
    "coerce_queue_rows",
    f"""SELECT 'L' || o_orderkey AS lead_id,
      ['mcch_past','followup_missed','not_qualified','mcch_future'][(o_orderkey % 5)::INT] AS category,
      {mail_key("' REP.' || o_custkey || '@HOMES.example.com '")} AS lrm_email,
      CAST(CASE o_orderkey % 6 WHEN 0 THEN 1000 + o_custkey % 1000 WHEN 1 THEN 0 WHEN 2 THEN 0
        WHEN 3 THEN o_custkey WHEN 4 THEN -(o_custkey % 100) ELSE 2500 END AS BIGINT) AS days_overdue,
      o_orderkey % 4 IN (0, 1) AS attempt_today,
      if(o_orderkey % 3 = 0, NULL, '2024-01-01T00:00:00Z') AS follow_up_at, '' AS lead_stage,
      'O' || o_custkey AS lead_object_id, if(o_orderkey % 7 = 0, NULL, '2024-01-02T00:00:00Z') AS order_closed_at,
      CAST(NULL AS VARCHAR) AS crm_touch_at
    FROM orders WHERE o_orderkey % 5 <> 0""",
)
def coerce_queue_rows(spark, sf_dir):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = crm.table(spark, sf_dir, "orders").select(
        F.concat(F.lit("L"), k).alias("lead_id"),
        crm.nth(("", "mcch_past", "followup_missed", "not_qualified", "mcch_future"), k % 5).alias("category"),
        F.concat(F.lit(" REP."), c, F.lit("@HOMES.example.com ")).alias("lrm_email"),
        F.when(k % 6 == 0, F.concat(F.lit("1,"), F.lpad((c % 1000).cast("string"), 3, "0")))
        .when(k % 6 == 1, "")
        .when(k % 6 == 2, "n/a")
        .when(k % 6 == 3, F.concat(F.lit(" "), c))
        .when(k % 6 == 4, F.concat(F.lit("-"), c % 100))
        .otherwise("2.5e3")
        .alias("days_overdue"),
        crm.nth(("TRUE", "true", "1", "FALSE"), k % 4).alias("attempt_today"),
        F.when(k % 3 != 0, "2024-01-01T00:00:00Z").otherwise("").alias("follow_up_at"),
        F.lit(None).cast("string").alias("lead_stage"),
        F.concat(F.lit("O"), c).alias("lead_object_id"),
        F.when(k % 7 != 0, "2024-01-02T00:00:00Z").otherwise("").alias("order_closed_at"),
    )
    typed = records.coerce_queue(rows)
    return typed.select(
        "lead_id", "category", "lrm_email", F.col("days_overdue").cast("bigint").alias("days_overdue"),
        "attempt_today", "follow_up_at", "lead_stage", "lead_object_id", "order_closed_at", "crm_touch_at",
    )


@register(
    "src_demo_json",
    "SELECT lead_id, category, priority_key, lrm_category_rank AS category_rank FROM queue_row",
)
def src_demo_json(spark, sf_dir):
    """Sample rows as JSON arrays in the first version's column names, an array per owner and
    category, which the rank cap keeps short."""
    path = scratch_path(spark, "demo")
    rows = crm.queue_snapshot(spark, sf_dir).select(
        "lrm_id", "lead_id", "category", "priority_key", F.col("lrm_category_rank").alias("category_rank")
    )
    shown = ["lead_id", "category", "priority_key", "category_rank"]
    arrays = rows.groupBy("lrm_id", "category").agg(F.to_json(F.collect_list(F.struct(*shown))).alias("value"))
    arrays.select("value").write.text(path)
    contract = schemas.columns("lead_id STRING, category STRING, priority_key DOUBLE, category_rank BIGINT")
    return records.unbroken(records.read_card(spark, path, contract)).select(*shown)


# ---- kept tables -----------------------------------------------------------------------

DAYS_SQL = """
WITH day_row AS (SELECT strftime(ts, '%Y-%m-%d') AS audit_date, count(*) AS n, sum(event_id) AS ids
FROM events GROUP BY 1) """


def event_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts").cast("timestamp")
    return crm.table(spark, sf_dir, "events").select(
        F.to_date(ts).alias("audit_date"), "event_id", "user_id", "value", F.lit("first").alias("run")
    )


def days_of(df: DataFrame) -> DataFrame:
    return df.groupBy(F.col("audit_date").cast("string").alias("audit_date"), "run").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )


LATE = "2024-01-20"


@register(
    "snapshot_replace",
    DAYS_SQL + f"SELECT audit_date, if(audit_date >= '{LATE}', 'second', 'first') AS run, n, ids FROM day_row",
)
def snapshot_replace(spark, sf_dir):
    """A second run of some days replaces exactly those."""
    path = scratch_path(spark, "queue")
    rows = event_days(spark, sf_dir)
    snapshot.replace_day(rows, path)
    snapshot.replace_day(rows.filter(F.col("audit_date") >= LATE).withColumn("run", F.lit("second")), path)
    return days_of(spark.read.parquet(path))


@register(
    "snapshot_once",
    DAYS_SQL + f"SELECT audit_date, if(audit_date >= '{LATE}', 'second', 'first') AS run, n, ids FROM day_row",
)
def snapshot_once(spark, sf_dir):
    """A second run adds only the days that were not kept yet."""
    path = scratch_path(spark, "queue")
    rows = event_days(spark, sf_dir)
    snapshot.write_once(rows.filter(F.col("audit_date") < LATE), path)
    snapshot.write_once(rows.withColumn("run", F.lit("second")), path)
    return days_of(spark.read.parquet(path))


@register(
    "log_append",
    DAYS_SQL + """SELECT audit_date, exported_at, n, ids FROM day_row,
    (VALUES ('2024-01-31T09:30:00Z'), ('2024-01-31T10:30:00Z')) AS t(exported_at)""",
)
def log_append(spark, sf_dir):
    """Two runs of the same days are both kept, apart by `exported_at`."""
    path = scratch_path(spark, "log")
    rows = event_days(spark, sf_dir)
    snapshot.append_log(rows, path, CLOCK.as_of)
    snapshot.append_log(rows, path, CLOCK.as_of + timedelta(hours=1))
    counts = spark.read.parquet(path).groupBy("audit_date", "exported_at").agg(
        F.count(F.lit(1)).alias("n"), F.sum("event_id").alias("ids")
    )
    return texts(counts)


@register(
    "log_retention",
    DAYS_SQL + "SELECT audit_date, 'first' AS run, n, ids FROM day_row WHERE audit_date >= '2024-01-11'",
)
def log_retention(spark, sf_dir):
    """120 days after 11 January, earlier partitions are dropped."""
    path = scratch_path(spark, "log")
    snapshot.replace_day(event_days(spark, sf_dir), path)
    later = Clock(CLOCK.as_of + timedelta(days=100))
    snapshot.drop_expired(spark, path, later)
    return days_of(snapshot.retained(spark.read.parquet(path), later))


@register("keep_on_empty", DAYS_SQL + "SELECT audit_date, 'first' AS run, n, ids FROM day_row")
def keep_on_empty(spark, sf_dir):
    """A run without rows leaves what is kept."""
    path = scratch_path(spark, "queue")
    rows = event_days(spark, sf_dir)
    snapshot.replace_day(rows, path)
    snapshot.replace_day(rows.filter(F.col("user_id") < 0), path)
    return days_of(spark.read.parquet(path))


@register(
    "schema_reconcile",
    """SELECT count(*) AS n, count(lead_id) AS leads, count(reason) AS reasons, 0 AS verdicts, 30 AS width
    FROM review_row""",
)
def schema_reconcile(spark, sf_dir):
    """A log stored before the verdict columns existed, plus a column nobody knows."""
    old = crm.review_rows(spark, sf_dir).drop("review_verdict", "review_note", "reviewer_email")
    now = snapshot.reconcile(old.withColumn("gone", F.lit("x")), schemas.RCA_LOG)
    return now.agg(
        F.count(F.lit(1)).alias("n"),
        F.count("lead_id").alias("leads"),
        F.count("reason").alias("reasons"),
        F.count("review_verdict").alias("verdicts"),
        F.lit(len(now.columns)).alias("width"),
    )


def diff_sql() -> str:
    rows = []
    for c in COLUMNS_V7_8:
        gone = c in ("leak_code", "loop_turns")
        rows.append(
            f"SELECT '{c}' AS column_name, {'count(*) * 0' if gone else f'count({c})'} AS filled_rows, "
            f"'{'missing' if gone else 'ok'}' AS state FROM queue_row"
        )
    rows.append("SELECT 'surprise', count(lead_id), 'unexpected' FROM queue_row")
    return " UNION ALL ".join(rows)


@register("column_diff", diff_sql())
def column_diff(spark, sf_dir):
    returned = crm.queue_snapshot(spark, sf_dir).drop("leak_code", "loop_turns").withColumn("surprise", F.col("lead_id"))
    return snapshot.column_diff(returned, COLUMNS_V7_8)


# ---- censuses and probes ---------------------------------------------------------------


@register("value_census", "SELECT coalesce(stage, '(null)') AS val, count(*) AS n FROM crm_event GROUP BY 1 ORDER BY n DESC, val LIMIT 40")
def value_census(spark, sf_dir):
    return quality.value_census(crm.lead_history(spark, sf_dir), "stage", 40)


@register(
    "format_census",
    """SELECT left(lrm_assigned_at, 10) AS fmt, count(*) AS n FROM crm_lead WHERE trim(lrm_assigned_at) <> ''
    GROUP BY 1 ORDER BY n DESC, fmt LIMIT 10""",
)
def format_census(spark, sf_dir):
    return quality.format_census(crm.lead(spark, sf_dir), "lrm_assigned_at", 10)


RECENT_SQL = f"coalesce(is_delete, 0) = 0 AND created_at >= {AS_OF} - INTERVAL 3 MONTH"


@register(
    "fill_rate",
    f"""SELECT count(*) AS leads, count(lrm_queue_entry_next_action_at) AS has_next_action,
    count(reschedule_date) AS has_reschedule, count(follow_up_datetime) AS has_follow_up,
    count(*) FILTER (lrm_queue_entry_next_action_at IS NULL AND reschedule_date IS NULL AND follow_up_datetime IS NULL)
      AS has_none FROM crm_lead WHERE {RECENT_SQL}""",
)
def fill_rate(spark, sf_dir):
    return quality.fill_rate(
        quality.recent_undeleted(crm.lead(spark, sf_dir), CLOCK, 3),
        {
            "lrm_queue_entry_next_action_at": "has_next_action",
            "reschedule_date": "has_reschedule",
            "follow_up_datetime": "has_follow_up",
        },
    )


@register(
    "source_disagreement",
    f"""SELECT lead_id, {iso('lrm_queue_entry_next_action_at')} AS next_action_at, {iso('follow_up_datetime')} AS follow_up_at,
    abs(epoch(lrm_queue_entry_next_action_at - follow_up_datetime)) / 86400.0 AS gap_days FROM crm_lead
    WHERE {RECENT_SQL} AND abs(epoch(lrm_queue_entry_next_action_at - follow_up_datetime)) / 86400.0 > 1""",
)
def source_disagreement(spark, sf_dir):
    leads = quality.recent_undeleted(crm.lead(spark, sf_dir), CLOCK, 3)
    rows = quality.source_disagreement(leads, "lrm_queue_entry_next_action_at", "follow_up_datetime")
    return texts(
        rows.select(
            "lead_id",
            F.col("lrm_queue_entry_next_action_at").alias("next_action_at"),
            F.col("follow_up_datetime").alias("follow_up_at"),
            "gap_days",
        )
    )


@register(
    "phone_match_probe",
    f"""SELECT count(*) AS matching_pairs, count(DISTINCT ph10) AS matching_phones FROM
    (SELECT right({digits_of('customer_phone_number')}, 10) AS ph10 FROM crm_lead) l
    JOIN (SELECT right({digits_of('call_to')}, 10) AS ph10 FROM crm_call) c USING (ph10) WHERE length(ph10) = 10""",
)
def phone_match_probe(spark, sf_dir):
    return quality.phone_match_probe(crm.lead(spark, sf_dir), crm.call_log(spark, sf_dir))


@register(
    "column_search",
    """SELECT 'customer_first_name' AS column_name, count(customer_first_name) AS filled_rows, 'string' AS data_type FROM crm_lead
    UNION ALL SELECT 'customer_middle_name', count(customer_middle_name), 'string' FROM crm_lead
    UNION ALL SELECT 'customer_last_name', count(customer_last_name), 'string' FROM crm_lead
    UNION ALL SELECT 'customer_phone_number', count(customer_phone_number), 'string' FROM crm_lead
    UNION ALL SELECT 'customer_is_delete', count(customer_is_delete), 'int' FROM crm_lead
    UNION ALL SELECT 'reschedule_date', count(reschedule_date), 'timestamp' FROM crm_lead
    UNION ALL SELECT 'reschedule_time', count(reschedule_time), 'string' FROM crm_lead""",
)
def column_search(spark, sf_dir):
    return quality.column_search(crm.lead(spark, sf_dir), ("%name%", "%cust%", "%reschedule%"))


@register(
    "run_verdict",
    """SELECT strftime(run_at, '%Y-%m-%dT%H:%M:%SZ') AS run_at, n_rows AS rows,
      coalesce(before, -1) AS previous_rows,
      CASE WHEN error <> '' THEN 'FAILED' WHEN n_rows = 0 THEN 'EMPTY' WHEN missing_columns > 0 THEN 'COLS'
        WHEN n_rows < 0.4 * before THEN 'THIN' ELSE 'ok' END AS verdict
    FROM (SELECT r.*, (SELECT arg_max(p.n_rows, p.run_at) FROM run_row p WHERE p.run_at < r.run_at AND p.n_rows > 0 AND coalesce(p.error, '') = '') AS before
      FROM run_row r)""",
)
def run_verdict(spark, sf_dir):
    rows = quality.run_verdict(crm.run_rows(spark, sf_dir))
    previous = F.coalesce("previous_rows", F.lit(-1)).alias("previous_rows")
    return texts(rows.select("run_at", "rows", previous, "verdict"))


@register(
    "run_lag",
    """SELECT strftime(run_at, '%Y-%m-%dT%H:%M:%SZ') AS run_at, n_rows - lag(n_rows) OVER (ORDER BY run_at) AS change
    FROM run_row QUALIFY lag(n_rows) OVER (ORDER BY run_at) IS NOT NULL""",
)
def run_lag(spark, sf_dir):
    return texts(quality.run_changes(crm.run_rows(spark, sf_dir)))


@register(
    "limit_n",
    """SELECT call_to, created_at FROM crm_call WHERE created_at >= '2024-01-29' AND created_at < 'n'
    ORDER BY created_at DESC, call_to LIMIT 10""",
)
def limit_n(spark, sf_dir):
    """The newest dials, to see what their numbers look like."""
    log = crm.call_log(spark, sf_dir)
    recent = log.filter((F.col("created_at") >= "2024-01-29") & (F.col("created_at") < "n"))
    return recent.select("call_to", "created_at").orderBy(F.desc("created_at"), "call_to").limit(10)


@register("sample_n", f"SELECT DISTINCT {mail_key('emails')} AS val FROM crm_user WHERE emails IS NOT NULL ORDER BY 1 LIMIT 8")
def sample_n(spark, sf_dir):
    return quality.sample_values(user_names(crm.users(spark, sf_dir)), "lrm_email", 8)


@register(
    "dial_filter",
    f"""SELECT lead_id, {iso('max(call_at)')} AS last_call_at, count(*) AS calls_30d, count(*) FILTER (connected) AS connects_30d
    FROM (SELECT right({digits_of('call_to')}, 10) AS ph10, try_cast(created_at AS TIMESTAMP) AS call_at,
      coalesce(try_cast({digits_of('response_call_duration')} AS BIGINT) >= 15, false) AS connected FROM crm_call
      WHERE created_at >= '2024-01-01' AND created_at < 'n' AND call_type = 'Manual') d
    JOIN open_lead p ON length(p.ph10) = 10 AND d.ph10 = p.ph10 AND coalesce(d.call_at >= p.assigned_at, p.assigned_at IS NULL) GROUP BY lead_id""",
)
def dial_filter(spark, sf_dir):
    """The optional filter on the call type: dials made by hand only."""
    manual = F.col("call_type") == calls.MANUAL
    return texts(calls.call_stats(scoped(spark, sf_dir), crm.call_log(spark, sf_dir), CLOCK, keep=manual))

"""Registered queries: reporting chain, serving, access, reviews and recordings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import crm_views as crm
from checks.oracle_crm import AS_OF, iso, mail_key
from checks.oracle_org import FIELDS, OWNER
from checks.registration import register, texts
from leadsieve.functions import text
from leadsieve.operators import access, org, quality, recordings, review
from leadsieve.plans import daily, serve
from leadsieve.session import scratch_path, written
from leadsieve.sources import records
from leadsieve.sources.records import alias_columns, coerce_queue
from leadsieve.sources.schemas import MAPPING_COLUMNS, RCA_COLUMNS, RCA_LOG, columns

CLOCK = crm.CLOCK


def chart(spark: SparkSession, sf_dir: str) -> DataFrame:
    return serve.build_hierarchy(crm.hierarchy_sheet(spark, sf_dir), crm.mapping_rows(spark, sf_dir))


def served(spark: SparkSession, sf_dir: str) -> serve.Served:
    return serve.serve_queue(crm.queue_snapshot(spark, sf_dir), chart(spark, sf_dir))


def roles(spark: SparkSession, sf_dir: str, hierarchy: DataFrame) -> DataFrame:
    given = access.access_latest(crm.access_rows(spark, sf_dir))
    return access.resolve_roles(crm.viewers(spark, sf_dir), hierarchy, given, crm.ADMINS)


def newest_reviews(spark: SparkSession, sf_dir: str, *fields: str) -> DataFrame:
    return review.newest_reviews(crm.review_rows(spark, sf_dir), fields)


# ---- reporting chain -------------------------------------------------------------------

CHART = "lrm_email sseid lrm_name tl_email tl_name zsm_email zsm_name ados_email ados_name cluster hr_status".split()


@register("hierarchy_build", f"SELECT place AS seq, {', '.join(CHART)} FROM org_base")
def hierarchy_build(spark, sf_dir):
    return org.hierarchy_from_sheet(crm.hierarchy_sheet(spark, sf_dir)).select("seq", *CHART)


@register(
    "active_employees",
    """SELECT tl_email, hr_status, count(*) AS reps FROM org_record WHERE lrm_email <> '' AND lower(hr_status) <> 'inactive'
    GROUP BY ALL""",
)
def active_employees(spark, sf_dir):
    rows = alias_columns(crm.hierarchy_sheet(spark, sf_dir))
    status = F.coalesce(text.blank_to_null(F.col("hr_status")), F.lit("Active"))
    kept = org.active(rows.withColumn("hr_status", status))
    return kept.groupBy(text.mail_key(F.col("tl_email")).alias("tl_email"), "hr_status").agg(
        F.count(F.lit(1)).alias("reps")
    )


@register("mapping_latest", f"SELECT seq, lrm_email, {', '.join(FIELDS)}, updated_by, updated_at FROM map_latest")
def mapping_latest(spark, sf_dir):
    return org.mapping_latest(crm.mapping_rows(spark, sf_dir))


@register(
    "apply_mapping_overrides",
    f"SELECT seq, lrm_email, sseid, {', '.join(FIELDS)}, overridden, added_in_app FROM org_chart",
)
def apply_mapping_overrides(spark, sf_dir):
    return chart(spark, sf_dir)


def patched_field(f: str) -> str:
    new = {
        "tl_email": "if(s_suppkey % 3 = 0, 'tl.' || (s_suppkey % 4) || '@example.com', NULL)",
        "lrm_name": "if(s_suppkey % 3 = 1, '', NULL)",
        "cluster": "if(s_suppkey % 2 = 0, 'Moved ' || (s_suppkey % 3), '')",
        "tl_name": "if(s_suppkey % 5 = 0, '', NULL)",
        "hr_status": "if(s_suppkey % 23 = 0, '', NULL)",
        "zsm_email": "if(s_suppkey % 5 = 1, '', NULL)",
    }.get(f, "CAST(NULL AS VARCHAR)")
    return f"{new} AS p_{f}"


@register(
    "mapping_upsert",
    f"""WITH patch AS (SELECT {mail_key("'REP.' || s_suppkey || '@example.com'")} AS lrm_email, s_suppkey % 7 = 0 AS wipe,
      {', '.join(patched_field(f) for f in FIELDS)} FROM supplier WHERE s_suppkey % 31 <> 0),
    merged AS (SELECT coalesce(m.lrm_email, p.lrm_email) AS lrm_email, p.lrm_email IS NOT NULL AS touched, wipe,
      {', '.join(f"if(coalesce(wipe, false), '', coalesce(p_{f}, m.{f}, '')) AS {f}" for f in FIELDS)},
      updated_by, updated_at FROM map_latest m FULL JOIN patch p ON p.lrm_email = m.lrm_email)
    SELECT lrm_email, {', '.join(FIELDS)}, if(touched, 'root@example.com', updated_by) AS updated_by,
      if(touched, '2024-01-31', updated_at) AS updated_at
    FROM merged WHERE NOT touched OR concat({', '.join(FIELDS)}) <> ''""",
)
def mapping_upsert(spark, sf_dir):
    s = F.col("s_suppkey")
    nothing = F.lit(None).cast("string")
    given = {
        "tl_email": F.when(s % 3 == 0, F.concat(F.lit("TL."), s % 4, F.lit("@homes.example.com"))),
        "lrm_name": F.when(s % 3 == 1, F.lit("")),
        "cluster": F.when(s % 2 == 0, F.concat(F.lit("Moved\t"), s % 3)).otherwise(""),
        "tl_name": F.when(s % 5 == 0, F.lit("")),
        "hr_status": F.when(s % 23 == 0, F.lit("")),
        "zsm_email": F.when(s % 5 == 1, F.lit("")),
    }
    # every 31st address lacks its at-sign and is refused
    mail = F.concat(F.lit("REP."), s, F.when(s % 31 != 0, "@example.com").otherwise(" example.com"))
    patches = crm.table(spark, sf_dir, "supplier").select(
        s.alias("seq"),
        mail.alias("lrm_email"),
        (s % 7 == 0).alias("clear"),
        *[given.get(f, nothing).alias(f) for f in FIELDS],
    )
    current = org.mapping_latest(crm.mapping_rows(spark, sf_dir))
    return org.mapping_upsert(current, patches, "root@example.com", "2024-01-31")


# ---- serving ---------------------------------------------------------------------------


@register(
    "latest_audit_date",
    """WITH runs AS (SELECT run_at, n_rows, strftime(run_at, '%Y-%m-%d') AS d FROM run_row)
    SELECT strftime(run_at, '%Y-%m-%dT%H:%M:%SZ') AS audit_date, n_rows AS rows FROM runs
    WHERE d = (SELECT max(d) FROM runs)""",
)
def latest_audit_date(spark, sf_dir):
    stamped = crm.run_rows(spark, sf_dir).select(crm.iso(F.col("run_at")).alias("audit_date"), "rows")
    return org.newest_day_only(stamped)


@register("name_fallback", "SELECT lead_id, lrm_id, lrm_email, lrm_email_source FROM mailed_row")
def name_fallback(spark, sf_dir):
    rows = org.name_fallback(crm.queue_snapshot(spark, sf_dir), chart(spark, sf_dir))
    return rows.select("lead_id", "lrm_id", "lrm_email", "lrm_email_source")


@register("mapped_org_only", "SELECT lead_id, lrm_email FROM org_row")
def mapped_org_only(spark, sf_dir):
    return served(spark, sf_dir).in_org.select("lead_id", "lrm_email")


@register(
    "join_hierarchy",
    """SELECT q.lead_id, q.lrm_email, h.tl_email, h.tl_name, h.zsm_email, h.ados_email
    FROM org_row q JOIN org_chart h USING (lrm_email)""",
)
def join_hierarchy(spark, sf_dir):
    s = served(spark, sf_dir)
    rows = org.with_hierarchy(s.in_org, s.hierarchy)
    return rows.select("lead_id", "lrm_email", "tl_email", "tl_name", "zsm_email", "ados_email")


@register("unmapped_lrms", "SELECT owner_key, lrm_email, lrm_name, cluster, leads FROM stranded")
def unmapped_lrms(spark, sf_dir):
    return served(spark, sf_dir).unmapped


@register("trim_per_lrm_category", "SELECT lead_id, lrm_email, category, served_rank FROM served_row")
def trim_per_lrm_category(spark, sf_dir):
    return served(spark, sf_dir).queue.select("lead_id", "lrm_email", "category", "served_rank")


@register("tl_pick", "SELECT tl_email, lrm_email, lead_id, category, pick_pass, pick_rank FROM worklist")
def tl_pick(spark, sf_dir):
    rows = serve.team_worklists(served(spark, sf_dir))
    return rows.select("tl_email", "lrm_email", "lead_id", "category", "pick_pass", "pick_rank")


# ---- the served half from files ---------------------------------------------------------


#: Rows of a file; Spark numbers a task's files with three digits, so a task may hold 1,000 times as many.
FILE_ROWS = 100_000


def file_of(rows: DataFrame, label: str, header: bool = True) -> str:
    """Rows as CSV files, in the order of `seq`, which the files do not carry.

    Cells with line breaks make a file one task of its reader, so files are kept short.
    """
    path = scratch_path(rows.sparkSession, label)
    writer = rows.orderBy("seq").drop("seq").write.option("header", header).option("escape", '"').option("maxRecordsPerFile", FILE_ROWS)
    writer.option("ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    return path


def chart_from_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The chart from a sheet with dotted headers and cells of several lines, and the overrides' tab."""
    s = F.col("seq").cast("string")
    sheet = crm.hierarchy_sheet(spark, sf_dir).withColumnsRenamed({"Cluster": " Cluster "})
    sheet = sheet.withColumns({"S.No": s, "Emp. Notes": F.concat(F.lit('said "hi", then\nleft '), s), "": F.lit(" ")})
    cells = records.read_sheet(spark, file_of(sheet, "sheet"))
    tab = file_of(crm.mapping_rows(spark, sf_dir), "overrides")
    overrides = records.read_positional(spark, tab, columns(", ".join(f"{c} STRING" for c in MAPPING_COLUMNS)), header="lrm_email")
    return serve.build_hierarchy(cells, overrides)


@register("hierarchy_from_files", f"SELECT lrm_email, sseid, {', '.join(FIELDS)}, overridden, added_in_app FROM org_chart")
def hierarchy_from_files(spark, sf_dir):
    return chart_from_files(spark, sf_dir).drop("seq")


@register(
    "serve_from_files",
    """SELECT q.lead_id, q.lrm_email, q.lrm_email_source, q.category, q.served_rank, h.tl_email, h.overridden
    FROM served_row q JOIN org_chart h USING (lrm_email)""",
)
def serve_from_files(spark, sf_dir):
    """Queue, sheet and overrides all arrive as text."""
    queue = crm.queue_snapshot(spark, sf_dir)
    path = file_of(queue.withColumn("seq", F.monotonically_increasing_id()), "queue")
    s = serve.serve_queue(coerce_queue(records.read_sheet(spark, path)), chart_from_files(spark, sf_dir))
    rows = org.with_hierarchy(s.queue, s.hierarchy, ["tl_email", "overridden"])
    return rows.select("lead_id", "lrm_email", "lrm_email_source", "category", "served_rank", "tl_email", "overridden")


@register(
    "review_from_files",
    "SELECT audit_date, lead_id, reason, logged_at, review_verdict, length(note) AS note_chars FROM review_now",
)
def review_from_files(spark, sf_dir):
    """The review log under a header of fewer columns; of equal times the later row counts."""
    path = file_of(crm.review_rows(spark, sf_dir), "reviews", header=False)
    log = records.read_positional(spark, path, RCA_LOG).withColumn("note_chars", F.length("note"))
    return review.newest_reviews(log, ["audit_date", "lead_id", "reason", "logged_at", "review_verdict", "note_chars"])


@register("access_from_files", "SELECT email, role, scope, note, updated_by, updated_at FROM access_now")
def access_from_files(spark, sf_dir):
    path = file_of(crm.access_rows(spark, sf_dir), "access")
    return access.access_latest(records.read_sheet(spark, path))


@register("email_intersect", "SELECT lrm_email FROM queue_row INTERSECT SELECT lrm_email FROM org_chart")
def email_intersect(spark, sf_dir):
    return quality.mail_set(crm.queue_snapshot(spark, sf_dir)).intersect(quality.mail_set(chart(spark, sf_dir)))


@register(
    "email_except",
    "SELECT lrm_email FROM queue_row WHERE lrm_email IS NOT NULL EXCEPT SELECT lrm_email FROM org_chart",
)
def email_except(spark, sf_dir):
    return quality.mail_set(crm.queue_snapshot(spark, sf_dir)).exceptAll(quality.mail_set(chart(spark, sf_dir)))


@register("distinct_values", "SELECT DISTINCT lrm_id, lrm_email, lrm_name FROM queue_row")
def distinct_values(spark, sf_dir):
    return crm.queue_snapshot(spark, sf_dir).select("lrm_id", "lrm_email", "lrm_name").distinct()


COUNTS_SQL = f"""
  (SELECT count(*) FROM crm_lead) AS source_rows,
  (SELECT count(*) FROM served_row) AS queue_rows,
  (SELECT count(*) FROM served_row WHERE lrm_email = '') AS blank_mails,
  (SELECT count(*) FROM served_row WHERE lrm_email_source = 'name') AS resolved_by_name,
  (SELECT count(*) FROM lost_row) AS excluded_rows,
  (SELECT count(DISTINCT {OWNER}) FROM lost_row) AS excluded_lrms,
  (SELECT count(*) FROM org_chart) AS hierarchy_rows,
  (SELECT count(DISTINCT lrm_email) FROM served_row WHERE lrm_email <> '') AS lrms_in_queue,
  (SELECT count(DISTINCT lrm_email) FROM org_chart) AS lrms_in_map,
  (SELECT count(DISTINCT lrm_email) FROM served_row WHERE lrm_email IN (SELECT lrm_email FROM org_chart)) AS lrms_in_both,
  (SELECT count(DISTINCT lrm_email) FROM served_row WHERE lrm_email <> ''
    AND lrm_email NOT IN (SELECT lrm_email FROM org_chart)) AS lrms_unmatched,
  (SELECT count(DISTINCT tl_email) FROM org_chart WHERE tl_email <> '') AS tls_in_map,
  (SELECT count(DISTINCT trim(lrm_name)) FROM served_row WHERE trim(lrm_name) <> '') AS names_in_queue"""


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = serve.kept(served(spark, sf_dir))
    source = crm.lead(spark, sf_dir).agg(F.count(F.lit(1))).scalar()
    return quality.pull_counts(s.all_rows, s.queue, s.hierarchy, source)


@register("distinct_counts", f"SELECT {COUNTS_SQL}")
def distinct_counts(spark, sf_dir):
    return counts(spark, sf_dir)


@register(
    "pull_verdict",
    f"""SELECT queue_rows, hierarchy_rows, lrms_in_both, excluded_rows, CASE
      WHEN queue_rows = 0 AND excluded_rows > 0 THEN 'ALL_EXCLUDED' WHEN queue_rows = 0 AND source_rows > 0 THEN 'NONE_PARSED'
      WHEN queue_rows = 0 THEN 'NO_SOURCE_ROWS' WHEN hierarchy_rows = 0 THEN 'EMPTY_MAP'
      WHEN blank_mails > 0.9 * queue_rows THEN 'NO_MAILS' WHEN lrms_in_both = 0 THEN 'JOIN_FAILURE' ELSE 'HEALTHY' END AS verdict
    FROM (SELECT {COUNTS_SQL})""",
)
def pull_verdict(spark, sf_dir):
    rows = quality.pull_verdict(counts(spark, sf_dir))
    return rows.select("queue_rows", "hierarchy_rows", "lrms_in_both", "excluded_rows", "verdict")


# ---- access ----------------------------------------------------------------------------


@register("access_latest", "SELECT email, role, scope, note, updated_by, updated_at FROM access_now")
def access_latest(spark, sf_dir):
    return access.access_latest(crm.access_rows(spark, sf_dir))


@register(
    "access_upsert",
    """WITH item AS (SELECT 'rep.' || s_suppkey || '@example.com' AS email, ['zsm', '', 'king', 'TL'][(s_suppkey % 4 + 1)::INT]
      AS role, 'note ' || s_suppkey AS note FROM supplier),
    valid AS (SELECT email, lower(role) AS role, note FROM item WHERE role <> 'king')
    SELECT email, role, scope, note, updated_by, updated_at FROM access_now
    WHERE email NOT IN (SELECT email FROM valid)
    UNION ALL SELECT email, role, '', note, 'root@example.com', '2024-01-31' FROM valid WHERE role <> ''""",
)
def access_upsert(spark, sf_dir):
    s = F.col("s_suppkey")
    items = crm.table(spark, sf_dir, "supplier").select(
        s.alias("seq"),
        F.concat(F.lit("Rep."), s, F.lit("@homes.example.com")).alias("email"),
        crm.nth(("zsm", "", "king", "TL"), s % 4).alias("role"),
        F.lit("").alias("scope"),
        F.concat(F.lit("note\r\n"), s).alias("note"),
    )
    current = access.access_latest(crm.access_rows(spark, sf_dir))
    return access.access_upsert(current, items, "root@example.com", "2024-01-31")


@register("resolve_roles", "SELECT viewer_email, role, override_role FROM viewer_role")
def resolve_roles(spark, sf_dir):
    return roles(spark, sf_dir, chart(spark, sf_dir))


@register("allowed_tls", "SELECT viewer_email, role, override_role, team_leads, see_all FROM sight")
def allowed_tls(spark, sf_dir):
    hierarchy = chart(spark, sf_dir)
    return access.visibility(roles(spark, sf_dir, hierarchy), hierarchy)


@register("team_grants", "SELECT viewer_email, tl_email FROM team_grant")
def team_grants(spark, sf_dir):
    hierarchy = chart(spark, sf_dir)
    return access.team_grants(roles(spark, sf_dir, hierarchy), hierarchy)


@register(
    "scope_queue",
    "SELECT viewer_email, lead_id, lrm_email FROM served_row JOIN owner_sight USING (lrm_email)",
)
def scope_queue(spark, sf_dir):
    s = served(spark, sf_dir)
    grants = access.team_grants(roles(spark, sf_dir, s.hierarchy), s.hierarchy)
    return access.scope_queue(s.queue, s.hierarchy, grants).select("viewer_email", "lead_id", "lrm_email")


@register(
    "scope_payload",
    """SELECT viewer_email, role, override_role, see_all,
      if(see_all, (SELECT count(*) FROM served_row), (SELECT count(*) FROM served_row s JOIN owner_sight o USING (lrm_email)
        WHERE o.viewer_email = v.viewer_email)) AS queue_rows,
      if(see_all, (SELECT count(*) FROM org_chart), (SELECT count(*) FROM owner_sight o WHERE o.viewer_email = v.viewer_email))
        AS hierarchy_rows,
      if(role = 'admin', (SELECT count(*) FROM stranded), 0) AS unmapped_rows,
      if(role = 'admin', (SELECT count(*) FROM map_latest), 0) AS mapping_rows,
      (SELECT count(*) FROM access_now WHERE role = 'auditor') AS auditors,
      if(role = 'tl', viewer_email, '') AS me_email
    FROM sight v""",
)
def scope_payload(spark, sf_dir):
    s = serve.kept(served(spark, sf_dir))
    mapping = org.mapping_latest(crm.mapping_rows(spark, sf_dir))
    given = written(access.access_latest(crm.access_rows(spark, sf_dir)), "access")
    people = written(access.resolve_roles(crm.viewers(spark, sf_dir), s.hierarchy, given, crm.ADMINS), "roles")
    return access.scope_payload(s.queue, s.hierarchy, s.unmapped, people, mapping, given)


# ---- reviews ---------------------------------------------------------------------------



@register(
    "rca_append",
    """SELECT '2024-01-31T09:30:00Z' AS logged_at, 'L' || conv_id AS lead_id, role AS reason,
      left(regexp_replace(text, '[\\r\\n\\t]+', ' ', 'g'), 900) AS note, 'qa@example.com' AS auditor_email,
      role AS auditor_name, if(turn % 2 = 0, 'open', 'done') AS action_status
    FROM conversations WHERE turn % 5 <> 4 AND role <> 'system'""",
)
def rca_append(spark, sf_dir):
    """Submissions without a lead or a reason are refused."""
    turn = F.col("turn")
    given = {
        "lead_id": F.when(turn % 5 != 4, F.concat(F.lit("L"), F.col("conv_id"))),
        "reason": F.when(F.col("role") != "system", F.col("role")).otherwise(""),
        "note": F.col("text"),
        "auditor_name": F.col("role"),
        "auditor_email": F.lit("someone@example.com"),
        "action_status": F.when(turn % 2 == 0, "").otherwise("done"),
    }
    items = crm.table(spark, sf_dir, "conversations").select(
        *[given.get(c, F.lit(None).cast("string")).alias(c) for c in RCA_COLUMNS]
    )
    rows = review.new_reviews(items, "2024-01-31T09:30:00Z", auditor_email="qa@example.com")
    return rows.select("logged_at", "lead_id", "reason", "note", "auditor_email", "auditor_name", "action_status")


@register(
    "rca_window",
    f"""SELECT seq, lead_id, audit_date FROM review_row
    WHERE audit_date = '' OR left(audit_date, 10) >= strftime({AS_OF} - INTERVAL 45 DAY, '%Y-%m-%d')""",
)
def rca_window(spark, sf_dir):
    return review.reviews_in_window(crm.review_rows(spark, sf_dir), CLOCK, "junk").select("seq", "lead_id", "audit_date")


@register("rca_latest", "SELECT seq, audit_date, lead_id, reason, logged_at, review_verdict FROM review_now")
def rca_latest(spark, sf_dir):
    return newest_reviews(spark, sf_dir, "seq", "audit_date", "lead_id", "reason", "logged_at", "review_verdict")


@register(
    "rca_done",
    """SELECT tl_email, count(*) AS queued, count(r.lead_id) AS done, count(*) - count(r.lead_id) AS pending
    FROM team_row t LEFT JOIN review_now r ON r.lead_id = t.lead_id AND r.review_day = CAST(t.audit_date AS VARCHAR)
    GROUP BY 1""".replace("SELECT tl_email", "SELECT t.tl_email"),
)
def rca_done(spark, sf_dir):
    s = served(spark, sf_dir)
    rows = org.with_hierarchy(s.queue, s.hierarchy, ["tl_email"])
    return review.done_by_team(review.with_review(rows, newest_reviews(spark, sf_dir, *review.SEEN)))


@register(
    "adherence_mtd",
    """SELECT t.tl_email, count(*) AS picked, count(r.lead_id) AS reviewed,
      round(count(r.lead_id) * 100.0 / count(*), 1) AS adherence_pct
    FROM spread_list t LEFT JOIN review_now r ON r.lead_id = t.lead_id AND r.review_day = CAST(t.audit_date AS VARCHAR)
    WHERE t.audit_date >= DATE '2024-01-01' GROUP BY 1""",
)
def adherence_mtd(spark, sf_dir):
    """Forty days of work lists are kept; those of the month count. One day is drawn twice."""
    kept = kept_picks(spark, sf_dir)
    return review.adherence_month_to_date(daily.month_picks(kept, CLOCK), newest_reviews(spark, sf_dir, *review.SEEN), CLOCK)


def kept_picks(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = served(spark, sf_dir)
    rows = org.with_hierarchy(s.queue, s.hierarchy, ["tl_email", "tl_name"])
    back = (F.substring("lead_id", 2, 20).cast("bigint") % 40).cast("int")
    spread = rows.withColumn("audit_date", F.date_sub(F.col("audit_date").cast("date"), back))
    root = scratch_path(spark, "picks")
    lists = written(org.tl_pick(spread, by=("audit_date", "tl_email")), "lists")
    daily.export_picks(lists, root)
    daily.export_picks(lists.filter(F.col("audit_date") == CLOCK.today_col()), root)
    return spark.read.parquet(f"{root}/{daily.PICKS}")


@register(
    "kept_pick_log",
    """SELECT CAST(audit_date AS VARCHAR) AS audit_date, tl_email, count(*) AS picked, min(lead_id) AS first_lead
    FROM spread_list GROUP BY ALL""",
)
def kept_pick_log(spark, sf_dir):
    """What is kept of each day and team lead."""
    rows = kept_picks(spark, sf_dir).groupBy(F.col("audit_date").cast("string").alias("audit_date"), "tl_email")
    return rows.agg(F.count(F.lit(1)).alias("picked"), F.min("lead_id").alias("first_lead"))


@register(
    "rework_count",
    """SELECT tl_email, reviewer_email, count(*) FILTER (review_verdict <> '') AS judged,
    count(*) FILTER (review_verdict ILIKE '%rework%') AS rework FROM review_now GROUP BY ALL""",
)
def rework_count(spark, sf_dir):
    return review.rework_counts(newest_reviews(spark, sf_dir, "tl_email", "reviewer_email", "review_verdict"))


# ---- recordings ------------------------------------------------------------------------


@register("media_type_filter", "SELECT path, content_type FROM audio_file")
def media_type_filter(spark, sf_dir):
    rows = crm.recording_listing(spark, sf_dir)
    return rows.filter(recordings.is_audio(F.col("content_type"), F.col("path"))).select("path", "content_type")


@register(
    "recording_inventory",
    f"""SELECT path, 'L' || k AS lead_key, 'call_' || (k % 9) || '.' || split_part(path, '.', -1) AS name, size,
      {iso('make_timestamp((k + 1700000000000) * 1000)')} AS uploaded_at
    FROM audio_file WHERE path NOT IN (SELECT recording_url FROM review_row)""",
)
def recording_inventory(spark, sf_dir):
    """Stored audio that no review points at."""
    stored = recordings.inventory(crm.recording_listing(spark, sf_dir))
    rows = recordings.orphaned(stored, crm.review_rows(spark, sf_dir))
    return texts(rows.select("path", "lead_key", "name", "size", "uploaded_at"))



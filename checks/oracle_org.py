"""SQL fragments for the reporting chain, roles, reviews, recordings and runs."""

from __future__ import annotations

from checks.oracle_crm import AS_OF, PARTS, back, iso, letters, mail_key

FIELDS = (
    "lrm_name tl_email tl_name zsm_email zsm_name ados_email ados_name cluster hr_status".split()
)


def sheet_rows(first: int, nation: str, where: str) -> str:
    lead_mail = f"'tl.' || ({nation}) || '@homes.example.com'"
    return f"""
SELECT {first} + s_suppkey AS seq,
  CASE WHEN s_suppkey % 13 <> 0 THEN ' Rep.' || s_suppkey || '@Example.com' ELSE '' END AS email_ids,
  'REP-' || {letters('s_suppkey')} || CASE WHEN s_suppkey % 3 <> 0 THEN ' -- Of  ' || {letters('s_nationkey')}
    ELSE '' END AS lrm_name,
  'E' || s_suppkey AS sseid,
  CASE WHEN s_suppkey % 5 <> 0 THEN 'Zone ' || (s_suppkey % 7) ELSE '' END AS cluster_head,
  'City ' || s_nationkey AS city_head,
  CASE WHEN s_suppkey % 9 <> 0 THEN {lead_mail} ELSE '' END AS lrm_tl_head,
  upper({lead_mail}) AS tl_head,
  'Lead ' || ({nation}) AS tl_name,
  'zsm.' || n_regionkey || '@example.com' AS dzsm,
  'ados.' || (n_regionkey % 2) || '@example.com' AS ados_head,
  CASE WHEN s_suppkey % 17 = 0 THEN 'Inactive' WHEN s_suppkey % 4 = 0 THEN '' ELSE 'Active' END AS hr_head
FROM supplier JOIN nation ON n_nationkey = s_nationkey WHERE {where}"""


PARTS["org_sheet"] = (
    sheet_rows(0, "s_nationkey", "true")
    + "\nUNION ALL"
    + sheet_rows(10_000_000, "(s_nationkey + 1) % 25", "s_acctbal < 0")
)

PARTS["org_record"] = f"""
SELECT seq, {mail_key('email_ids')} AS lrm_email, lrm_name, sseid,
  coalesce(nullif(cluster_head, ''), city_head) AS cluster,
  {mail_key("coalesce(nullif(lrm_tl_head, ''), tl_head)")} AS tl_email, tl_name,
  {mail_key('dzsm')} AS zsm_email, '' AS zsm_name, {mail_key('ados_head')} AS ados_email, '' AS ados_name,
  coalesce(nullif(hr_head, ''), 'Active') AS hr_status
FROM org_sheet"""

PARTS["org_base"] = """
SELECT min(seq) OVER (PARTITION BY lrm_email) AS place, * FROM org_record
WHERE lrm_email <> '' AND lower(hr_status) <> 'inactive'
QUALIFY row_number() OVER (PARTITION BY lrm_email ORDER BY seq DESC) = 1"""

PARTS["map_row"] = f"""
SELECT s_suppkey * 2 AS seq, 'REP.' || s_suppkey || '@homes.example.com' AS lrm_email,
  'Patched ' || {letters('s_suppkey')} AS lrm_name,
  CASE WHEN s_suppkey % 2 = 0 THEN 'TL.' || (s_suppkey % 7) || '@homes.example.com' ELSE '' END AS tl_email,
  '' AS tl_name, '' AS zsm_email, '' AS zsm_name, '' AS ados_email, '' AS ados_name,
  ' Patch' || chr(10) || (s_suppkey % 5) AS cluster,
  CASE WHEN s_suppkey % 19 = 0 THEN 'INACTIVE' ELSE '' END AS hr_status,
  'admin@example.com' AS updated_by, '2024-01-01' AS updated_at
FROM supplier WHERE s_acctbal > 5000
UNION ALL
SELECT s_suppkey * 2 + 1, 'REP.' || s_suppkey || '@homes.example.com', '', '',
  CASE WHEN s_suppkey % 2 = 0 THEN 'Lead ' || (s_suppkey % 7) ELSE '' END,
  CASE WHEN s_suppkey % 8 = 0 THEN 'Zsm.9@example.com' ELSE '' END, '', '', '',
  CASE WHEN s_suppkey % 3 = 0 THEN 'Patch B' || (s_suppkey % 5) ELSE '' END, '',
  'admin@example.com', '2024-01-02'
FROM supplier WHERE s_acctbal > 5000"""


def clean_cell(f: str) -> str:
    if f.endswith("_email"):
        return mail_key(f)
    return f"left(trim(regexp_replace({f}, '[\\r\\n\\t]+', ' ', 'g')), 200)"


def last_filled(f: str) -> str:
    value = f"nullif({clean_cell(f)}, '')"
    return f"coalesce(arg_max({value}, seq) FILTER ({value} IS NOT NULL), '') AS {f}"


PARTS["map_latest"] = f"""
SELECT k AS lrm_email, min(seq) AS seq, {', '.join(last_filled(f) for f in FIELDS)},
  arg_max(updated_by, seq) AS updated_by, arg_max(updated_at, seq) AS updated_at
FROM (SELECT *, {mail_key('lrm_email')} AS k FROM map_row) WHERE k <> '' GROUP BY k"""


def patched(f: str, default: str = "''") -> str:
    return f"coalesce(nullif(o.{f}, ''), b.{f}, {default}) AS {f}"


PARTS["org_patched"] = f"""
SELECT coalesce(b.place, o.seq) AS seq, coalesce(b.lrm_email, o.lrm_email) AS lrm_email,
  coalesce(b.sseid, '') AS sseid, {', '.join(patched(f, "'Active'" if f == 'hr_status' else "''") for f in FIELDS)},
  o.lrm_email IS NOT NULL AS overridden, b.lrm_email IS NULL AS added_in_app
FROM org_base b FULL JOIN map_latest o ON o.lrm_email = b.lrm_email"""
PARTS["org_chart"] = "SELECT * FROM org_patched WHERE lower(hr_status) <> 'inactive'"


def name_key(x: str) -> str:
    return f"trim(regexp_replace(lower(coalesce({x}, '')), '[^a-z]+', ' ', 'g'))"


PARTS["chart_name"] = f"""
SELECT {name_key('lrm_name')} AS nk, lrm_email AS found FROM org_chart WHERE {name_key('lrm_name')} <> ''
QUALIFY row_number() OVER (PARTITION BY {name_key('lrm_name')} ORDER BY added_in_app, seq) = 1"""

PARTS["mailed_row"] = f"""
SELECT q.* REPLACE (coalesce(nullif(q.lrm_email, ''), found, '') AS lrm_email),
  if(coalesce(q.lrm_email, '') = '' AND found IS NOT NULL, 'name', '') AS lrm_email_source
FROM queue_row q LEFT JOIN chart_name ON nk = {name_key('q.lrm_name')} AND coalesce(q.lrm_email, '') = ''"""

PARTS["org_row"] = "SELECT * FROM mailed_row WHERE lrm_email IN (SELECT lrm_email FROM org_chart)"
PARTS["lost_row"] = "SELECT * FROM mailed_row WHERE lrm_email NOT IN (SELECT lrm_email FROM org_chart)"

PARTS["served_row"] = """
SELECT *, row_number() OVER (PARTITION BY lrm_email, category
  ORDER BY priority_key DESC, days_overdue DESC, lrm_category_rank, lead_id) AS served_rank
FROM org_row QUALIFY served_rank <= 12"""

OWNER = "coalesce(nullif(lrm_email, ''), 'name:' || coalesce(nullif(lrm_name, ''), '?'))"
PARTS["stranded"] = f"""
SELECT owner_key, arg_min(lrm_email, pos) AS lrm_email, arg_min(lrm_name, pos) AS lrm_name,
  coalesce(arg_min(cluster, pos) FILTER (coalesce(cluster, '') <> ''), '') AS cluster, count(*) AS leads
FROM (SELECT *, {OWNER} AS owner_key, row_number() OVER (ORDER BY category, lrm_category_rank, lead_id) AS pos
  FROM lost_row)
GROUP BY owner_key ORDER BY leads DESC, owner_key LIMIT 400"""

PARTS["team_row"] = """
SELECT s.*, h.tl_email, h.tl_name FROM served_row s JOIN org_chart h USING (lrm_email)"""

PARTS["first_pick"] = """
SELECT *, row_number() OVER (PARTITION BY tl_email, category ORDER BY priority_key DESC, created_at DESC, lead_id)
  AS pick_rank, 1 AS pick_pass
FROM team_row QUALIFY pick_rank <= 4"""
PARTS["spare_pick"] = """
SELECT *, row_number() OVER (PARTITION BY tl_email ORDER BY days_overdue DESC, created_at DESC, lead_id) AS pick_rank,
  2 AS pick_pass
FROM team_row t WHERE NOT EXISTS (SELECT 1 FROM first_pick f WHERE f.tl_email = t.tl_email AND f.lead_id = t.lead_id)"""
PARTS["worklist"] = """
SELECT tl_email, lrm_email, lead_id, category, audit_date, pick_pass, pick_rank FROM first_pick
UNION ALL
SELECT tl_email, lrm_email, lead_id, category, audit_date, pick_pass, pick_rank FROM spare_pick s
WHERE pick_rank <= 20 - (SELECT count(*) FROM first_pick f WHERE f.tl_email = s.tl_email)"""

# the same rows spread over forty days up to the audit day, and each day's lists
PARTS["spread_row"] = """
SELECT * REPLACE (CAST(audit_date - CAST(CAST(substr(lead_id, 2) AS BIGINT) % 40 AS INT) AS DATE) AS audit_date) FROM team_row"""
PARTS["spread_list"] = """
SELECT tl_email, lead_id, audit_date FROM (
  SELECT *, row_number() OVER (PARTITION BY audit_date, tl_email ORDER BY early, if(early, NULL, days_overdue) DESC,
    created_at DESC, lead_id) AS n, count(*) FILTER (early) OVER (PARTITION BY audit_date, tl_email) AS taken
  FROM (SELECT *, NOT (row_number() OVER (PARTITION BY audit_date, tl_email, category
      ORDER BY priority_key DESC, created_at DESC, lead_id) <= 4) AS late, NOT late AS early FROM spread_row))
WHERE early OR n <= 20 - taken"""

# ---- access ----
PARTS["access_row"] = """
SELECT s_suppkey AS seq,
  CASE s_suppkey % 5 WHEN 0 THEN 'TL.' || s_nationkey || '@homes.example.com'
    WHEN 1 THEN 'zsm.' || (s_nationkey % 7) || '@example.com' ELSE 'rep.' || s_suppkey || '@example.com' END AS email,
  ['tl','zsm','none','auditor','ados','admin','','TL'][(s_suppkey % 8 + 1)::INT] AS role,
  '' AS scope, 'note' || chr(10) || s_suppkey AS note, 'admin@example.com' AS updated_by, '2024-01-02' AS updated_at
FROM supplier"""
PARTS["access_now"] = f"""
SELECT {mail_key('email')} AS email, lower(role) AS role, scope, note, updated_by, updated_at FROM access_row
QUALIFY row_number() OVER (PARTITION BY {mail_key('email')} ORDER BY seq DESC) = 1"""
PARTS["viewer"] = f"""
SELECT DISTINCT {mail_key('v')} AS viewer_email FROM (
  SELECT 'Rep.' || s_suppkey || '@example.com' AS v FROM supplier
  UNION ALL SELECT 'tl.' || s_nationkey || '@homes.example.com' FROM supplier
  UNION ALL SELECT 'zsm.' || (s_suppkey % 8) || '@example.com' FROM supplier
  UNION ALL SELECT 'ados.' || (s_suppkey % 3) || '@example.com' FROM supplier)"""
PARTS["viewer_role"] = """
SELECT viewer_email, coalesce(a.role, '') AS override_role, CASE
  WHEN a.role = 'none' THEN 'blocked'
  WHEN viewer_email IN ('boss@example.com', 'ados.1@example.com') OR a.role = 'admin' THEN 'admin'
  WHEN a.role IN ('auditor', 'zsm', 'ados', 'tl') THEN a.role
  WHEN viewer_email IN (SELECT tl_email FROM org_chart) THEN 'tl'
  WHEN viewer_email IN (SELECT zsm_email FROM org_chart) THEN 'zsm'
  WHEN viewer_email IN (SELECT ados_email FROM org_chart) THEN 'ados' ELSE 'none' END AS role
FROM viewer LEFT JOIN access_now a ON a.email = viewer_email"""
PARTS["team_grant"] = """
SELECT viewer_email, viewer_email AS tl_email FROM viewer_role WHERE role = 'tl'
UNION
SELECT viewer_email, tl_email FROM viewer_role, org_chart
WHERE (role = 'zsm' AND zsm_email = viewer_email) OR (role = 'ados' AND ados_email = viewer_email)"""
PARTS["sight"] = """
SELECT viewer_email, role, override_role, count(tl_email) AS team_leads,
  role IN ('admin', 'auditor') OR (override_role IN ('zsm', 'ados') AND role IN ('zsm', 'ados') AND count(tl_email) = 0)
    AS see_all
FROM viewer_role LEFT JOIN team_grant USING (viewer_email) GROUP BY viewer_email, role, override_role"""
PARTS["owner_sight"] = "SELECT DISTINCT viewer_email, lrm_email FROM team_grant JOIN org_chart USING (tl_email)"

# ---- reviews, recordings, runs ----
REC_PATH = (
    "'store/recordings/L' || o_orderkey || '/' || (o_orderkey + 1700000000000) || '-call_' || (o_orderkey % 9) || '.' "
    "|| ['mp3','txt','MP4','pdf','wav'][(o_orderkey % 5 + 1)::INT]"
)
REVIEW_BODY = f"""'L' || o_orderkey AS lead_id,
  {iso(back('o_orderkey % 3', 'o_orderkey % 5'))} AS logged_at,
  CASE WHEN o_orderkey % 4 <> 0 THEN '2024-01-31' WHEN o_orderkey % 8 = 4 THEN '2024-01-30T09:30:00Z' ELSE '' END
    AS audit_date,
  'tl.' || (o_custkey % 25) || '@example.com' AS tl_email,
  'qa.' || (o_orderkey % 3) || '@example.com' AS reviewer_email,
  CASE WHEN o_orderkey % 6 = 0 THEN {REC_PATH} ELSE '' END AS recording_url"""
URGENT = "o_orderpriority IN ('1-URGENT', '2-HIGH')"
PARTS["review_row"] = f"""
SELECT o_orderkey AS seq, {REVIEW_BODY}, 'No call back' AS reason, '' AS note,
  CASE WHEN o_orderkey % 5 = 0 THEN 'Needs rework' WHEN o_orderkey % 5 < 3 THEN 'Accepted' ELSE '' END AS review_verdict
FROM orders WHERE {URGENT}
UNION ALL BY NAME
SELECT o_orderkey + 1000000000 AS seq, {REVIEW_BODY}, 'Second look' AS reason, '' AS note,
  'needs Rework again' AS review_verdict
FROM orders WHERE {URGENT} AND o_orderstatus = 'P'
UNION ALL BY NAME
SELECT conv_id * 1000 + turn + 2000000000 AS seq, 'L' || conv_id AS lead_id,
  {iso(f"({AS_OF} - to_minutes(20 - turn))")} AS logged_at,
  strftime({back('conv_id % 60')}, '%Y-%m-%d') AS audit_date, 'tl.' || (conv_id % 25) || '@example.com' AS tl_email,
  'qa.0@example.com' AS reviewer_email, '' AS recording_url, role AS reason, text AS note, '' AS review_verdict
FROM conversations"""
PARTS["review_now"] = """
SELECT *, left(audit_date, 10) AS review_day FROM review_row
QUALIFY row_number() OVER (PARTITION BY left(audit_date, 10), lead_id ORDER BY logged_at DESC, seq DESC) = 1"""
PARTS["recording_file"] = f"""
SELECT {REC_PATH} AS path, o_orderkey * 37 % 1000 + 1 AS size,
  ['audio/mpeg; rate=8','application/octet-stream','video/mp4','video/x','text/plain','','audio/wav']
    [(o_orderkey % 7 + 1)::INT] AS content_type,
  lower(['mp3','txt','MP4','pdf','wav'][(o_orderkey % 5 + 1)::INT]) AS ext, o_orderkey AS k
FROM orders"""
PARTS["audio_file"] = """
SELECT * FROM recording_file
WHERE content_type LIKE 'audio/%' OR content_type = 'video/mp4' OR ext IN ('mp3', 'mp4', 'wav')"""
PARTS["run_row"] = """
SELECT date_trunc('hour', ts) AS run_at, count(*) FILTER (event_type = 'purchase') AS n_rows,
  if(min(event_id) % 13 = 0, 'timeout', '') AS error,
  if(count(*) FILTER (event_type = 'error') % 5 = 4, 1, 0) AS missing_columns
FROM events GROUP BY 1"""


"""Column types of every table the package reads or keeps."""

from __future__ import annotations

from pyspark.sql.types import (
    DataType,
    DoubleType,
    IntegerType,
    LongType,
    StringType,
    StructType,
    TimestampType,
)

KINDS: dict[str, DataType] = {
    "STRING": StringType(),
    "INT": IntegerType(),
    "BIGINT": LongType(),
    "DOUBLE": DoubleType(),
    "TIMESTAMP": TimestampType(),
}


def columns(text: str) -> StructType:
    """`name TYPE, name TYPE`; unlike the DDL parser it needs no running session."""
    schema = StructType()
    for item in text.split(","):
        name, kind = item.split()
        schema.add(name, KINDS[kind])
    return schema


LEAD = columns(
    """
    lead_id STRING, is_delete INT, customer_is_delete INT, created_at TIMESTAMP, updated_at TIMESTAMP,
    status STRING, stage STRING, customer_first_name STRING, customer_middle_name STRING,
    customer_last_name STRING, customer_phone_number STRING, assigned_lrm STRING, lrm_assigned_at STRING,
    site_address_pin_code STRING, meeting_address_pin_code STRING, site_address_city STRING,
    meeting_address_city STRING, reschedule_date TIMESTAMP, reschedule_time STRING,
    lrm_queue_entry_next_action_at TIMESTAMP, follow_up_datetime TIMESTAMP, qualified_datetime STRING,
    order_closure_datetime TIMESTAMP, first_meeting_done_date TIMESTAMP, lrm_queue_entry_attempts_today INT
    """
)
# `status` is read by one superseded rule set only
LEAD_HISTORY = columns(
    """
    event_id STRING, lead_id STRING, created_at TIMESTAMP, stage STRING, status STRING,
    meeting_confirmed_datetime TIMESTAMP, meeting_schedule_date TIMESTAMP, meeting_done_date TIMESTAMP
    """
)
# `call_type` is read by one superseded rule set and by the optional dial filter
CALL_LOG = columns(
    "call_to STRING, created_at STRING, response_call_duration STRING, call_type STRING"
)
GEO = columns("pin_code STRING, cluster STRING, city STRING, pincode_status STRING, is_delete INT")
USERS = columns("user_id STRING, first_name STRING, last_name STRING, emails STRING")

BASE_TABLES = {"lead": LEAD, "lead_history": LEAD_HISTORY, "call_log": CALL_LOG, "geo": GEO, "users": USERS}

# ---- fixed values: stored column order of the kept tables --------------------------------
RCA_COLUMNS = (
    "logged_at",
    "audit_date",
    "lead_id",
    "customer_name",
    "category",
    "lrm_email",
    "lrm_name",
    "tl_email",
    "tl_name",
    "auditor_email",
    "auditor_name",
    "reason",
    "severity",
    "action",
    "note",
    "why_path",
    "assignee",
    "what",
    "why",
    "owner",
    "fault",
    "action_status",
    "recording_url",
    "recording_name",
    "review_verdict",
    "review_note",
    "reassigned_to",
    "reviewer_email",
    "reviewer_name",
    "reviewed_at",
)
MAPPING_FIELDS = (
    "lrm_name",
    "tl_email",
    "tl_name",
    "zsm_email",
    "zsm_name",
    "ados_email",
    "ados_name",
    "cluster",
    "hr_status",
)
MAPPING_COLUMNS = ("lrm_email", *MAPPING_FIELDS, "updated_by", "updated_at")
MAPPING_MAIL_FIELDS = ("tl_email", "zsm_email", "ados_email")
ACCESS_COLUMNS = ("email", "role", "scope", "note", "updated_by", "updated_at")
ACCESS_ROLES = ("admin", "auditor", "tl", "zsm", "ados", "none")
# header names accepted for each hierarchy field, first non-blank wins
HIERARCHY_HEADERS = {
    "lrm_email": ("Email IDs", "Email ID", "LRM Email", "lrm_email"),
    "lrm_name": ("LRM Name", "Name", "lrm_name"),
    "sseid": ("SSEID", "SSE ID", "sseid"),
    "cluster": ("Cluster", "City", "cluster"),
    "tl_email": ("LRM TL Email ID", "LRM TL", "TL Email", "tl_email"),
    "tl_name": ("Reporting Team Lead", "TL Name", "tl_name"),
    "zsm_email": ("LRM DZSM Email ID", "DZSM", "ZSM Email", "zsm_email"),
    "zsm_name": ("ZSM Name", "zsm_name"),
    "ados_email": ("ADOS Email", "ADOS", "ados_email"),
    "ados_name": ("ADOS Name", "ados_name"),
    "hr_status": ("HR Status", "Status", "hr_status"),
}
AUDIO_EXTENSIONS = (
    "mp3", "wav", "m4a", "aac", "ogg", "oga", "opus", "flac",
    "wma", "amr", "3gp", "webm", "mp4", "caf", "aiff", "aif",
)
# ------------------------------------------------------------------------------------------

RCA_LOG = columns(", ".join(f"{c} STRING" for c in RCA_COLUMNS))
RUN_LOG = columns(
    "run_at TIMESTAMP, rows BIGINT, fetch_s DOUBLE, queue_s DOUBLE, log_s DOUBLE, total_s DOUBLE, "
    "error STRING, missing_columns INT"
)

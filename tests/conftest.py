from __future__ import annotations

import os
import sys
from datetime import datetime, timezone

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from leadsieve.config import Clock  # noqa: E402
from leadsieve.plans.queue import CrmTables  # noqa: E402
from leadsieve.session import local_session  # noqa: E402
from leadsieve.sources import schemas  # noqa: E402

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="session")
def spark():
    session = local_session("leadsieve-tests", cores="8", partitions=4)
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


def at(text: str) -> datetime:
    """`2026-08-03 09:30` in UTC; a bare date means 06:00."""
    if len(text) == 10:
        text += " 06:00"
    return datetime.fromisoformat(text).replace(tzinfo=timezone.utc)


CLOCK = Clock(at("2026-08-03 09:30"))


def rows_of(spark, schema, rows: list[dict], default: dict):
    filled = [{**default, **r} for r in rows]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in filled], schema)


def make_tables(spark, leads=(), events=(), calls=(), geo=(), users=()) -> CrmTables:
    lead_default = {
        "created_at": at("2026-07-10"),
        "updated_at": at("2026-08-01"),
        "status": "Open",
        "stage": "Call Not Connected",
        "assigned_lrm": "u1",
        "customer_phone_number": "9800000001",
    }
    numbered = [{"event_id": f"e{i:03d}", "lead_id": "A", **e} for i, e in enumerate(events)]
    return CrmTables(
        lead=rows_of(spark, schemas.LEAD, [{"lead_id": "A", **r} for r in leads], lead_default),
        history=rows_of(spark, schemas.LEAD_HISTORY, numbered, {}),
        call_log=rows_of(
            spark, schemas.CALL_LOG, list(calls), {"call_to": "09800000001", "response_call_duration": "00:00:05"}
        ),
        geo=rows_of(spark, schemas.GEO, list(geo), {"pincode_status": "active"}),
        users=rows_of(spark, schemas.USERS, list(users), {}),
    )

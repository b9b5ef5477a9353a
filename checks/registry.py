"""All registered queries and their SQL."""

from __future__ import annotations

from checks import queries_data, queries_org, queries_queue, queries_rules, registration

MODULES = (queries_queue, queries_rules, queries_org, queries_data)


def queries() -> dict:
    return dict(registration.QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(registration.SQL)

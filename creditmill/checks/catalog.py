"""All registered queries."""

from __future__ import annotations

from creditmill.checks import drifts, features, joins, logs, models, rows, streams  # noqa: F401
from creditmill.checks.registry import QUERIES, SQL


def queries():
    return dict(QUERIES)


def oracle_sql():
    return dict(SQL)

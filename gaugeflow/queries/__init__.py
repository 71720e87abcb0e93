"""Queries over the given tables, each beside its DuckDB equivalent."""

from __future__ import annotations

from . import aggregates, audits, evaluation, files, learning, policies, profiles, risks, splitting, streams, trending, windows  # noqa: F401
from ._registry import QUERIES, SQL

FLAGSHIP = "combined_risk"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

"""Catalogue of the registered queries and their SQL."""

from __future__ import annotations

from tallyloom.plans import numeric_queries, relational_queries, series_queries, source_queries, text_queries  # noqa: F401  register
from tallyloom.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

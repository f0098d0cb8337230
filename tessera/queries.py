"""Registered queries and their SQL."""

from __future__ import annotations

from tessera.plans import file_queries, scalar_queries, spatial_queries, stateful_queries, tree_queries  # noqa: F401
from tessera.plans.registry import QUERIES, SQL


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

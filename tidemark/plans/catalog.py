"""All named queries of the library."""

from __future__ import annotations

from tidemark.plans import curves, features, flow, micro, models, patterns, positions, screens  # noqa: F401  (modules register their queries when imported)
from tidemark.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

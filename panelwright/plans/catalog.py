"""Every core query by name, with its SQL."""

from __future__ import annotations

from panelwright.plans import deltas, further, io, matrix, metrics, models, relational, selection, text, transfer  # noqa: F401  they register
from panelwright.plans.registry import QUERIES, SQL, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)

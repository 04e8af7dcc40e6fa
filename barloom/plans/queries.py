"""All registered queries of the library itself."""

from __future__ import annotations

from barloom.plans import bars, indicators, mining, relational, streams  # noqa: F401  importing them registers their queries
from barloom.plans.registry import ORACLES, QUERIES, Query


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

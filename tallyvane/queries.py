"""Registered queries of the telemetry operators and their SQL."""

from __future__ import annotations

from .plans import aggregate_queries, decode_queries, rule_queries
from .plans.registry import ORACLES, QUERIES, Query

_ = (aggregate_queries, decode_queries, rule_queries)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)

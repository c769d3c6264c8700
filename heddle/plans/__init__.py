"""Registered queries over the driver's tables, and the same in DuckDB's SQL."""

from __future__ import annotations

from heddle.plans import operator_queries, queries, sql

QUERIES = queries.QUERIES | operator_queries.QUERIES
ORACLES = sql.ORACLES | operator_queries.ORACLES

__all__ = ["ORACLES", "QUERIES"]

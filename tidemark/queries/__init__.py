"""Queries of the engine's own operators, and their DuckDB oracles."""

from __future__ import annotations

from tidemark.queries import evaluation, models, records, relational, series, streams
from tidemark.registry import Query

QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
for _part in (series, relational, evaluation, records, models, streams):
    if twice := QUERIES.keys() & _part.reg.queries.keys():
        raise ValueError(f"registered twice: {sorted(twice)}")
    QUERIES |= _part.reg.queries
    ORACLE_SQL |= _part.reg.oracles

"""All queries of the engine and their SQL, by name."""

from __future__ import annotations

from . import event_queries, record_queries, strategy_queries

_PARTS = (strategy_queries, event_queries, record_queries)
QUERIES = {k: f for p in _PARTS for k, f in p.QUERIES.items()}
SQL = {k: s for p in _PARTS for k, s in p.SQL.items()}

"""All queries of the engine's own operators, with their DuckDB oracles."""

from __future__ import annotations

from memlake.queries import ORACLES, REGISTRY, context_queries, graph_queries, search_queries

__all__ = ["ORACLE_SQL", "QUERIES", "context_queries", "graph_queries", "search_queries"]

QUERIES = REGISTRY
ORACLE_SQL = ORACLES

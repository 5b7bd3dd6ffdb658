"""Queries of the library by name, and their DuckDB SQL."""

from __future__ import annotations

from sievemark.plans import client_queries, flow_queries, ops_queries, scan_queries

_MODULES = (scan_queries, flow_queries, client_queries, ops_queries)

QUERIES: dict = {k: v for m in _MODULES for k, v in m.QUERIES.items()}
ORACLES: dict[str, str] = {k: v for m in _MODULES for k, v in m.ORACLES.items()}

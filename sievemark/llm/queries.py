"""All queries of this subpackage, and their DuckDB SQL where SQL can express them."""

from __future__ import annotations

from importlib import import_module

_MODULES = tuple(f"op{n}_queries" for n in (1, 2, 3, 4, 5, 6, 7, 8, 9, 10))

QUERIES: dict = {}
ORACLES: dict = {}
for _name in _MODULES:
    _module = import_module(f"sievemark.llm.{_name}")
    QUERIES |= _module.QUERIES
    ORACLES |= _module.ORACLES

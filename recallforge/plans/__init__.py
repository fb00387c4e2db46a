"""Registered queries and the SQL beside them."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("text_queries", "search_queries", "store_queries", "graph_queries")


def registered() -> tuple[dict, dict]:
    """(queries, SQL) by name."""
    for name in _MODULES:
        import_module(f"{__name__}.{name}")
    from .registry import QUERIES, SQL

    return QUERIES, SQL

"""Queries by name, with SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLE: dict[str, str] = {}


def query(name: str, sql: str | None = None, views: str = ""):
    """Registers a function of the derived tables. views: the SQL views that the SQL reads, by name."""

    def put(f: Callable) -> Callable:
        QUERIES[name] = f
        if sql:
            from .views import with_views

            ORACLE[name] = with_views(sql, views.split())
        return f

    return put

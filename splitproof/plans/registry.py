"""All queries of the reference's own operators, keyed by operator, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable:
    """Register a query, with SQL for the same rows where SQL can express it."""

    def add(fn: Callable) -> Callable:
        if name in QUERIES:
            raise ValueError(f"two queries are called {name}")
        QUERIES[name] = fn
        if sql is not None:
            ORACLE_SQL[name] = sql
        return fn

    return add


from . import audit, evaluation, scalars  # noqa: E402, F401

"""Registry of the engine's own queries and their SQL counterparts."""

from __future__ import annotations

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Registers ``f(spark, folder)`` under ``name`` with the ANSI SQL that gives the same rows."""

    def add(f):
        QUERIES[name] = f
        if sql is not None:
            SQL[name] = sql
        return f

    return add

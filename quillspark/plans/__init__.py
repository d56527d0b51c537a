"""Queries over the standard tables, one per operator, with SQL counterparts."""

from __future__ import annotations

import importlib

MODULES: tuple[str, ...] = ("catalog_queries", "text_queries", "retrieval_queries", "contradiction_queries", "gateway_queries", "change_queries")


def load_queries() -> dict:
    from quillspark.plans.catalogue import QUERIES

    for m in MODULES:
        importlib.import_module(f"quillspark.plans.{m}")
    return dict(QUERIES)


def load_sql() -> dict[str, str]:
    from quillspark.plans.catalogue import SQL

    load_queries()
    return dict(SQL)

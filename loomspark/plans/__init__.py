"""Registered queries: each module has ``QUERIES`` (name to ``f(spark, folder)``) and ``SQL`` (name to the same in SQL)."""

from __future__ import annotations

from importlib import import_module

_MODULES = ("hierarchy", "corpus", "anchors", "deps", "flows")


def collect() -> tuple[dict, dict]:
    """All queries and SQL texts of the core."""
    queries: dict = {}
    sql: dict = {}
    for name in _MODULES:
        m = import_module(f"loomspark.plans.{name}")
        queries |= m.QUERIES
        sql |= m.SQL
    return queries, sql

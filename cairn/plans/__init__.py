"""Registered queries: each ``(spark, sf_dir) -> DataFrame`` plus DuckDB oracle text."""

from __future__ import annotations


def query_registry():
    """A module's (QUERIES, ORACLE, register): ``@register(name, sql)`` records the
    query function and, when given, its oracle SQL."""
    queries: dict = {}
    oracle: dict = {}

    def register(name: str, sql: str | None = None):
        def deco(fn):
            queries[name] = fn
            if sql is not None:
                oracle[name] = sql
            return fn
        return deco

    return queries, oracle, register

"""Collects every registered query and its oracle text."""

from __future__ import annotations

import importlib

from cairn.plans.oracle import with_views
from cairn.session import ship_package


def _shipped(fn):
    def run(spark, sf_dir):
        ship_package(spark)
        # timestamps of the landed tables are UTC wall clock (as in the oracle)
        spark.conf.set("spark.sql.session.timeZone", "UTC")
        return fn(spark, sf_dir)
    run.__name__ = getattr(fn, "__name__", "query")
    run.__doc__ = fn.__doc__
    return run


MODULES = (
    "cairn.plans.corpus",
    "cairn.plans.conversation",
    "cairn.plans.inputs",
    "cairn.plans.registry",
    "cairn.plans.retrieval",
    "cairn.plans.io",
    "cairn.plans.streams",
)


def _load():
    queries, oracle = {}, {}
    for m in MODULES:
        mod = importlib.import_module(m)
        for name, fn in mod.QUERIES.items():
            if name in queries:
                raise ValueError(f"duplicate query {name}")
            queries[name] = _shipped(fn)
        for name, sql in mod.ORACLE.items():
            oracle[name] = with_views(sql)
    return queries, oracle


def queries():
    return _load()[0]


def oracle_sql():
    return _load()[1]

"""Named queries of the analytics engine and the SQL that must give the same rows."""

from __future__ import annotations

import importlib

QUERIES: dict = {}
ORACLES: dict = {}
FLAGSHIP = "agg1_overview"


def query(name: str, sql: str | None = None, recursive: bool = False):
    """Register a query (spark, sf_dir) -> DataFrame; sql may name the stand-in tables."""

    def add(f):
        from .plans.standins import with_ctes

        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = with_ctes(sql, recursive)
        return f

    return add


for _module in ("findings", "analytics", "history", "scanning", "dependencies", "graph", "exchange", "extras", "streams", "state", "changes", "sql"):
    importlib.import_module(f"sievework.plans.{_module}")

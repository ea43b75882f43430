"""Registered queries and, where SQL can express them, their SQL."""

from __future__ import annotations

import importlib
from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function (spark, sf_dir) -> DataFrame under its name, with its SQL."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


for _part in ("ledger_queries", "event_queries", "text_queries", "join_queries", "finance_queries", "format_queries", "document_queries", "conform_queries", "report_queries", "wellbeing_queries", "graph_queries", "reader_queries", "extra_queries", "registry_queries"):
    importlib.import_module(f"ledgerloom.plans.{_part}")

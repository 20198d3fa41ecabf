"""Registered queries over the given tables, each with its SQL counterpart."""

from __future__ import annotations

from . import children, history, ledger, pages, records

MODULES = (history, records, children, ledger, pages)


def all_queries() -> dict:
    return {name: run for m in MODULES for name, run in m.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for m in MODULES for name, sql in m.SQL.items()}

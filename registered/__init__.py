"""Registered queries: each Spark query next to the SQL that must give the same rows."""

from __future__ import annotations

from importlib import import_module

_GROUPS = ("telemetry", "windows", "sequences", "evidence", "reports", "models")


def _load():
    for group in _GROUPS:
        import_module(f"registered.{group}")
    from registered import base

    return base


def all_queries():
    return dict(_load().QUERIES)


def all_sql():
    return dict(_load().SQL)

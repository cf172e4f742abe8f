"""Registered queries and the SQL that states the same thing."""

from __future__ import annotations

from collections.abc import Callable

QUERIES: dict[str, Callable] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register a function of (spark, sf_dir), with its SQL if it has one."""

    def keep(f):
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return keep


def load() -> None:
    from tabulon.queries import functions, graphs, reports, sheets, tables  # noqa: F401

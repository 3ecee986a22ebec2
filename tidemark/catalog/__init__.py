"""Queries of the library by section of the operator inventory, each with SQL that gives the same rows where SQL can."""

from __future__ import annotations

from importlib import import_module

SECTIONS = ("scans", "scalars", "joins", "aggregates", "windows", "folds", "signals", "weights", "models", "stats", "forecasts", "sets", "streams")


def load() -> tuple[dict, dict]:
    queries, sql = {}, {}
    for name in SECTIONS:
        section = import_module(f"tidemark.catalog.{name}")
        queries.update(section.book.queries)
        sql.update(section.book.sql)
    return queries, sql

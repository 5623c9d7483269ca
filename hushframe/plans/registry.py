"""All registered queries and their SQL."""

from __future__ import annotations

from hushframe.plans import (
    advice, budgets, charts, comparing, distances, files, noising, profiling, protecting,
)

MODULES = (profiling, noising, protecting, budgets, comparing, distances, advice, charts, files)


def all_queries() -> dict:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def all_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}

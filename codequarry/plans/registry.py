"""Every query of the library by name, with the SQL that states its result.

Queries are plans over DataFrames (operators, streaming); the SQL is written apart from them, from the
definition of each operator, and is run by DuckDB alone.
"""

from __future__ import annotations

from collections.abc import Callable
from importlib import import_module

from pyspark.sql import DataFrame

from codequarry.plans.adapter_sql import with_views
from codequarry.sources.code import Code, code

MODULES = (*(f"operators.{x}" for x in ("screens", "lookups", "graph", "scores", "history", "project", "text", "gates", "components", "merges", "synthesis", "storage")), "streaming.changes")
PLANS: dict[str, Callable[[Code], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a plan by its function's name."""

    def add(plan):
        PLANS[plan.__name__] = plan
        if sql:
            SQL[plan.__name__] = sql.strip()
        return plan

    return add


def load() -> None:
    for name in MODULES:
        import_module(f"codequarry.{name}")


def queries() -> dict:
    load()
    return {name: lambda spark, sf_dir, plan=plan: plan(code(spark, sf_dir)) for name, plan in PLANS.items()}


def oracle_sql() -> dict:
    load()
    return {name: with_views(text) for name, text in SQL.items()}

"""Registered queries: one Spark callable and (where SQL can say it) one
DuckDB oracle text per operator.

Each callable takes ``(spark, sf_dir)``, derives the shipment rows from the
test tables and runs the operator over **all** of them. Query modules add
themselves to ``REGISTRY`` on import.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .sources.fixtures import with_shipments

QueryFn = Callable[[SparkSession, str], DataFrame]

REGISTRY: dict[str, tuple[QueryFn, str | None]] = {}


def register(name: str, sql: str | None = None, raw_sql: str | None = None):
    """Register a query. ``sql`` gets the shipment CTEs prefixed; ``raw_sql``
    is used as is (queries on the plain test tables)."""
    def deco(fn: QueryFn) -> QueryFn:
        if name in REGISTRY:
            raise ValueError(f"duplicate query {name}")
        oracle = with_shipments(sql) if sql is not None else raw_sql
        REGISTRY[name] = (fn, oracle)
        return fn
    return deco


def _load_all() -> None:
    """Import the query modules (each registers its queries on import)."""
    from .plans import (queries_core, queries_eda, queries_functions, queries_ingest,  # noqa: F401
                        queries_ml, queries_report, queries_series)
    if "region_report" not in REGISTRY:
        queries_functions.register_region_report()


def queries() -> dict[str, QueryFn]:
    _load_all()
    return {k: v[0] for k, v in REGISTRY.items()}


def oracle_sql() -> dict[str, str]:
    _load_all()
    return {k: v[1] for k, v in REGISTRY.items() if v[1] is not None}

"""Registered queries of the engine's own operators, and the SQL that DuckDB compares them with."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quarry.fixtures import Views, with_views

Query = Callable[[SparkSession, str], DataFrame]
FLAGSHIP = "m09_query_metrics"
PLANS = ("ids", "text", "metrics", "aggregates", "windows", "joins", "retrieval", "stats", "storage", "streams")

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Callable[[Views], DataFrame]], Callable[[Views], DataFrame]]:
    """Register a function of the views; `sql` may use the same views by name."""

    def put(f: Callable[[Views], DataFrame]) -> Callable[[Views], DataFrame]:
        if name in _QUERIES:
            raise ValueError(f"{name} is registered twice")
        _QUERIES[name] = lambda spark, sf_dir: f(Views(spark, sf_dir))
        if sql:
            _SQL[name] = with_views(sql)
        return f

    return put


def _load() -> None:
    for m in PLANS:
        importlib.import_module(f"quarry.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

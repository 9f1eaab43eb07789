"""All registered queries and their SQL twins."""

from __future__ import annotations

import importlib
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tidemark.fixtures import Tables, with_

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, tuple[str, str | Callable[[], str]]] = {}
MODULES = ("tape", "study", "sentiment", "text", "evidence", "theses", "desk", "stream")


def query(name: str, needs: str = "", sql: str | Callable[[], str] | None = None):
    """Register a function of Tables as a query; sql is its DuckDB twin over the fixtures in `needs`."""

    def put(f: Callable[[Tables], DataFrame]):
        _QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql:
            _SQL[name] = (needs, sql)
        return f

    return put


def _load() -> None:
    for m in MODULES:
        importlib.import_module(f"tidemark.plans.{m}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    texts = {name: (needs, sql() if callable(sql) else sql) for name, (needs, sql) in _SQL.items()}
    return {name: with_(needs, sql) if needs else sql for name, (needs, sql) in texts.items()}

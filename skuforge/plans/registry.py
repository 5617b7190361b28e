"""All catalogue queries with their SQL: query modules register themselves through `query`."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

Query = Callable[[SparkSession, str], DataFrame]

_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None) -> Callable[[Query], Query]:
    """Registers the decorated function under a name, with its DuckDB SQL."""

    def add(run: Query) -> Query:
        if name in _QUERIES:
            raise ValueError(f"two queries have the name {name}")
        _QUERIES[name] = run
        if sql is not None:
            _SQL[name] = sql
        return run

    return add


def _load() -> None:
    import skuforge.plans as plans

    for module in pkgutil.iter_modules(plans.__path__):
        if module.name.startswith("q_"):
            importlib.import_module(f"{plans.__name__}.{module.name}")


def queries() -> dict[str, Query]:
    _load()
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    _load()
    return dict(_SQL)

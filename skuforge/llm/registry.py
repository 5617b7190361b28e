"""Queries of the corpus operators and, where SQL expresses them, their DuckDB SQL."""

from __future__ import annotations

import importlib
import pkgutil
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

import skuforge.llm.query as query_package

Query = Callable[[SparkSession, str], DataFrame]


def _modules() -> list:
    return [importlib.import_module(f"{query_package.__name__}.{m.name}") for m in sorted(pkgutil.iter_modules(query_package.__path__), key=lambda m: m.name)]


def queries() -> dict[str, Query]:
    return {m.NAME: m.run for m in _modules()}


def oracle_sql() -> dict[str, str]:
    return {m.NAME: m.SQL for m in _modules() if m.SQL}

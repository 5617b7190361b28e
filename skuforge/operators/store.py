"""The record store: a folder of Parquet, read newest first and cleared."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def load_all(records: DataFrame, updated: str, id_col: str, limit: int | None = 2000) -> DataFrame:
    """Stored records, newest first, ties to the larger id; `limit` at most (a listing's size), None for all. With a limit
    each task passes on that many rows, and there is no global sort."""
    rows = records.orderBy(F.desc(updated), F.desc(id_col))
    return rows if limit is None else rows.limit(limit)


def clear(spark: SparkSession, folder: str) -> int:
    """Empties a stored table, keeping its columns; returns how many rows it had. Readers see an empty table afterwards."""
    stored = spark.read.parquet(folder)
    n = stored.count()
    spark.createDataFrame([], stored.schema).write.mode("overwrite").parquet(folder)
    spark.catalog.refreshByPath(folder)
    return n

"""Working tables in the shared folder: they cut long plans, and a lost executor costs a reread. And how tables that grow are dealt
over tasks and joined."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; where that is unset, one of this machine, for a local master only."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = "/tmp/checkpoints"
    return base.rstrip("/")


def stored(df: DataFrame, name: str) -> str:
    """Writes df to a new folder in the shared one; returns it. Then the driver collects its garbage: Spark deletes a step's shuffle
    files only when the driver has noticed that nothing refers to them, and its heap goes back to what is in use."""
    to = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(to)
    df.sparkSession._jvm.System.gc()
    return to


#: Rows of a source that one task makes cells of, on average.
ROWS_A_TASK = 10_000


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt by key over as many tasks as its rows need. Files of values that repeat are small, so that Spark would give one task
    millions of rows, and what is made of them is many times as large. Rows are counted from the files' footers."""
    n = -(-df.count() // ROWS_A_TASK)
    return df.repartition(n, key) if n > 1 else df


def growing(df: DataFrame) -> DataFrame:
    """df, a table that grows with the records, marked to be joined by a shuffle of both sides. Its size is estimated from files,
    which tell little about cells made of them: the optimiser would collect it in the driver and broadcast it."""
    return df.hint("merge")


def keys_of(fields: DataFrame) -> DataFrame:
    """record_id, keys: what keys a record has, each once. A join on the record and a look into its keys needs no shuffle by record and
    key, whose tasks would grow with the records: cells dealt by record stay where they are."""
    return fields.groupBy("record_id").agg(F.collect_set("key").alias("keys"))


def has_key(key: str) -> Column:
    """Whether the column key is among the record's keys; false for a record without cells or a null key."""
    return F.coalesce(F.array_contains("keys", F.col(key)), F.lit(False))


def save(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it again."""
    return df.sparkSession.read.schema(df.schema).parquet(stored(df, name))

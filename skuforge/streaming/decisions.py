"""Streaming forms of the decision log: the same operators over an unbounded table of events (an extension)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skuforge.sources import views

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampType()), T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def read_events(spark: SparkSession, folder: str, pattern: str = "events*.parquet") -> DataFrame:
    return spark.readStream.schema(EVENTS).option("pathGlobFilter", pattern).parquet(folder)


def decisions(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Decisions out of events, each id once within the time that late rows are waited for."""
    return views.decisions(events).withWatermark("ts", late).dropDuplicatesWithinWatermark(["decision_id"])


def _window(name: str, length: str, slide: str | None):
    return F.session_window("ts", length).alias(name) if slide == "session" else F.window("ts", length, slide or length).alias(name)


def agreement(rows: DataFrame, length: str = "1 day", slide: str | None = None, late: str | None = None) -> DataFrame:
    """window_start, reviewed, approved in tumbling, sliding (slide) or session (slide='session') windows. Works on a stream
    and on a table; late sets a watermark where the stream has none yet."""
    rows = rows.withWatermark("ts", late) if late else rows
    g = rows.groupBy(_window("w", length, slide)).agg(F.count("*").alias("reviewed"), F.count(F.when(F.col("decision") == "approved", 1)).alias("approved"))
    return g.select(F.col("w.start").alias("window_start"), "reviewed", "approved")


def upsert(folder: str):
    """A foreachBatch function that keeps the latest decision on each sku and field in a Parquet folder of versions; a batch
    written twice gives the same version, so a restart repeats no change."""
    from skuforge.operators import review

    def write(batch: DataFrame, epoch: int) -> None:
        old = f"{folder}/version={epoch - 1}"
        rows = batch
        if epoch > 0:
            rows = batch.sparkSession.read.schema(batch.schema).parquet(old).unionByName(batch)
        review.latest(rows).select(*batch.columns).write.mode("overwrite").parquet(f"{folder}/version={epoch}")

    return write

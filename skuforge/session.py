"""Session settings shared by the tests, the benchmark and users who have no session of their own."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def get_session(cores: int | str = "*", shuffle_partitions: int = 8, app: str = "skuforge") -> SparkSession:
    """A local session: UTC, adaptive execution, few shuffle partitions. On a cluster, bring your own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", os.environ.get("SKUFORGE_DRIVER_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .getOrCreate()
    )

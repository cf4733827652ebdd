"""A Spark session with the settings that the library relies on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.sql.parquet.filterPushdown": "true",
    "spark.sql.cbo.enabled": "true",
    "spark.sql.cbo.joinReorder.enabled": "true",
}


def build_session(name: str = "lakemill", master: str | None = None, **extra: str) -> SparkSession:
    """The running session, or a new one; without a master from outside a local one with a partition per core."""
    builder = SparkSession.builder.appName(name)
    if master or not os.environ.get("SPARK_MASTER"):
        cores = os.cpu_count() or 1
        builder = builder.master(master or f"local[{cores}]").config("spark.sql.shuffle.partitions", str(cores))
    for key, value in (SETTINGS | extra).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

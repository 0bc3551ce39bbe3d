"""A Spark session with the settings the plans are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(master: str | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    """The running session or a new one: UTC, adaptive execution and skew joins on.

    On a cluster leave ``master`` and ``partitions`` to spark-submit and adaptive execution.
    """
    builder = SparkSession.builder.appName("plumbline")
    if master:
        builder = builder.master(master)
    known = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true", "spark.ui.showConsoleProgress": "false",
    }
    if partitions:
        known["spark.sql.shuffle.partitions"] = str(partitions)
    for key, value in {**known, **settings}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

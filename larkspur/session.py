"""A session with the engine's settings."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Adaptive execution sizes and splits shuffle partitions at run time; the count is only where it starts from.
SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def build(master: str | None = None, partitions: int | None = None, **settings: str) -> SparkSession:
    """A session; without ``master`` and ``partitions`` those of the cluster hold."""
    builder = SparkSession.builder.appName("larkspur").config(map=SETTINGS | settings)
    if master:
        builder = builder.master(master)
    if partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(partitions))
    return builder.getOrCreate()

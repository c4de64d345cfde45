"""A session with the settings that the library is tested with."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
}


def session(name: str = "corpusgraph", checkpoints: str | None = None, **settings: str) -> SparkSession:
    """*checkpoints* must be a folder that all executors see."""
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **settings}.items():
        builder = builder.config(key, value)
    if checkpoints is not None:
        builder = builder.config("spark.checkpoint.dir", checkpoints)
    return builder.getOrCreate()

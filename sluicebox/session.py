"""Session settings that the operators rely on or profit from."""

from __future__ import annotations

from pyspark.sql import SparkSession

SETTINGS = {
    # Times are compared and printed in UTC.
    "spark.sql.session.timeZone": "UTC",
    # Sizes of joins and partitions are decided while the query runs; skewed joins are split.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def session(app: str = "sluicebox", **settings: str) -> SparkSession:
    """A session with the settings above; keyword arguments use ``__`` for the dots in a setting's name."""
    builder = SparkSession.builder.appName(app)
    for name, value in {**SETTINGS, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()

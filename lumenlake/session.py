"""Session factory with the settings that the library relies on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lumenlake", **conf: str) -> SparkSession:
    """A session in UTC with adaptive execution; conf overrides or adds settings."""
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.ui.enabled": "false",
    }
    builder = SparkSession.builder.appName(name)
    for key, value in {**settings, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

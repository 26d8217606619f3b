"""Session defaults: UTC, adaptive execution; sizes stay with the cluster."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tidemill", **options: str) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | options).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

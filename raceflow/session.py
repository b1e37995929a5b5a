"""A SparkSession with the settings that the library's queries expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "raceflow", master: str | None = None, **conf: str) -> SparkSession:
    """AQE with skew joins and coalescing on, ANSI on, UTC; other settings by keyword with __ for dots."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.ansi.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()

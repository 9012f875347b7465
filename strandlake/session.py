"""A SparkSession with the settings that the library expects."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "strandlake", master: str | None = None, **conf: str) -> SparkSession:
    """ANSI on, UTC, adaptive execution with skewed joins split; the cluster's own settings are left alone unless given in ``conf``."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.ansi.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in (defaults | conf).items():
        builder = builder.config(key, value)
    return builder.getOrCreate()

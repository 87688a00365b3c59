"""Session settings for linkage jobs."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "cairn", **conf: str) -> SparkSession:
    """A session with adaptive plans, skew joins and Arrow; conf overrides (dots as double underscores)."""
    b = SparkSession.builder.appName(app)
    settings = {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return b.config(map=settings).getOrCreate()

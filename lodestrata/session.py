"""Sessions with the settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "lodestrata", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution with skew joins, fair scheduling of the tiers of one search.

    Sizes (shuffle partitions, memory) stay the cluster's: pass them as conf, dots written as underscores twice.
    """
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.scheduler.mode": "FAIR", "spark.sql.execution.arrow.pyspark.enabled": "true",
    } | {k.replace("__", "."): v for k, v in conf.items()}
    return builder.config(map=settings).getOrCreate()

"""The session that the library is written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(app: str = "geoloom", master: str | None = None, **conf: str) -> SparkSession:
    """UTC, adaptive execution, later duplicates of a map's key win; other settings as given."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.mapKeyDedupPolicy": "LAST_WIN",
        **conf,
    }
    return builder.config(map=settings).getOrCreate()

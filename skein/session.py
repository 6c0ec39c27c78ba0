"""The session settings that the operators expect."""

from __future__ import annotations

from pyspark.sql import SparkSession


def build(app: str = "skein", **settings: str) -> SparkSession:
    """A session in UTC with adaptive execution; further settings by keyword, dots as double underscores."""
    b = SparkSession.builder.appName(app)
    fixed = {"spark.sql.session.timeZone": "UTC", "spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"}
    for k, v in {**fixed, **{k.replace("__", "."): v for k, v in settings.items()}}.items():
        b = b.config(k, v)
    return b.getOrCreate()

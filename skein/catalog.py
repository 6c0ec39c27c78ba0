"""The tables that queries read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


class Tables:
    """Tables of one folder by attribute: Tables(spark, folder).lineitem."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        if name.startswith("_"):
            raise AttributeError(name)
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")

"""Tables between the rounds of a loop: lineage ends there, and a lost executor costs nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, removed when the application ends.

    Where none is set, a temporary one is used by a local session (as in tests); a cluster is refused, as its machines
    share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        base = getattr(shared_folder, "local", None) or f"file://{tempfile.mkdtemp(prefix='skein-')}"
        shared_folder.local = base
    path = f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def settled(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read again."""
    path = shared_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)

"""Helpers shared by the operators of this subpackage: tables, scratch space, connected components."""

from __future__ import annotations

import gc
import os
import tempfile
import uuid
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows in one Arrow batch.  Small, so that a batch of long texts stays within a Python worker's memory.
BATCH_ROWS = 256


def small_batches(spark: SparkSession) -> None:
    """Small Arrow batches, and this package where the Python workers find it."""
    _shipped(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))


def _shipped(spark: SparkSession) -> None:
    """Send the package to the workers, once a context, unless their path has it."""
    sc = spark.sparkContext
    top = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    if getattr(sc, "_skein_sent", False) or top in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    folder = tempfile.mkdtemp(prefix="skein-code-")
    path = os.path.join(folder, "skein.zip")
    with zipfile.ZipFile(path, "w") as z:
        for at, _, names in os.walk(os.path.join(top, "skein")):
            for n in names:
                if n.endswith(".py"):
                    z.write(os.path.join(at, n), os.path.relpath(os.path.join(at, n), top))
    sc.addPyFile(path)
    sc._skein_sent = True


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, removed when the application ends.

    Where none is set, a temporary one is used by a local session (as in tests); a cluster is refused, as its
    machines share no such folder.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir names no shared folder")
        base = getattr(scratch_dir, "local", None) or tempfile.mkdtemp(prefix="skein-")
        scratch_dir.local = base
        base = f"file://{base}"
    path = f"{base.rstrip('/')}/skein-{uuid.uuid4().hex}"
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(jpath)
    return path


def stored(df: DataFrame, path: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it again: lineage ends there, and a lost executor costs nothing."""
    spark = df.sparkSession
    path = path or scratch_dir(spark)
    schema = df.schema
    df.write.mode("overwrite").parquet(path)
    out = spark.read.schema(schema).parquet(path)
    out._skein_path = path
    return out


def dropped(df: DataFrame) -> None:
    """Remove a table made by stored() that nothing reads any more."""
    spark, path = df.sparkSession, df._skein_path
    jpath = spark._jvm.org.apache.hadoop.fs.Path(path)
    jpath.getFileSystem(spark._jsc.hadoopConfiguration()).delete(jpath, True)


def released(spark: SparkSession) -> None:
    """Let Spark remove the shuffle files of plans that are done with; it does so when the driver collects its garbage."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) for the nodes of undirected links (a, b); component: the smallest node reachable.

    Alternating large-star and small-star contraction.  Each star is one aggregate (with map-side partial
    minima) and one equi-join of two stored tables, so a hub is split by the adaptive skew join rather than
    gathered in a task.  Self links and repeated links are allowed; no links give an empty table.
    """

    def star(e: DataFrame, larger: bool) -> DataFrame:
        if larger:
            near = e.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(e.select(F.col("b").alias("u"), F.col("a").alias("v")))
        else:
            near = e.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        least = stored(near.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")))
        linked = near.join(least, "u")
        if larger:
            out = linked.where("v > u").select(F.col("v").alias("a"), F.col("m").alias("b"))
        else:
            out = linked.select(F.col("v").alias("a"), F.col("m").alias("b")).unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        new = stored(out.where("a <> b").distinct())
        dropped(least)
        return new

    now = stored(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    state = _digest(now)
    for _ in range(rounds):
        if state[0] == 0:
            break
        big = star(now, True)
        small = star(big, False)
        dropped(now)
        dropped(big)
        now, before = small, state
        state = _digest(now)
        if state == before:
            break
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(now.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct())


def _digest(e: DataFrame) -> tuple:
    r = e.agg(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    return r["n"], r["x"]

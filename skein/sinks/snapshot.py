"""A table in versions: Parquet files that never change, and a manifest that says which of them are the table.

Rows are dealt into parts by a hash of their key.  A change rewrites only the parts that it touches, into a new folder; then a new
manifest, which names the new folders of those parts and the old ones of all others, is put in place by a rename that fails
if that version exists.  So a crash before the rename leaves the table as it was, a reader sees one version or the
other, and of two writers one is told to try again.  Manifests remember the last batch of each stream, so a batch that
comes twice is written once.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Parts of a new table.
PARTS = 32


class Conflict(RuntimeError):
    """Another writer has published this version."""


class Snapshots:
    """The table at `root`, a folder that all machines reach; `schema` and `keys` are needed where it is new."""

    def __init__(self, spark: SparkSession, root: str, schema: str | None = None, keys: list[str] | None = None, parts: int = PARTS):
        self.spark, self.root = spark, root.rstrip("/")
        hadoop = spark._jvm.org.apache.hadoop.fs
        self._path = hadoop.Path
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._fs.mkdirs(self._path(f"{self.root}/manifests"))
        if self.version() == 0 and schema is not None:
            fields = spark.createDataFrame([], schema).schema.jsonValue()
            self._put({"version": 1, "schema": fields, "keys": keys or [], "parts": parts, "folders": {}, "batches": {}})

    # ---- manifests ----

    def versions(self) -> list[int]:
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(f"{self.root}/manifests"))]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def version(self) -> int:
        """The present version, 0 where there is none."""
        return max(self.versions(), default=0)

    def manifest(self, version: int | None = None) -> dict:
        at = self._path(f"{self.root}/manifests/v{version or self.version():012d}.json")
        stream = self._fs.open(at)
        try:
            return json.loads(self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def _put(self, manifest: dict) -> None:
        to, name = f"{self.root}/manifests/v{manifest['version']:012d}.json", self._path(f"{self.root}/manifests/_{uuid.uuid4().hex}")
        out = self._fs.create(name, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        gateway, rename = self.spark.sparkContext._gateway, getattr(self.spark._jvm.org.apache.hadoop.fs, "Options$Rename")
        never = gateway.new_array(rename, 1)
        never[0] = rename.NONE
        files = self.spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        try:
            files.rename(self._fs.makeQualified(name), self._fs.makeQualified(self._path(to)), never)
        except Exception as e:
            self._fs.delete(name, False)
            if "FileAlreadyExists" in str(e):
                raise Conflict(to) from e
            raise

    # ---- reads and writes ----

    def _rows(self, manifest: dict, parts: list[int] | None = None) -> DataFrame:
        schema = StructType.fromJson(manifest["schema"])
        folders = [f"{self.root}/{f}" for p, f in manifest["folders"].items() if parts is None or int(p) in parts]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """All rows of a version, by default the present one; later versions do not change what it holds."""
        return self._rows(self.manifest(version))

    def change(self, rows: DataFrame, merge: Callable[[DataFrame, DataFrame], DataFrame], stream: str | None = None, batch: int | None = None) -> int:
        """The version after a change: merge(rows that the touched parts hold, new rows) is what they hold then.

        merge may be given any rows with the keys' columns, must keep rows of untouched keys, and returns the table's columns.  With
        `stream` and `batch` a batch that has been written already changes nothing.
        """
        m = self.manifest()
        if stream is not None and m["batches"].get(stream, -1) >= batch:
            return m["version"]
        part = F.pmod(F.xxhash64(*m["keys"]), F.lit(m["parts"])).cast("int")
        touched = sorted(r[0] for r in rows.select(part.alias("p")).distinct().collect())  # at most one number a part
        new = dict(m, version=m["version"] + 1, folders=dict(m["folders"]), batches=dict(m["batches"], **({stream: batch} if stream is not None else {})))
        if touched:
            folder = f"data/{uuid.uuid4().hex}"
            columns = StructType.fromJson(m["schema"]).fieldNames()
            out = merge(self._rows(m, touched), rows).select(*columns).withColumn("_part", part)
            out.repartition("_part").write.partitionBy("_part").parquet(f"{self.root}/{folder}")
            for p in touched:
                at = f"{folder}/_part={p}"
                if self._fs.exists(self._path(f"{self.root}/{at}")):
                    new["folders"][str(p)] = at
                else:
                    new["folders"].pop(str(p), None)
        self._put(new)
        return new["version"]

    def upsert(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Rows by key: new ones replace old ones; of several new ones of a key the first in the order of all columns."""
        keys = self.manifest()["keys"]

        def merge(old: DataFrame, new: DataFrame) -> DataFrame:
            rest = [c for c in old.columns if c not in keys]
            one = new.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("m")).select(*keys, "m.*") if rest else new.select(*keys).distinct()
            return old.join(one, keys, "left_anti").unionByName(one)

        return self.change(rows, merge, stream, batch)

    def append(self, rows: DataFrame, stream: str | None = None, batch: int | None = None) -> int:
        """Rows beside those that are there."""
        return self.change(rows, lambda old, new: old.unionByName(new.select(*old.columns)), stream, batch)

    def replace(self, rows: DataFrame, whole: list[str], stream: str | None = None, batch: int | None = None) -> int:
        """Rows in place of all that share the values of `whole`, which must be the keys: what a document or file was goes with it."""
        if sorted(whole) != sorted(self.manifest()["keys"]):
            raise ValueError("rows are replaced by the table's keys")
        return self.change(rows, lambda old, new: old.join(new.select(*whole).distinct(), whole, "left_anti").unionByName(new.select(*old.columns)), stream, batch)

    def remove(self, keys: DataFrame) -> int:
        """Rows without those of the given keys."""
        return self.change(keys, lambda old, gone: old.join(gone, self.manifest()["keys"], "left_anti"))

    def vacuum(self, keep: int = 2) -> int:
        """Removes manifests but the last `keep`, and folders that none of those names; how many folders went.  Not while a change runs."""
        versions = self.versions()
        for v in versions[:-keep]:
            self._fs.delete(self._path(f"{self.root}/manifests/v{v:012d}.json"), False)
        held = {f for v in versions[-keep:] for f in self.manifest(v)["folders"].values()}
        gone = 0
        at = self._path(f"{self.root}/data")
        for run in self._fs.listStatus(at) if self._fs.exists(at) else []:
            mine = [s.getPath() for s in self._fs.listStatus(run.getPath())]
            for p in mine:
                if p.getName().startswith("_part=") and f"data/{run.getPath().getName()}/{p.getName()}" not in held:
                    gone += self._fs.delete(p, True)
            if not any(f.startswith(f"data/{run.getPath().getName()}/") for f in held):
                self._fs.delete(run.getPath(), True)
        return gone

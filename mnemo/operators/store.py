"""Tables in one folder under a manifest: what a manifest does not name does not exist for readers.

A write stages files in folders of its own and publishes them by one rename of a new manifest; a writer
that fails before that leaves no trace, a reader keeps the manifest it opened. Tables may be dealt over
buckets by a hash of their keys, so that an upsert rewrites the buckets that the batch touches and no
others.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mnemo.operators.frames import upsert_nodes


class Conflict(RuntimeError):
    """Another writer published first; nothing of this write is visible."""


class Store:
    """path/_manifest/<version>.json names the folders of each table: {table: {"schema": ..., "parts": {bucket: folder}, ...}}."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        jvm = spark.sparkContext._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._files = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        at = self._path(f"{self.path}/_manifest")
        if not self._files.exists(at):
            return []
        names = [s.getPath().getName() for s in self._files.listStatus(at)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """The named manifest, by default the newest; an empty one for a store that has none."""
        found = self.versions()
        if not found:
            return {"version": 0, "tables": {}, "batches": {}}
        version = found[-1] if version is None else version
        stream = self._files.open(self._path(f"{self.path}/_manifest/{version:012d}.json"))
        try:
            return json.loads(bytes(stream.readAllBytes()).decode())
        finally:
            stream.close()

    def publish(self, manifest: dict) -> int:
        """Makes a manifest the next version of the one it was read as; raises Conflict if that version is taken."""
        version = manifest["version"] + 1
        folder = f"{self.path}/_manifest"
        self._files.mkdirs(self._path(folder))
        tmp, to = self._path(f"{folder}/.{uuid.uuid4().hex}"), self._path(f"{folder}/{version:012d}.json")
        out = self._files.create(tmp, False)
        try:
            out.write(json.dumps(manifest | {"version": version}).encode())
        finally:
            out.close()
        jvm, conf = self.spark.sparkContext._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        try:
            none = self.spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
            jvm.org.apache.hadoop.fs.FileContext.getFileContext(tmp.toUri() if self.path.count("://") else self._files.getUri(), conf).rename(self._files.makeQualified(tmp), self._files.makeQualified(to), none)
        except Exception as e:
            self._files.delete(tmp, False)
            raise Conflict(f"version {version} is taken") from e
        return version

    def clear(self, keep: int = 2) -> list[str]:
        """Drops all but the newest manifests and the folders that none of those names; returns their names.
        To be run when no write is under way and readers of older manifests are done."""
        found = self.versions()
        live = {f for v in found[-keep:] for t in self.manifest(v)["tables"].values() for fs in t["parts"].values() for f in fs}
        for v in found[:-keep]:
            self._files.delete(self._path(f"{self.path}/_manifest/{v:012d}.json"), False)
        gone = []
        for s in self._files.listStatus(self._path(self.path)):
            name = s.getPath().getName()
            if name != "_manifest" and name not in {f.split("/")[0] for f in live}:
                self._files.delete(s.getPath(), True)
                gone.append(name)
        return gone

    # tables

    def read(self, table: str, manifest: dict | None = None, buckets: list | None = None) -> DataFrame:
        """A table as a manifest names it, or only some of its buckets."""
        known = (manifest or self.manifest())["tables"][table]
        folders = [f for b, fs in known["parts"].items() if buckets is None or int(b) in set(buckets) for f in fs]
        if not folders:
            return self.spark.createDataFrame([], known["schema"])
        return self.spark.read.schema(known["schema"]).parquet(*[f"{self.path}/{f}" for f in folders])

    def stage(self, df: DataFrame, bucketed: bool = False) -> dict[str, list[str]]:
        """Writes df to a folder of its own; with a column _bucket, a folder a bucket. Nothing is visible yet."""
        folder = uuid.uuid4().hex
        if not bucketed:
            df.write.parquet(f"{self.path}/{folder}")
            return {"0": [folder]}
        df.write.partitionBy("_bucket").parquet(f"{self.path}/{folder}")
        names = [s.getPath().getName() for s in self._files.listStatus(self._path(f"{self.path}/{folder}")) if s.isDirectory()]
        return {n.split("=")[1]: [f"{folder}/{n}"] for n in names if n.startswith("_bucket=")}

    def open(self, like: DataFrame, parts: dict[str, list[str]]) -> DataFrame:
        """What was staged, before it is published."""
        folders = [f"{self.path}/{f}" for fs in parts.values() for f in fs]
        return self.spark.read.schema(_ddl(like)).parquet(*folders) if folders else self.spark.createDataFrame([], _ddl(like))

    def append(self, tables: dict[str, DataFrame], batch: str | None = None, stage: Callable | None = None) -> int | None:
        """Rows for several tables that become visible together. A batch name that is already there changes nothing."""
        manifest = self.manifest()
        if batch is not None and batch in manifest["batches"].get("append", []):
            return None
        staged = {name: (stage or self.stage)(df) for name, df in tables.items()}
        for name, parts in staged.items():
            known = manifest["tables"].setdefault(name, {"schema": _ddl(tables[name]), "parts": {}})
            for b, fs in parts.items():
                known["parts"][b] = known["parts"].get(b, []) + fs
        if batch is not None:
            manifest["batches"]["append"] = manifest["batches"].get("append", []) + [batch]
        return self.publish(manifest)

    def upsert(self, table: str, new: DataFrame, keys: list[str], batch: int | None = None, buckets: int = 64, merge: Callable = upsert_nodes) -> int | None:
        """Merges new rows into a table dealt by its keys over `buckets` (as first given). Only buckets that new
        rows fall into are read and written; the others keep their files. Batches are numbered upwards: one that
        is not above the last is taken as done."""
        return self.upserts({table: (new, keys)}, batch, buckets, merge)

    def upserts(self, changes: dict[str, tuple[DataFrame, list[str]]], batch: int | None = None, buckets: int = 64, merge: Callable = upsert_nodes) -> int | None:
        """Upserts of several tables (rows, keys) that become visible together."""
        manifest = self.manifest()
        first = next(iter(changes))
        done = manifest["batches"].get(first)
        if batch is not None and done is not None and batch <= done:
            return None
        for table, (new, keys) in changes.items():
            known = manifest["tables"].setdefault(table, {"schema": _ddl(new), "parts": {}, "keys": keys, "buckets": buckets})
            bucket = F.pmod(F.xxhash64(*known["keys"]), F.lit(known["buckets"])).cast("int")
            touched = [r[0] for r in new.select(bucket.alias("b")).distinct().collect()]
            if touched:
                merged = merge(self.read(table, manifest, touched), new, known["keys"])
                known["parts"] |= self.stage(merged.withColumn("_bucket", bucket).repartition("_bucket"), bucketed=True)
                known["schema"] = _ddl(merged)
        if batch is not None:
            manifest["batches"][first] = batch
        return self.publish(manifest)


def _ddl(df: DataFrame) -> str:
    return ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)

"""Sharding by size-tiered compaction, with Spark's own readers and writers.

Arrivals are written once as small immutable shards. A manifest lists the shards of a version; a version is a file that is
renamed into place, which fails where that version exists, so of two writers one starts anew and readers never see half a
change. Compaction takes the shards of a size tier (sizes within a factor of ``fan``) once there are ``fan`` of them and
rewrites them as files of about ``target`` bytes: their scan is planned in partitions of that size, one written file each,
without a shuffle. Replaced shards stay for readers of older versions until ``vacuum``.

The commit needs a file system whose rename is atomic and fails where the target exists, as HDFS and local ones do; plain
object stores don't. What the driver handles is a line a shard, never rows. A job that fails leaves files that no manifest
lists. One writer publishes one arrival after another.

Defined results: rows come back as they were, repeated ones too, in no order; NULL arrivals are arrival 0; no rows make a
version without shards.
"""

from __future__ import annotations

import json
import math
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import new_dir, table

TARGET, SMALLEST, FAN = 128 << 20, 1 << 20, 4


class Conflict(Exception):
    """Another writer has made the version."""


class ShardStore:
    def __init__(self, spark: SparkSession, root: str, target: int = TARGET, smallest: int = SMALLEST, fan: int = FAN):
        self.spark, self.root, self.target, self.smallest, self.fan = spark, root, target, smallest, fan
        self.jvm = spark._jvm
        self.hadoop = self.jvm.org.apache.hadoop.fs
        self.conf = spark._jsc.hadoopConfiguration()
        self.fs = self.hadoop.Path(root).getFileSystem(self.conf)
        self.planner = spark.newSession()
        for key, value in (("maxPartitionBytes", target), ("openCostInBytes", 0), ("minPartitionNum", 1)):
            self.planner.conf.set(f"spark.sql.files.{key}", str(value))

    # --- manifests ---------------------------------------------------------------------------------------------------

    def _path(self, version: int):
        return self.hadoop.Path(f"{self.root}/manifests/v{version:010d}.json")

    def versions(self) -> list[int]:
        folder = self.hadoop.Path(f"{self.root}/manifests")
        if not self.fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in self.fs.listStatus(folder)]
        return sorted(int(n[1:-5]) for n in names if n.startswith("v") and n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        known = self.versions()
        if not known and version is None:
            return {"version": 0, "schema": None, "shards": []}
        stream = self.fs.open(self._path(known[-1] if version is None else version))
        try:
            return json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, base: dict, shards: list[dict], schema: str) -> dict:
        """Publishes the version after ``base``; raises Conflict if there is one already."""
        new = {"version": base["version"] + 1, "schema": schema, "shards": sorted(shards, key=lambda s: s["path"])}
        part = self.hadoop.Path(f"{self.root}/manifests/.{uuid.uuid4().hex}.tmp")
        stream = self.fs.create(part, True)
        try:
            stream.write(bytearray(json.dumps(new, sort_keys=True).encode()))
        finally:
            stream.close()
        context = self.hadoop.FileContext.getFileContext(part.toUri(), self.conf)
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        try:
            context.rename(part, self._path(new["version"]), self.spark.sparkContext._gateway.new_array(rename, 0))
        except Exception as e:
            self.fs.delete(part, False)
            if self.fs.exists(self._path(new["version"])):
                raise Conflict(new["version"]) from e
            raise
        return new

    def _listed(self, folder: str) -> list[dict]:
        found, files = [], self.fs.listFiles(self.hadoop.Path(folder), True)
        while files.hasNext():
            f = files.next()
            if f.getPath().getName().endswith(".parquet"):
                found.append({"path": f.getPath().toString(), "bytes": f.getLen()})
        return found

    # --- arrivals ------------------------------------------------------------------------------------------------------

    def stage(self, df: DataFrame, arrival: Column) -> tuple[str, dict[int, list[dict]]]:
        """Writes small shards in one pass; the schema and the shards of each arrival. Nothing is published yet."""
        folder = f"{self.root}/data/{uuid.uuid4().hex}"
        mark = "__arrival"
        while mark in df.columns:
            mark += "_"
        marked = df.withColumn(mark, F.coalesce(arrival.cast("long"), F.lit(0)))
        marked.write.partitionBy(mark).option("compression", "zstd").parquet(folder)
        out: dict[int, list[dict]] = {}
        for shard in self._listed(folder):
            out.setdefault(int(shard["path"].rsplit(f"{mark}=", 1)[1].split("/")[0]), []).append(shard)
        return df.schema.json(), out

    def append(self, shards: list[dict], schema: str, tries: int = 8) -> dict:
        for _ in range(tries):
            base = self.manifest()
            if base["schema"] not in (None, schema):
                raise ValueError("the arrival's columns differ from the store's")
            try:
                return self.commit(base, base["shards"] + shards, schema)
            except Conflict:
                continue
        raise Conflict(f"no version after {tries} tries")

    # --- compaction ----------------------------------------------------------------------------------------------------

    def tier(self, size: int) -> int:
        return max(0, math.floor(math.log(max(size, 1) / self.smallest, self.fan)) + 1) if size >= self.smallest else 0

    def runs(self, shards: list[dict]) -> list[list[dict]]:
        """Tiers to merge: those with ``fan`` shards at least, of shards below half the target."""
        tiers: dict[int, list[dict]] = {}
        for s in shards:
            if s["bytes"] < self.target // 2:
                tiers.setdefault(self.tier(s["bytes"]), []).append(s)
        return [t for _, t in sorted(tiers.items()) if len(t) >= self.fan]

    def compact(self) -> dict:
        """Merges until no tier is full; a version for each merge. A conflict leaves the others' version as it is."""
        base = self.manifest()
        while runs := self.runs(base["shards"]):
            run = runs[0]
            folder = f"{self.root}/data/{uuid.uuid4().hex}"
            self._scan(self.planner, base["schema"], run).write.option("compression", "zstd").parquet(folder)
            merged = self._listed(folder)
            gone = {s["path"] for s in run}
            try:
                base = self.commit(base, [s for s in base["shards"] if s["path"] not in gone] + merged, base["schema"])
            except Conflict:
                return self.manifest()
            if len(merged) >= len(run):  # the reader's own limits keep the files small
                break
        return base

    def vacuum(self) -> int:
        """Deletes the files that the latest version doesn't list; not while another writer has staged some."""
        listed = {s["path"] for s in self.manifest()["shards"]}
        old = [s for s in self._listed(f"{self.root}/data") if s["path"] not in listed]
        for s in old:
            self.fs.delete(self.hadoop.Path(s["path"]), False)
        return len(old)

    # --- reading -------------------------------------------------------------------------------------------------------

    def _scan(self, spark: SparkSession, schema: str, shards: list[dict]) -> DataFrame:
        from pyspark.sql.types import StructType

        kind = StructType.fromJson(json.loads(schema))
        if not shards:
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).parquet(*[s["path"] for s in shards])

    def read(self, version: int | None = None) -> DataFrame:
        m = self.manifest(version)
        if m["schema"] is None:
            raise ValueError("the store has no version yet")
        return self._scan(self.spark, m["schema"], m["shards"])


ARRIVALS = 4


def shard(df: DataFrame, root: str, arrival: Column, **sizes) -> ShardStore:
    """Stages ``df``, then publishes and compacts arrival after arrival."""
    kept = ShardStore(df.sparkSession, root, **sizes)
    schema, arrivals = kept.stage(df, arrival)
    for k in sorted(arrivals):
        kept.append(arrivals[k], schema)
        kept.compact()
    if not arrivals:
        kept.append([], schema)
    return kept


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, arrival and the md5 of the text, as the last version's files have them."""
    docs = table(spark, sf_dir, "documents")
    arrival = F.pmod(F.coalesce("doc_id", F.lit(0)), F.lit(ARRIVALS)).cast("long")
    kept = shard(docs.withColumn("arrival", arrival), new_dir(spark, "shards"), arrival)
    return kept.read().select("doc_id", "arrival", F.md5(F.col("text").cast("binary")).alias("text_md5"))


OP9_SQL = "SELECT doc_id, CAST(coalesce(doc_id, 0) % 4 AS BIGINT) AS arrival, md5(text) AS text_md5 FROM documents"

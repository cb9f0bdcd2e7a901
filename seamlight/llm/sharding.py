"""Sharding (operator 4): immutable Parquet shards, size-tiered compaction and versioned manifests; DataFrame functions only."""

from __future__ import annotations

import time
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions
from .shared import drop_path, file_system

MANIFEST = "run string, shards long, bytes long, n_rows long"
#: Shards of a merge at least; a tier holds runs whose mean shard sizes are within a factor of this.
FAN_IN = 4
#: Runs of one merge, at most; the rest of the tier wait for the next round.
ROUND_RUNS = 1000


class ShardStore:
    """A table below one path: runs of shards in data/, and versions whose manifest lists the live runs.

    A run is a folder of Parquet shards that one arrival or merge wrote; it is never changed. A manifest has one row a
    run, so the driver handles as many rows as there are arrivals not yet merged, however many shards they hold. A commit
    is one atomic step (`Versions`): readers see one version or the next, of two writers of a version one gets `Conflict`,
    and a lost writer leaves nothing behind but folders that no manifest names.

    Rows come back as they went in: nulls, repeated rows, empty texts and any columns of the schema, whatever their names.
    An empty arrival makes a version without a new run; an empty store reads as an empty table of the schema asked for.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    def version(self) -> int:
        return self.versions.latest()

    def manifest(self, version: int | None = None) -> DataFrame:
        """run, shards, bytes, n_rows of the live runs."""
        v = self.version() if version is None else version
        return self.spark.read.schema(MANIFEST).parquet(self.versions.folder(v)) if v else self.spark.createDataFrame([], MANIFEST)

    def shards(self, schema, version: int | None = None) -> DataFrame:
        """shard, bytes, n_rows of the live shards, from the files' own footers."""
        meta = self.read(schema, version).select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes"))
        return meta.groupBy("shard", "bytes").agg(F.count("*").alias("n_rows"))

    def _commit(self, rows: DataFrame, after: int) -> int:
        folder = self.versions.new_folder("manifest")
        rows.coalesce(1).write.parquet(folder)
        return self.versions.publish(folder, after + 1)

    def _write(self, df: DataFrame) -> DataFrame:
        """Writes a run and sums it up in one row; none for an empty one."""
        name = uuid.uuid4().hex
        at = f"{self.path}/data/{name}"
        df.write.option("compression", "zstd").parquet(at)
        meta = self.spark.read.schema(df.schema).parquet(at).select(F.col("_metadata.file_path").alias("shard"), F.col("_metadata.file_size").alias("bytes"))
        each = meta.groupBy("shard", "bytes").agg(F.count("*").alias("n_rows"))
        whole = each.agg(F.count("*").alias("shards"), F.sum("bytes").alias("bytes"), F.sum("n_rows").alias("n_rows")).filter("shards > 0")
        row = whole.first()  # one row a run
        return self.spark.createDataFrame([(name, *row)] if row else [], MANIFEST)

    def append(self, df: DataFrame) -> int:
        """An arrival: a run of one shard per task that has rows, and a new version."""
        v = self.version()
        return self._commit(self.manifest(v).unionByName(self._write(df)), v)

    def compact(self, schema, target: int, fan_in: int = FAN_IN) -> int:
        """Merges runs of similarly sized shards until no tier has `fan_in` shards; returns the version.

        A tier is the power of `fan_in` of a run's mean shard size; runs whose mean is half the target or more are left
        alone. A merge reads its tier's runs side by side in tasks of up to the target size, and each task writes one
        shard: no shuffle, so a source that holds a third of the rows makes no task larger. A tier that a merge leaves
        with as many shards as before is passed over for the rest of this call, and the other tiers go on.
        """
        stuck: set[int] = set()
        while True:
            v = self.version()
            mean = F.greatest(F.col("bytes") / F.col("shards"), F.lit(1.0))
            tiers = self.manifest(v).filter(mean < target // 2).withColumn("tier", F.floor(F.log(float(fan_in), mean)).cast("int"))
            due = tiers.filter(~F.col("tier").isin(list(stuck))) if stuck else tiers
            due = due.groupBy("tier").agg(F.sum("shards").alias("n")).filter(F.col("n") >= fan_in).agg(F.min("tier")).first()[0]
            if due is None:
                return v
            run = tiers.filter(F.col("tier") == due).orderBy("run").limit(ROUND_RUNS).collect()
            with _settings(self.spark, {"spark.sql.files.maxPartitionBytes": str(target), "spark.sql.files.openCostInBytes": "0", "spark.sql.files.minPartitionNum": "1"}):
                merged = self._write(self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{r['run']}" for r in run)))
            gone = self.spark.createDataFrame([(r["run"],) for r in run], "run string")
            made = merged.first()
            if made is not None and made["shards"] >= sum(r["shards"] for r in run):
                stuck.add(due)
            else:
                self._commit(self.manifest(v).join(F.broadcast(gone), "run", "left_anti").unionByName(merged), v)  # at most ROUND_RUNS names

    def read(self, schema, version: int | None = None) -> DataFrame:
        """All rows of a version. The driver lists the runs' folders, as for any table; rows are read by tasks."""
        runs = [r[0] for r in self.manifest(version).select("run").collect()]
        return self.spark.read.schema(schema).parquet(*(f"{self.path}/data/{r}" for r in runs)) if runs else self.spark.createDataFrame([], schema)

    def vacuum(self, keep_hours: float = 24.0) -> None:
        """Deletes runs that an older manifest names and the newest does not, once no reader is on an older version.

        Folders that no manifest names may be a writer's that is still at work; they go when older than `keep_hours`.
        """
        live = {r[0] for r in self.manifest().select("run").collect()}
        older = [self.versions.folder(v) for v in self.versions.numbers()]
        once = {r[0] for r in self.spark.read.schema(MANIFEST).parquet(*older).select("run").distinct().collect()} if older else set()
        fs, to_path = file_system(self.spark, self.path)
        at = to_path(f"{self.path}/data")
        for s in fs.listStatus(at) if fs.exists(at) else []:
            name = s.getPath().getName()
            if name not in live and (name in once or time.time() * 1000 - s.getModificationTime() > keep_hours * 3_600_000):
                drop_path(self.spark, s.getPath().toString())


class _settings:
    """Session settings for the time of a with block."""

    def __init__(self, spark: SparkSession, values: dict[str, str]):
        self.spark, self.values = spark, values

    def __enter__(self):
        self.before = {k: self.spark.conf.get(k, None) for k in self.values}
        for k, v in self.values.items():
            self.spark.conf.set(k, v)

    def __exit__(self, *_):
        for k, v in self.before.items():
            self.spark.conf.set(k, v) if v is not None else self.spark.conf.unset(k)

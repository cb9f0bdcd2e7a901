"""What every operator asks of a session before it runs Python on the executors."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch, about: it ends with the row that passes them.
BATCH_BYTES = 32 << 20
#: The folder that holds this package.
HOME = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))


def importable(spark: SparkSession) -> None:
    """Lets Python workers import this package from the driver's own copy, where they see that folder.

    Workers of a cluster that do not see it get the package by --py-files; the entry is harmless there.
    """
    env = spark.sparkContext.environment
    known = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if HOME not in known:
        env["PYTHONPATH"] = os.pathsep.join([*known, HOME])


def arrow_rows(spark: SparkSession, most: int) -> None:
    """Arrow batches of at most `most` rows and some BATCH_BYTES from now on; larger settings are lowered, smaller kept."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    now = int(spark.conf.get(key, "10000"))
    if now <= 0 or now > most:
        spark.conf.set(key, str(most))
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    try:
        now = int(spark.conf.get(key))
    except Exception:  # a version of Spark without this setting
        return
    if now <= 0 or now > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share (spark.checkpoint.dir).

    Where it is unset and the master is local, as in tests, a temporary folder of this machine; elsewhere that is an error,
    as executors would write where no one else reads.
    """
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="seamlight-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


_OWN: dict[tuple[str, str], str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in this application's part of the shared folder, which goes when the driver's JVM ends."""
    key = (shared_dir(spark), spark.sparkContext.applicationId)
    if key not in _OWN:
        _OWN[key] = f"{key[0]}/seamlight-{uuid.uuid4().hex}"
        fs, to_path = file_system(spark, _OWN[key])
        fs.mkdirs(to_path(_OWN[key]))
        fs.deleteOnExit(to_path(_OWN[key]))
    return f"{_OWN[key]}/{name}-{uuid.uuid4().hex}"


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Cuts the lineage by a Parquet table in the shared folder, which outlives any executor."""
    path = scratch(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch_path = path
    return out


def discard(*tables: DataFrame | None) -> None:
    """Deletes tables that `materialise` wrote and that no later plan reads."""
    for df in tables:
        if (path := getattr(df, "_scratch_path", None)) is not None:
            drop_path(df.sparkSession, path)


def file_system(spark: SparkSession, path: str):
    """(Hadoop file system, Path constructor) of a path."""
    to_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    return to_path(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), to_path


def drop_path(spark: SparkSession, path: str) -> None:
    fs, to_path = file_system(spark, path)
    fs.delete(to_path(path), True)

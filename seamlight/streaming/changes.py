"""Streams of changes: last writer wins, tumbling and session windows, each with the results of its batch counterpart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import scratch

STORE = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def file_stream(spark: SparkSession, path: str, files_per_batch: int = 64) -> DataFrame:
    """A stream of a Parquet file or folder, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rstrip("/").rpartition("/")
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch)
    # a stream reads folders: a single file is picked out of its folder by name
    return reader.option("pathGlobFilter", name).parquet(folder) if spark.read.format("binaryFile").load(path).select("path").first()[0].endswith(f"/{name}") else reader.parquet(path)


def run_to_end(stream: DataFrame, mode: str, name: str) -> DataFrame:
    """Runs a streaming query over all that is there; returns batch, and the rows that each micro-batch gave out.

    Every batch is written under its number, so a batch that is run again after a loss replaces itself. State and
    checkpoint are in the shared folder.
    """
    spark = stream.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", STORE)
    out = scratch(spark, name)

    def keep(df: DataFrame, batch: int) -> None:
        df.withColumn("batch", F.lit(batch).cast("long")).write.mode("overwrite").parquet(f"{out}/rows/part={batch}")

    query = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{out}/checkpoint").trigger(availableNow=True).foreachBatch(keep).start()
    query.awaitTermination()
    return spark.read.parquet(f"{out}/rows").drop("part")


def latest_per_key(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Of an update-mode query's rows, the last given out for each key."""
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("v"))
    return last.select(*keys, *(F.col(f"v.{c}").alias(c) for c in rest))


def stream_lww(changes: DataFrame) -> DataFrame:
    """record_id and its winning change (clock, device, value, is_deleted): state is one row per record."""
    won = changes.groupBy("record_id").agg(F.max_by(F.struct("clock", "device", "value", "is_deleted"), F.struct("clock", "device")).alias("v"))
    rows = run_to_end(won.select("record_id", "v.*"), "update", "stream-lww")
    return latest_per_key(rows, ["record_id"])


def stream_tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None, slide: str | None = None) -> DataFrame:
    """window_start, event_type, n, total of each window, in whatever order files come; state is one row per result row.

    With `slide`, a window begins every so often, and an event counts in each window that it falls in.

    With `late`, windows leave the state once the watermark has passed, and rows that come later than that are lost.
    """
    counted = (events.withWatermark("ts", late) if late else events).groupBy(F.window("ts", width, slide), "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    rows = run_to_end(counted.select(F.col("window.start").alias("window_start"), "event_type", "n", "total"), "update", "stream-tumbling")
    return latest_per_key(rows, ["window_start", "event_type"])


def stream_sessions(events: DataFrame, gap: str = "30 minutes") -> DataFrame:
    """user_id, session_start, session_end, n: runs of a user's events with less than `gap` between them."""
    counted = events.groupBy(F.session_window("ts", gap), "user_id").agg(F.count("*").alias("n"))
    rows = run_to_end(counted.select("user_id", F.col("session_window.start").alias("session_start"), F.col("session_window.end").alias("session_end"), "n"), "complete", "stream-sessions")
    last = rows.agg(F.max("batch").alias("batch"))
    return rows.join(F.broadcast(last), "batch", "left_semi").drop("batch")  # one row

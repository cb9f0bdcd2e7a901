"""Convergent merging of replicas: last writer wins by (clock, writer), tombstones, Lamport clocks, JSON deltas."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import materialise

RECORD = "struct<id:bigint,type_name:string,props:string,sync_clock:bigint,writer:string,is_deleted:boolean>"
EDGE = "struct<relation:string,from_id:bigint,to_id:bigint>"
CHUNK = "struct<chunk_id:bigint,text:string,embedding:array<float>,doc_id:bigint,page_number:bigint,sync_clock:bigint>"
TOMBSTONE = "struct<chunk_id:bigint,clock:bigint>"
#: One line of a delta: its kind and the row of that kind.
DELTA = f"kind string, device string, record {RECORD}, edge {EDGE}, chunk {CHUNK}, tombstone {TOMBSTONE}"


def device_hash(device: str) -> int:
    """16 bits of a device's name, never 0: FNV-1a folded four ways. Its chunk ids begin at this times 2**48."""
    h = 1469598103934665603
    for c in device.encode():
        h = (h ^ c) * 1099511628211 % 2**64
    return (h ^ h >> 16 ^ h >> 32 ^ h >> 48) & 0xFFFF or 1


def id_base(device: str) -> int:
    """The first chunk id of a device, as the signed 64 bits that a BIGINT holds."""
    base = device_hash(device) << 48
    return base - 2**64 if base >= 2**63 else base


def tick(clock: int) -> int:
    return clock + 1


def observe(clock: int, other: int) -> int:
    return max(clock, other)


def export_since(since: int, device: str, records: DataFrame, edges: DataFrame, chunks: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Rows of DELTA: records, chunks and tombstones of a later clock, and all edges."""
    parts = {"record": (records.filter(F.col("sync_clock") > since), RECORD), "edge": (edges, EDGE), "chunk": (chunks.filter(F.col("sync_clock") > since), CHUNK), "tombstone": (tombstones.filter(F.col("clock") > since), TOMBSTONE)}
    out = None
    for kind, (df, schema) in parts.items():
        own = F.struct(*(F.col(f.split(":")[0]) for f in _fields(schema))).cast(schema)
        row = df.select(F.lit(kind).alias("kind"), F.lit(device).alias("device"), *((own if k == kind else F.lit(None).cast(s)).alias(k) for k, (_, s) in parts.items()))
        out = row if out is None else out.unionByName(row)
    return out


def _fields(schema: str) -> list[str]:
    return [f for f in schema[7:-1].split(",")]


def write_delta(delta: DataFrame, path: str) -> None:
    delta.select(F.to_json(F.struct(*delta.columns)).alias("value")).write.mode("overwrite").text(path)


def read_delta(spark: SparkSession, path: str) -> DataFrame:
    """Rows of DELTA from JSON lines; one broken line makes the whole delta empty. Missing clocks count as 0.

    The lines are parsed once, into a table of the shared folder that all later plans read.
    """
    lines = spark.read.text(path)
    parsed = lines.select(F.from_json("value", DELTA + ", _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("r")).select("r.*")
    rows = materialise(parsed, "read")
    n_bad = rows.agg(F.count("_bad")).first()[0]
    return rows.drop("_bad").filter(F.lit(n_bad == 0))


def differing(one: DataFrame, other: DataFrame) -> DataFrame:
    """The rows that one table has more often than the other, as often as it has them more: one shuffle for both ways."""
    columns = one.columns
    both = one.withColumn("_n", F.lit(1)).unionByName(other.withColumn("_n", F.lit(-1)))
    more = both.groupBy(*columns).agg(F.abs(F.sum("_n")).alias("_n")).filter("_n > 0")
    return more.withColumn("_n", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("_n")))).select(*columns)


def merge_records(local: DataFrame, remote: DataFrame) -> DataFrame:
    """The newer version of each id, by (sync_clock, writer): a total order, so merges commute, associate and repeat."""
    both = local.unionByName(remote)
    rest = [c for c in both.columns if c != "id"]
    clock = F.struct(F.coalesce("sync_clock", F.lit(0)), F.coalesce("writer", F.lit("")), "is_deleted", "props")
    won = both.groupBy("id").agg(F.max_by(F.struct(*rest), clock).alias("v"))
    return won.select("id", *(F.col(f"v.{c}").alias(c) for c in rest))


def merge_chunks(local: DataFrame, remote: DataFrame, tombstones: DataFrame) -> DataFrame:
    """Local chunks, and remote ones of unknown ids that no tombstone of their clock or a later one holds back.

    Of several remote rows of an id the greatest by clock, then by all other columns, comes in: replicas agree on it.
    """
    rest = ["sync_clock", *(c for c in remote.columns if c not in ("chunk_id", "sync_clock"))]
    one = remote.groupBy("chunk_id").agg(F.max(F.struct(*rest)).alias("v")).select("chunk_id", "v.*")
    fresh = one.join(local.select("chunk_id"), "chunk_id", "left_anti")
    dead = tombstones.groupBy("chunk_id").agg(F.max("clock").alias("dead_at"))
    fresh = fresh.join(dead, "chunk_id", "left").filter("dead_at is null or dead_at < sync_clock").drop("dead_at")
    return local.unionByName(fresh.select(*local.columns))


def apply_deletes(chunks: DataFrame, tombstones: DataFrame, deletes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(chunks, tombstones): deleted chunks go whatever their clock, and every delete is remembered."""
    kept = chunks.join(deletes.select("chunk_id"), "chunk_id", "left_anti")
    return kept, tombstones.unionByName(deletes.select("chunk_id", "clock")).groupBy("chunk_id").agg(F.max("clock").alias("clock"))


def merge_counts(local: DataFrame, remote: DataFrame) -> DataFrame:
    """One row: records inserted, replaced (newer), won on an equal clock, and skipped as older."""
    old = local.select("id", F.col("sync_clock").alias("_clock"), F.col("writer").alias("_writer"))
    met = remote.join(old, "id", "left")
    return met.agg(
        F.count_if(F.col("_clock").isNull()).alias("inserted"),
        F.count_if(F.col("sync_clock") > F.col("_clock")).alias("newer"),
        F.count_if((F.col("sync_clock") == F.col("_clock")) & (F.col("writer") > F.col("_writer"))).alias("ties_won"),
        F.count_if((F.col("sync_clock") < F.col("_clock")) | (F.col("sync_clock") == F.col("_clock")) & (F.col("writer") <= F.col("_writer"))).alias("skipped"),
    )


def current_clock(*columns: tuple[DataFrame, str]) -> DataFrame:
    """One row: the greatest clock of the given (table, column) pairs, 0 if there is none."""
    out = None
    for df, name in columns:
        own = df.select(F.col(name).alias("clock"))
        out = own if out is None else out.unionByName(own)
    return out.agg(F.coalesce(F.max("clock"), F.lit(0)).alias("clock"))

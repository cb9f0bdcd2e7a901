"""Helpers that the training-data operators share: scratch tables, table reads, stable words."""

from __future__ import annotations

import os

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.session import arrow_rows, discard, drop_path, file_system, importable, materialise, scratch, shared_dir

__all__ = ["discard", "drop_path", "file_system", "materialise", "scratch", "shared_dir"]

#: What separates words: space and the five ASCII controls 0x09-0x0D (as a Java character class).
BLANKS = r"[\x20\x09-\x0D]+"
#: Rows in an Arrow batch, so that a batch of very long texts stays within a worker's memory.
BATCH_ROWS = 512
#: A side of a join is broadcast up to so many rows of a few dozen bytes.
BROADCAST_ROWS = 100_000
#: A key of more rows is a hub, whose side of a join is broadcast or repeated.
HUB_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """For what runs in Python: Arrow batches of at most BATCH_ROWS rows, and workers that can import this package."""
    importable(spark)
    arrow_rows(spark, BATCH_ROWS)


def plain_strings(column: pa.Array) -> pa.Array:
    """One kind of string array, whichever Spark sends."""
    return column.cast(pa.string()) if column.type != pa.string() else column


def held_out(doc_id: str, mod: int, rest: int):
    """Whether crc32(doc_id as text) mod `mod` is `rest`; a null id is held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % mod == rest, F.lit(True))


def tokenizer_path(name: str) -> str:
    """Of a public vocabulary file on the machine that calls it; SEAMLIGHT_TOKENIZERS names another folder."""
    if folder := os.environ.get("SEAMLIGHT_TOKENIZERS"):
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def unused(columns: list[str], name: str) -> str:
    """A column name that none of the columns has, in whatever case."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name += "_"
    return name


def hubs_of(counts: DataFrame, key: str, size: str) -> DataFrame | None:
    """(key, size) of the keys that more than `limit` rows have, written; None where there are none.

    `counts` says how many rows each key has. As hubs have more than `limit` rows each, there are fewer of them than all
    rows over `limit`, which is BROADCAST_ROWS at most: they may be broadcast however large the table is.
    """
    total, most = counts.agg(F.sum(size), F.max(size)).first()
    limit = max(HUB_ROWS, -(-(total or 0) // BROADCAST_ROWS))
    return materialise(counts.filter(F.col(size) > limit).select(key, size), "hubs") if (most or 0) > limit else None


def lookup(rows: DataFrame, values: DataFrame, key: str, hubs: DataFrame | None) -> DataFrame:
    """Inner join with a table of one row a key. Values of hub keys, which are few and must be small, are broadcast.

    The others are dealt by key, so no task gets many rows of one key. Both tables are read twice where there are hubs.
    """
    if hubs is None:
        return rows.join(values.hint("merge"), key)
    names = F.broadcast(hubs.select(key))
    few = values.join(names, key, "left_semi")
    rest = rows.join(names, key, "left_anti").join(values.join(names, key, "left_anti").hint("merge"), key)
    return rows.join(F.broadcast(few), key).unionByName(rest)


def salted_join(rows: DataFrame, values: DataFrame, key: str, deal_by: list[str], hubs: DataFrame | None, size: str) -> DataFrame:
    """Inner join with a table of one row a key, whose rows may be large: a hub's row is repeated, once for so many rows
    of its key, and these are dealt over the copies by `deal_by`."""
    if hubs is None:
        return rows.join(values.hint("merge"), key)
    copies = F.broadcast(hubs.select(key, F.ceil(F.col(size) / HUB_ROWS).cast("int").alias("_copies")))
    n = F.coalesce(F.col("_copies"), F.lit(1))
    dealt = rows.join(copies, key, "left").withColumn("_salt", F.pmod(F.xxhash64(*deal_by), n).cast("int")).drop("_copies")
    each = values.join(copies, key, "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), n - 1))).drop("_copies")
    return dealt.join(each.hint("merge"), [key, "_salt"]).drop("_salt")

"""The base tables on disk: versioned Parquet below one path, opened whole or not at all."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vector as V
from .versions import Versions

SCHEMAS = {
    "chunks": "chunk_id long, text string, embedding array<float>, doc_id long, page_number long, sync_clock long",
    "objects": "id long, type_name string, props string, sync_clock long, writer string, is_deleted boolean",
    "edges": "relation string, from_id long, to_id long",
    "tombstones": "chunk_id long, clock long",
}


class Store:
    """The base tables of one database. `save` commits a new version in one step; readers see whole versions.

    Of two writers that opened the same version, one saves and the other gets `Conflict` and opens the store again.
    """

    def __init__(self, spark: SparkSession, path: str, tables: dict[str, DataFrame] | None = None, version: int = 0):
        self.spark, self.path, self.version = spark, path.rstrip("/"), version
        self.tables = {k: (tables or {}).get(k, spark.createDataFrame([], s)) for k, s in SCHEMAS.items()}

    @classmethod
    def open(cls, spark: SparkSession, path: str, version: int | None = None) -> Store:
        """The newest version, or the given one; an empty database where there is none. A damaged table raises when it is read."""
        known = Versions(spark, path)
        v = known.latest() if version is None else version
        if not v:
            return cls(spark, path)
        folder = known.folder(v)
        return cls(spark, path, {k: spark.read.schema(s).parquet(f"{folder}/{k}") for k, s in SCHEMAS.items()}, v)

    @staticmethod
    def versions(spark: SparkSession, path: str) -> list[int]:
        return Versions(spark, path).numbers()

    def save(self) -> int:
        """Commits the version after the one that was opened."""
        known = Versions(self.spark, self.path)
        folder = known.new_folder("tables")
        for name, df in self.tables.items():
            df.select(*(F.col(f.name).cast(f.dataType) for f in self.spark.createDataFrame([], SCHEMAS[name]).schema)).write.parquet(f"{folder}/{name}")
        self.version = known.publish(folder, self.version + 1)
        return self.version

    def chunk(self, chunk_id: int) -> DataFrame:
        """The chunk of an id: one row, or none. The filter reaches the Parquet scan."""
        return self.tables["chunks"].filter(F.col("chunk_id") == chunk_id)

    def __enter__(self) -> Store:
        return self

    def __exit__(self, kind, *_) -> None:
        if kind is None:
            self.save()

    def stats(self) -> DataFrame:
        """table_name, n: rows of each table."""
        out = None
        for name, df in self.tables.items():
            row = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("table_name"), "n")
            out = row if out is None else out.unionByName(row)
        return out


def norm_report(vectors: DataFrame, tolerance: float = 0.01, vector_column: str = "embedding") -> DataFrame:
    """One row: vectors, and those whose norm is further from 1 than the tolerance."""
    off = F.abs(V.norm(F.col(vector_column)) - 1) > tolerance
    return vectors.agg(F.count("*").alias("n_vectors"), F.count_if(off).alias("n_off"))


def read_vocabulary(spark: SparkSession, path: str) -> dict[str, int]:
    """Token ids by line number; a vocabulary is small and goes to the driver."""
    from ..functions.embed import load_vocabulary

    text = spark.read.text(path, wholetext=True).first()
    return load_vocabulary(text[0].split("\n")) if text else {}

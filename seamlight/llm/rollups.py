"""Delta-maintained token counts (operator 10): signed changes, additive totals, idempotent batch commits."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.versions import Versions
from .bytepair import ranked
from .shared import file_system, hubs_of, lookup, materialise, plain_strings, small_batches

KEYS = ["source", "lang", "tokenizer_version"]
TOTALS = ["n_docs", "n_tokens", "n_bytes"]
SCHEMA = "source string, lang string, tokenizer_version string, n_docs long, n_tokens long, n_bytes long"


def count_tokens(docs: DataFrame, tokenizer: str, version: str) -> DataFrame:
    """One insert (sign 1) per document: doc_id, source, lang, tokenizer_version, n_tokens, n_bytes, text_hash.

    A null text counts as empty: no tokens, no bytes. Repeated rows count as often as they come; null ids, sources and
    languages stay null. text_hash tells equal texts (null only for a null text). Other columns are left out, so none can
    clash; an empty table gives an empty table.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder = ranked(tokenizer)
        for batch in batches:
            sizes = [np.zeros(0, np.int64)] + [np.diff(bounds) for _, _, _, bounds in encoder.batches(plain_strings(batch.column(5)))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(np.concatenate(sizes).astype("i8"))], names=["doc_id", "source", "lang", "text_hash", "n_bytes", "n_tokens"])

    rows = docs.select("doc_id", "source", "lang", F.md5("text").alias("text_hash"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "text")
    kind = docs.schema["doc_id"].dataType.simpleString()
    counted = rows.mapInArrow(run, f"doc_id {kind}, source string, lang string, text_hash string, n_bytes long, n_tokens long")
    return counted.withColumn("tokenizer_version", F.lit(version)).withColumn("sign", F.lit(1))


def retract(counts: DataFrame) -> DataFrame:
    """The same counts as deletes."""
    return counts.withColumn("sign", -F.col("sign"))


def revise(old: DataFrame, new: DataFrame) -> DataFrame:
    """Deletes of the old counts and inserts of the new ones; counts that stay cancel out."""
    return retract(old).unionByName(new, allowMissingColumns=True)


def totals_of(changes: DataFrame) -> DataFrame:
    """Signed sums by key. Partial sums come before the shuffle, so a hot source sends one row per task and key."""
    whole = lambda x: F.coalesce(F.sum(x), F.lit(0)).cast("long")
    sums = [whole(F.col("sign").cast("long")).alias("n_docs"), *(whole(F.col("sign") * F.col(c)).alias(c) for c in TOTALS[1:])]
    return changes.groupBy(*KEYS).agg(*sums)


class Rollup:
    """Totals by source, language and tokenizer version below one path.

    A version's folder holds the totals. A batch leaves a note of the version that it is about to become before that
    version is committed in one atomic step (`Versions`); it is in if that version is the folder it wrote. So a batch that
    is sent again after a lost driver or executor changes nothing, looking it up reads its own notes only, however many
    batches there were, and of two writers of a version one gets `Conflict` and sends its batch again. Readers see whole
    versions.

    Null sources, languages and versions are keys like others; a null count or sign counts as 0; other columns of the
    changes are left out, and an empty batch is remembered and changes nothing.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.versions = spark, path.rstrip("/"), Versions(spark, path)

    def version(self) -> int:
        return self.versions.latest()

    def totals(self) -> DataFrame:
        v = self.version()
        return self.spark.read.schema(SCHEMA).parquet(self.versions.folder(v)) if v else self.spark.createDataFrame([], SCHEMA)

    def _notes(self, batch: str) -> str:
        return f"{self.path}/batches/{hashlib.sha256(batch.encode()).hexdigest()}"

    def has(self, batch: str) -> bool:
        """Whether a batch is in: one of its notes, named version-folder, is what that version became."""
        fs, to_path = file_system(self.spark, self.path)
        at = to_path(self._notes(batch))
        for note in fs.listStatus(at) if fs.exists(at) else []:
            v, _, folder = note.getPath().getName().partition("-")
            if (self.versions.folder(int(v)) or "").endswith(f"/{folder}"):
                return True
        return False

    def commit(self, batch: str, changes: DataFrame) -> bool:
        """Adds a batch of signed changes; False if its id is in already. Keys whose documents are all gone leave the totals."""
        v = self.version()
        if self.has(batch):
            return False
        sums = totals_of(changes).select(*KEYS, *TOTALS)
        merged = self.totals().unionByName(sums).groupBy(*KEYS).agg(*(F.sum(c).alias(c) for c in TOTALS)).filter(" or ".join(f"{c} <> 0" for c in TOTALS))
        folder = self.versions.new_folder("totals")
        merged.coalesce(1).write.parquet(folder)  # as many rows as there are keys
        fs, to_path = file_system(self.spark, self.path)
        fs.mkdirs(to_path(f"{self._notes(batch)}/{v + 1}-{folder.rpartition('/')[2]}"))
        self.versions.publish(folder, v + 1)
        return True


def copies_of(counts: DataFrame) -> DataFrame:
    """Counts of documents whose text a smaller doc_id has too.

    The first of each text is found with partial minima; only texts that come more than once are joined back, and of
    these a text with very many copies by broadcast (`lookup`). Rows without id or text are no copies, and of rows
    with one id none is another's copy.
    """
    kept = counts.columns
    rows = materialise(counts.filter("text_hash is not null and doc_id is not null"), "rows") if getattr(counts, "_scratch_path", None) is None else counts
    firsts = materialise(rows.groupBy("text_hash").agg(F.min("doc_id").alias("_first_id"), F.count("*").alias("_copies")).filter("_copies > 1 and text_hash is not null"), "firsts")
    return lookup(rows, firsts, "text_hash", hubs_of(firsts, "text_hash", "_copies")).filter("doc_id > _first_id").select(*kept)

"""Bounded labelled samples for the classifiers, and a distributed scorer for models that are plain numpy arrays."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from .shared import small_batches, unused

#: Labelled documents of each class that a classifier is fitted on, at most.
SAMPLE = 2500
#: Bytes of the texts of a sample, at most.
SAMPLE_BYTES = 128 << 20


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, per_class: int = SAMPLE, columns: tuple[str, ...] = (), most_bytes: int = SAMPLE_BYTES) -> tuple[list, dict[int, int]]:
    """Rows (doc_id, text, label, *columns) of at most `per_class` labelled documents of each class, and all labels' counts.

    The sample is the ids of smallest hash, so it does not depend on partitions; its ids are few and broadcast. Of an id
    with several rows the one with the smallest text counts, of an id with two labels the smaller one; null ids or labels
    are left out. Documents are taken by hash until their texts pass `most_bytes`, so the driver's share is bounded.
    """
    known = labels.filter(f"doc_id is not null and {label} in (0, 1)").groupBy("doc_id").agg(F.min(label).cast("int").alias("label"))
    counts = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    ids = [tuple(r) for v in (0, 1) for r in known.filter(F.col("label") == v).orderBy(F.xxhash64("doc_id"), "doc_id").limit(per_class).collect()]
    if not ids:
        return [], counts
    picked = docs.sparkSession.createDataFrame(ids, "_id long, _label int")
    row = F.struct(F.coalesce("text", F.lit("")).alias("text"), *columns)
    found = docs.select(F.col("doc_id").cast("long").alias("_id"), row.alias("_row")).join(F.broadcast(picked), "_id").groupBy("_id", "_label").agg(F.min("_row").alias("row"))
    # at most 2 * per_class rows
    order = Window.partitionBy().orderBy(F.xxhash64("_id"), "_id").rowsBetween(Window.unboundedPreceding, 0)
    within = found.withColumn("total", F.sum(F.octet_length("row.text").cast("long")).over(order)).filter(F.col("total") <= most_bytes)
    rows = within.select(F.col("_id").alias("doc_id"), F.col("row.text").alias("text"), F.col("_label").alias("label"), *(F.col(f"row.{c}").alias(c) for c in columns))
    return sorted(rows.collect(), key=lambda r: r["doc_id"]), counts


def coded_words(texts: list[str]):
    """(distinct words, code of each word of all texts, text of each word): words stand between blanks of any kind."""
    import numpy as np

    split = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(pa.array(texts, pa.string())))
    coded = split.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    code, text = np.asarray(coded.indices).astype(np.int64), np.repeat(np.arange(len(texts)), np.diff(np.asarray(split.offsets)))
    if "" in words:  # a text without words splits into one empty word
        some = code != words.index("")
        code, text = code[some], text[some]
    return words, code, text


def blocks(texts: list[str], most: int = 4_000_000):
    """(from, to) of runs of texts of at most so many characters, or one text."""
    start = 0
    while start < len(texts):
        stop, chars = start, 0
        while stop < len(texts) and (stop == start or chars + len(texts[stop]) <= most):
            chars += len(texts[stop])
            stop += 1
        yield start, stop
        start = stop


def score_texts(docs: DataFrame, scorer: Callable, model, columns: tuple[str, ...], name: str = "score") -> DataFrame:
    """The columns and, under `name`, the score of every row; scorer(model) makes, once in a worker, a function of a list of texts.

    The model travels by Spark's broadcast; its size is fixed by its parameters, whatever the tables. None of the columns
    may have that name.
    """
    spark = docs.sparkSession
    small_batches(spark)
    sent = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = scorer(sent.value)
        for batch in batches:
            scores = score([t or "" for t in batch.column(batch.num_columns - 1).to_pylist()])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(scores, pa.float64())], names=[*columns, name])

    schema = StructType([*(docs.schema[c] for c in columns), StructField(name, DoubleType())])
    plain = lambda c: F.col("`" + c.replace("`", "``") + "`")
    return docs.select(*map(plain, columns), F.col("text").alias(unused(list(columns), "_text"))).mapInArrow(run, schema)

"""A corpus pipeline of four of the operators: toxicity, quality rules, near-duplicates, packing.

Each stage takes (spark, docs, sf_dir), works on all that the stage before kept and returns a DataFrame, which is
written as Parquet and read again as the next one's docs. All but the last return the columns of `documents`. Labels of
`sf_dir` train the classifier and name the trusted target; other tables are not read. Empty tables pass through. A row
is kept or dropped by itself, through a key of its own: rows that share an id are decided on one by one, and a row
without id is a document like others.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seamlight.llm import minhash, packing, quality_rules, toxicity
from seamlight.llm.shared import materialise, scratch, table, unused


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents below the toxicity threshold of their language."""
    score, threshold, toxic = (unused(docs.columns, name) for name in ("_score", "_threshold", "_toxic"))
    kept = toxicity.flagged(docs, table(spark, sf_dir, "labels"), columns=(score, threshold, toxic)).filter(~F.col(toxic))
    return kept.drop(score, threshold, toxic)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the surface rules and the log-likelihood ratio, whose corpus is what came in."""
    keyed, key = _keyed(docs)
    labels = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    trusted = keyed.select(key, "doc_id").join(labels.hint("merge"), "doc_id", "left_semi").select(key)
    return _kept(keyed, quality_rules.quality_rules(keyed, trusted, id_column=key).filter("kept"), key)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each component at five-word shingles and a similarity of 0.8: that of smallest id, null ids last."""
    keyed, key = _keyed(docs)
    found = minhash.near_duplicates(keyed, id_column=key).select(key, "component_id")
    named = found.join(keyed.select(key, F.col("doc_id").alias("own_id")).hint("merge"), key)
    firsts = named.groupBy("component_id").agg(F.min(F.struct(F.isnull("own_id").alias("no_id"), "own_id", F.col(key).alias("place"))).alias("first"))
    return _kept(keyed, firsts.select(F.col("first.place").alias(key)), key)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces in sequences of 2048."""
    return packing.best_fit_packing(docs)


def _keyed(docs: DataFrame) -> tuple[DataFrame, str]:
    """The rows with a key of each row, written so that it stays the same, and the key's name, which no column has."""
    key = unused([*docs.columns, "component_id", "n_shingles", "kept", "own_id"], "_place")
    return materialise(docs.withColumn(key, F.monotonically_increasing_id()), "keyed"), key


def _kept(keyed: DataFrame, verdict: DataFrame, key: str) -> DataFrame:
    return keyed.join(verdict.select(key).hint("merge"), key, "left_semi").drop(key)


STAGES = [("toxicity", drop_toxic), ("quality_rules", keep_quality), ("minhash_dedup", drop_near_copies), ("packing", pack)]

#: A convolutional classifier and byte-level BPE are not expressible in SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; each result is written in the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = scratch(spark, f"stage-{name}")
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs

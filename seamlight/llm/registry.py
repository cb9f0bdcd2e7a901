"""Queries and oracle SQL of the training-data operators, for the driver's entry module."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bytepair, minhash, packing, quality_model, quality_rules, rollups, sharding, topk, toxicity, warc
from .shared import materialise, scratch, table


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), size=3, percent=85)


def op2_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.best_fit_packing(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "warc")
    warc.write_warc(table(spark, sf_dir, "pages"), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents arrive in four batches, are compacted into shards of up to 64 MB and read back through the manifest."""
    docs = table(spark, sf_dir, "documents")
    store = sharding.ShardStore(spark, scratch(spark, "shards"))
    for batch in range(4):
        store.append(docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(4)) == batch))
    store.compact(docs.schema, 64 << 20)
    store.vacuum()
    live = store.read(docs.schema)
    return live.select("doc_id", "lang", "source", "n_chars", F.octet_length("text").cast("long").alias("text_bytes"), F.md5("text").alias("text_md5"))


def op5_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trusted target: documents labelled as of good quality."""
    trusted = table(spark, sf_dir, "labels").filter("quality = 1").select("doc_id")
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"), trusted)


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bytepair.encode_decode(table(spark, sf_dir, "documents"), ids=False)


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(topk.numbered(topk.quantised(table(spark, sf_dir, "embeddings"))), "id % 50 = 0")


def op8_toxicity_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored_by_fold(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_quality_subwords(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_model.scored_by_fold(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op10_token_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals after four batches: all documents come in under another vocabulary; all are recounted under a second tokenizer
    version; copies of a text are deleted; that delete is sent once more."""
    docs = table(spark, sf_dir, "documents")
    old = materialise(rollups.count_tokens(docs, "byte_bpe_multi_50k.tiktoken", "byte_bpe_multi_50k/1"), "counts")
    counts = materialise(rollups.count_tokens(docs, "byte_bpe_50k.json", "byte_bpe_50k/1"), "counts")
    rollup = rollups.Rollup(spark, scratch(spark, "rollup"))
    rollup.commit("load", old)
    rollup.commit("recount", rollups.revise(old, counts))
    copies = rollups.retract(rollups.copies_of(counts))
    rollup.commit("drop-copies", copies)
    rollup.commit("drop-copies", copies)
    return rollup.totals()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_minhash_dedup, op2_best_fit_packing, op3_warc, op4_sharding, op5_quality_rules, op6_byte_bpe, op7_exact_top_k, op8_toxicity_cnn, op9_quality_subwords, op10_token_rollup)}


def oracle_sql() -> dict[str, str]:
    return SQL


SQL = {
    "op3_warc": """
        WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
        m AS (SELECT page_id, h, strlen(h) AS n, max(page_id) OVER (PARTITION BY h) AS holder FROM p)
        SELECT page_id, n::BIGINT AS payload_bytes, sha1(h) AS payload_digest,
               CASE WHEN n >= 1000 AND holder <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN n >= 1000 AND holder <> page_id THEN holder END AS refers_to
        FROM m""",
    "op4_sharding": """
        SELECT doc_id, lang, source, n_chars, strlen(text)::BIGINT AS text_bytes, md5(text) AS text_md5 FROM documents""",
    "op7_exact_top_k": """
        WITH v AS (SELECT row_number() OVER () AS own, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
        s AS (SELECT q.own, q.vec_id AS query_id, c.vec_id, list_dot_product(q.e, c.e)::BIGINT AS score
              FROM v q JOIN v c ON q.vec_id % 50 = 0 AND c.own <> q.own),
        r AS (SELECT *, row_number() OVER (PARTITION BY own ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5""",
}

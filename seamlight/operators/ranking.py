"""Fusion of candidate signals: weighted sum, reciprocal ranks, and reciprocal ranks with an entity signal."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import keyword_overlap, keyword_terms


def signals(candidates: DataFrame, query_text: str, page_index: bool = True) -> DataFrame:
    """Adds cosine_score, page_score and keyword_score, rounded to six places, to candidates of one query.

    `candidates` has chunk_id, cand_pos, distance, text, doc_id, page_number: a few rows, as they come after a limit.
    The page signal falls with the pages between a chunk and the best one of its document; the best itself has 1.
    """
    everyone = Window.partitionBy()
    best = F.max_by(F.struct("chunk_id", "doc_id", "page_number"), F.struct(-F.col("distance"), -F.col("cand_pos"))).over(everyone)
    df = candidates.withColumn("_best", best)
    near = F.when(F.col("doc_id") == F.col("_best.doc_id"), 1.0 / (1 + F.abs(F.col("page_number") - F.col("_best.page_number")))).otherwise(0.0)
    page = F.when(F.col("chunk_id") == F.col("_best.chunk_id"), 1.0).otherwise(near if page_index else 0.0)
    keyword = keyword_overlap(keyword_terms(F.lit(query_text)), keyword_terms(F.col("text")))
    return df.withColumns({"cosine_score": F.round(1 - F.col("distance"), 6), "page_score": F.round(F.coalesce(page, F.lit(0.0)), 6), "keyword_score": F.round(keyword, 6)}).drop("_best")


def linear(scored: DataFrame, alpha: float = 0.7, beta: float = 0.2, gamma: float = 0.1) -> DataFrame:
    return scored.withColumn("score", F.round(alpha * F.col("cosine_score") + beta * F.col("page_score") + gamma * F.col("keyword_score"), 6))


def reciprocal(scored: DataFrame, alpha: float = 0.7, beta: float = 0.2, gamma: float = 0.1, k: float = 60.0, overlap: DataFrame | None = None) -> DataFrame:
    """score = sum of weight / (k + rank) over the signals; equal values rank by candidate order, each with its own rank.

    `overlap` (chunk_id, shared) adds the entity signal, weighing gamma, for chunks that share an entity with the query.
    """
    k = k if k > 0 else 60.0
    rank = lambda c: F.row_number().over(Window.partitionBy().orderBy(F.desc(c), "cand_pos"))
    total = alpha / (k + rank("cosine_score")) + beta / (k + rank("page_score")) + gamma / (k + rank("keyword_score"))
    if overlap is None:
        return scored.withColumn("score", F.round(total, 9))
    both = scored.join(overlap.select("chunk_id", "shared"), "chunk_id", "left").fillna(0, ["shared"])
    return both.withColumn("score", F.round(total + F.when(F.col("shared") > 0, gamma / (k + rank("shared"))).otherwise(0.0), 9)).drop("shared")


def best(scored: DataFrame, top_k: int) -> DataFrame:
    """The top_k rows by score, ties by candidate order, with their rank; all rows if top_k is 0."""
    df = scored.orderBy(F.desc("score"), "cand_pos").limit(top_k) if top_k > 0 else scored
    return df.withColumn("rank", F.row_number().over(Window.partitionBy().orderBy(F.desc("score"), "cand_pos")))

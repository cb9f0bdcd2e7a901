"""Documents into chunks: windows of words, embeddings, and the skipping of what is there already."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.session import importable
from ..functions.text import long_windows, word_windows


def chunked(docs: DataFrame, size: int = 200, overlap: int = 40, least_chars: int = 0) -> DataFrame:
    """doc_id, chunk_index, text: overlapping windows of words; from the first window of fewer characters on, none."""
    windows = word_windows(F.col("text"), size, overlap)
    return docs.select("doc_id", F.posexplode(long_windows(windows, least_chars) if least_chars else windows).alias("chunk_index", "text"))


def new_documents(docs: DataFrame, known: DataFrame) -> DataFrame:
    """Documents whose doc_id is not among the known ones."""
    return docs.join(known.select("doc_id").distinct(), "doc_id", "left_anti")


def ingest(docs: DataFrame, embedder, size: int = 200, overlap: int = 40) -> DataFrame:
    """chunk_id, text, embedding, doc_id, page_number: ids are a hash of document and place, so a repeated run gives the same."""
    importable(docs.sparkSession)
    rows = chunked(docs, size, overlap)
    return rows.select(F.xxhash64("doc_id", "chunk_index").alias("chunk_id"), "text", embedder.column(F.col("text")).alias("embedding"), "doc_id", F.col("chunk_index").cast("long").alias("page_number"))


def remove_chunks(chunks: DataFrame, ids: DataFrame) -> DataFrame:
    """Without the given chunk_ids; unknown ones do no harm."""
    return chunks.join(ids.select("chunk_id"), "chunk_id", "left_anti")


def document_pages(chunks: DataFrame, doc_id: int) -> DataFrame:
    """The chunks of a document by page."""
    return chunks.filter(F.col("doc_id") == doc_id).orderBy("page_number", "chunk_id")

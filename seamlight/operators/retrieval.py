"""Hybrid retrieval of one query: candidates by vector and by words, relational filter, fusion, expansion by entities."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from . import entities, knn, ranking
from .lexical import LexicalIndex, normalized

RESULT = ["rank", "chunk_id", "score", "cosine_score", "page_score", "keyword_score", "doc_id", "page_number", "text"]


@dataclass(frozen=True)
class RetrievalSpec:
    """One query and its settings. mode: hybrid, vector or bm25; ranker: linear, rrf, graph_rrf, or none (the plain similarity)."""

    text: str = ""
    vector: tuple | None = None
    top_k: int = 5
    mode: str = "hybrid"
    ranker: str = "linear"
    alpha: float = 0.70
    beta: float = 0.20
    gamma: float = 0.10
    rrf_k: float = 60.0
    over_fetch: int = 3
    page_index: bool = True
    filter_mode: str = "post"
    expand: bool = False
    token_budget: int = 3200
    token_ratio: float = 3.5

    def with_text(self, text: str) -> RetrievalSpec:
        return replace(self, text=text)

    def with_vector(self, vector, text: str = "") -> RetrievalSpec:
        return replace(self, vector=tuple(vector), text=text)


def linked_chunks(objects: DataFrame, edges: DataFrame, relation: str) -> DataFrame:
    """chunk_id of everything that `relation` links with the objects (id), in either direction."""
    own = edges.filter(F.col("relation") == relation)
    ids = objects.select("id")
    out = own.join(ids, own["from_id"] == ids["id"], "left_semi").select(F.col("to_id").alias("chunk_id"))
    back = own.join(ids, own["to_id"] == ids["id"], "left_semi").select(F.col("from_id").alias("chunk_id"))
    return out.union(back).distinct()


def candidates(chunks: DataFrame, spec: RetrievalSpec, index: LexicalIndex | None = None) -> DataFrame:
    """chunk_id, cand_pos, distance: nearest vectors by distance, then what only the words find by falling BM25.

    At most over_fetch * top_k rows of either kind; their texts and pages are joined back later, so no text is shuffled.
    """
    most = spec.over_fetch * spec.top_k
    near = None
    if spec.mode != "bm25":
        found = knn.nearest(chunks, spec.vector, most, "chunk_id")
        near = found.select("chunk_id", "distance", F.lit(0).alias("part"), F.col("distance").alias("by"))
        if spec.mode == "vector" or not spec.text:
            return _placed(near)
    index = index or LexicalIndex.build(chunks)
    asked = chunks.sparkSession.createDataFrame([(0, spec.text)], "query_id int, text string")
    words = index.search(asked, most).select("chunk_id", "bm25")
    if near is None:
        return _placed(words.select("chunk_id", F.lit(1.0).alias("distance"), F.lit(1).alias("part"), (-F.col("bm25")).alias("by")))
    # lexical hits are few; their exact distance is read for them alone
    extra = words.join(near.select("chunk_id"), "chunk_id", "left_anti").join(chunks.select("chunk_id", "embedding"), "chunk_id")
    far = F.coalesce(F.round(V.cosine_distance(F.col("embedding"), V.literal(spec.vector)), 6), F.lit(1.0))
    return _placed(near.unionByName(extra.select("chunk_id", far.alias("distance"), F.lit(1).alias("part"), (-F.col("bm25")).alias("by"))))


def _placed(df: DataFrame) -> DataFrame:
    return df.withColumn("cand_pos", F.row_number().over(Window.partitionBy().orderBy("part", "by", "chunk_id"))).select("chunk_id", "cand_pos", "distance")


def retrieve(chunks: DataFrame, spec: RetrievalSpec, index: LexicalIndex | None = None, allowed: DataFrame | None = None, chunk_entities: DataFrame | None = None) -> DataFrame:
    """RESULT columns of the best chunks (chunk_id, text, embedding, doc_id, page_number) for one query.

    `allowed` (chunk_id) is authoritative: with filter_mode "post" it filters the candidates, with "pre" the chunks that
    may become one. `chunk_entities` (chunk_id, entity) serves the graph_rrf ranker and expansion, whose rows follow with
    score 0. A hybrid or vector query without a vector finds nothing.
    """
    if spec.mode != "bm25" and spec.vector is None:
        return chunks.sparkSession.createDataFrame([], "rank int, chunk_id long, score double, cosine_score double, page_score double, keyword_score double, doc_id long, page_number long, text string")
    if spec.mode == "bm25":
        index = index or LexicalIndex.build(chunks)
        asked = chunks.sparkSession.createDataFrame([(0, spec.text)], "query_id int, text string")
        found = normalized(index.search(asked, spec.top_k, allowed)).join(chunks, "chunk_id")
        out = found.withColumns({"keyword_score": F.col("score"), "cosine_score": F.lit(0.0), "page_score": F.lit(0.0)}).select(*RESULT)
    else:
        pool = chunks.join(allowed, "chunk_id", "left_semi") if allowed is not None and spec.filter_mode == "pre" else chunks
        found = candidates(pool, spec, index if pool is chunks else _restricted(index or LexicalIndex.build(chunks), allowed))
        if allowed is not None and spec.filter_mode == "post":
            found = found.join(allowed, "chunk_id", "left_semi")
        found = found.join(chunks.select("chunk_id", "text", "doc_id", "page_number"), "chunk_id")
        scored = ranking.signals(found, spec.text, spec.page_index)
        if spec.ranker == "none":
            scored = scored.withColumns({"score": F.col("cosine_score"), "page_score": F.lit(0.0), "keyword_score": F.lit(0.0)})
        elif spec.ranker == "linear":
            scored = ranking.linear(scored, spec.alpha, spec.beta, spec.gamma)
        else:
            overlap = None
            if spec.ranker == "graph_rrf" and chunk_entities is not None and spec.text:
                overlap = entities.shared_entities(chunk_entities, entities.entities_of(chunks.sparkSession, spec.text))
            scored = ranking.reciprocal(scored, spec.alpha, spec.beta, spec.gamma, spec.rrf_k, overlap)
        out = ranking.best(scored, spec.top_k).select(*RESULT)
    if spec.expand and chunk_entities is not None:
        out = with_expansion(out, chunks, chunk_entities, spec.top_k)
    return out


class _restricted(LexicalIndex):
    """An index whose results are restricted and whose statistics are not."""

    def __init__(self, index: LexicalIndex, allowed: DataFrame):
        super().__init__(index.documents, index.frequencies, index.statistics)
        self.allowed = allowed

    def search(self, queries: DataFrame, k: int = 5, allowed: DataFrame | None = None) -> DataFrame:
        return super().search(queries, k, self.allowed)


def with_expansion(results: DataFrame, chunks: DataFrame, chunk_entities: DataFrame, top_k: int) -> DataFrame:
    """The results and up to five chunks that share entities with the best three, or entities that occur with theirs."""
    more = entities.expand(results.select("rank", "chunk_id"), chunk_entities)
    more = more.join(chunks.select("chunk_id", "text", "doc_id", "page_number"), "chunk_id")
    zero = F.lit(0.0)
    more = more.select((F.col("rank") + top_k).alias("rank"), "chunk_id", zero.alias("score"), zero.alias("cosine_score"), zero.alias("page_score"), zero.alias("keyword_score"), "doc_id", "page_number", "text")
    return results.unionByName(more)

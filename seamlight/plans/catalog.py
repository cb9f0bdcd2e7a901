"""All registered queries of the engine over the shared test tables. Their oracle SQL is in `oracle.py`."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions import vector as V
from ..functions.embed import HashEmbedder, WordPiece
from ..functions.session import arrow_rows, importable, materialise, scratch
from ..operators import ann, context, entities, ingest, knn, objects, ranking, sync
from ..operators.lexical import LexicalIndex, normalized
from ..operators.retrieval import RetrievalSpec, linked_chunks, retrieve
from ..sources.store import norm_report
from ..streaming import changes
from .oracle import QUERY_TEXT, QUERY_VECTOR, RELATION, SQL


def table(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents with a vector: chunk_id, text, embedding, doc_id, page_number."""
    e, t = table(spark, d, "embeddings").select("vec_id", "embedding"), table(spark, d, "documents").select(F.col("doc_id").alias("vec_id"), "text")
    return e.join(t, "vec_id").select(F.col("vec_id").alias("chunk_id"), "text", "embedding", F.expr("vec_id div 100").alias("doc_id"), (F.col("vec_id") % 100).alias("page_number"))


def texts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), "text")


_INDEXES: dict[tuple[str, str, str], LexicalIndex | ann.VectorIndex | DataFrame] = {}


def lexical_index(spark: SparkSession, d: str, kind: str = "texts") -> LexicalIndex:
    """The lexical index of all documents, or of those with a vector (chunks): built and written once an application."""
    key = (spark.sparkContext.applicationId, d, kind)
    if key not in _INDEXES:
        rows = texts(spark, d) if kind == "texts" else chunks(spark, d).select("chunk_id", "text")
        _INDEXES[key] = LexicalIndex.build(rows).persisted(scratch(spark, "lexical"))
    return _INDEXES[key]


def query_vector(spark: SparkSession, d: str) -> list[float]:
    return table(spark, d, "embeddings").filter(F.col("vec_id") == QUERY_VECTOR).first()["embedding"]


def spec(spark: SparkSession, d: str, **settings) -> RetrievalSpec:
    return RetrievalSpec(text=QUERY_TEXT, vector=tuple(query_vector(spark, d)), **settings)


def vector_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").filter("vec_id % 5 = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))


def text_queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


# --- vectors ---------------------------------------------------------------------------------------------------------


def knn_exact(spark, d):
    return knn.nearest(table(spark, d, "embeddings"), query_vector(spark, d), 10)


def knn_batch(spark, d):
    return knn.nearest_many(table(spark, d, "embeddings"), vector_queries(spark, d), 5)


def knn_radius(spark, d):
    return knn.within(table(spark, d, "embeddings"), query_vector(spark, d), 0.6)


def true_cosine_top(spark, d):
    e, q = table(spark, d, "embeddings"), V.literal(query_vector(spark, d))
    return e.select("vec_id", F.round(V.true_cosine(F.col("embedding"), q), 6).alias("cosine"), F.round(V.clamped_cosine(F.col("embedding"), q), 6).alias("clamped")).orderBy(F.desc("cosine"), "vec_id").limit(10)


def vector_norm_check(spark, d):
    return norm_report(table(spark, d, "embeddings"))


def l2_normalize(spark, d):
    scaled = F.transform("embedding", lambda x: x * F.lit(3.0))
    v = V.l2_normalize(scaled)
    return table(spark, d, "embeddings").select("vec_id", F.round(V.norm(v), 6).alias("norm"), F.round(F.get(v, F.lit(0)), 6).alias("first"))


def int8_quantize(spark, d):
    e = table(spark, d, "embeddings").withColumn("scale", V.int8_scale(F.col("embedding"))).withColumn("codes", V.int8_codes(F.col("embedding"), F.col("scale")))
    return e.select("vec_id", F.round("scale", 9).alias("scale"), F.aggregate("codes", F.lit(0), lambda s, x: s + x).cast("bigint").alias("code_sum"), F.array_max("codes").alias("code_max"))


def int8_two_stage_knn(spark, d):
    return knn.nearest_int8(table(spark, d, "embeddings"), query_vector(spark, d), 10)


def knn_difficulty_gap(spark, d):
    return knn.difficulty_gap(knn_batch(spark, d))


def _truth(spark, d):
    return knn_batch(spark, d).withColumnRenamed("vec_id", "id")


def vector_index(spark, d) -> ann.VectorIndex:
    """The approximate index of all embeddings: built and written once an application."""
    key = (spark.sparkContext.applicationId, d, "vectors")
    if key not in _INDEXES:
        _INDEXES[key] = ann.VectorIndex.build(table(spark, d, "embeddings"), scratch(spark, "vectors"))
    return _INDEXES[key]


def ivf_recall(spark, d):
    """Recall at 5 of inverted lists, and of lists widened where the gap is small. The number of lists to read is set by
    the recall of at most 500 other queries."""
    e, q, truth = table(spark, d, "embeddings"), vector_queries(spark, d), materialise(_truth(spark, d), "truth")
    index = vector_index(spark, d)
    asked = e.filter("vec_id % 5 <> 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    probes = index.probes_for(asked.orderBy(F.xxhash64("query_id"), "query_id").limit(500), 5)
    narrow = knn.recall(index.search(q, 5, probes), truth, "id").select(F.lit("measured").alias("setting"), "recall")
    return narrow.unionByName(knn.recall(index.search(q, 5, probes, widen_below=0.15), truth, "id").select(F.lit("adaptive").alias("setting"), "recall"))


def lsh_recall(spark, d):
    return knn.recall(knn.nearest_lsh(table(spark, d, "embeddings"), vector_queries(spark, d), 5), _truth(spark, d), "id")


# --- words -----------------------------------------------------------------------------------------------------------


def term_frequencies(spark, d):
    return LexicalIndex.build(texts(spark, d)).postings.select("chunk_id", "term", "tf")


def doc_lengths(spark, d):
    return LexicalIndex.build(texts(spark, d)).lengths()


def bm25_idf(spark, d):
    return lexical_index(spark, d).idf().select("term", "df", F.round("idf", 6).alias("idf"))


def bm25_search(spark, d):
    """Every benchmark text as a query."""
    return lexical_index(spark, d).search(text_queries(spark, d), 10)


def bm25_normalized(spark, d):
    asked = spark.createDataFrame([(0, QUERY_TEXT)], "query_id int, text string")
    return normalized(lexical_index(spark, d).search(asked, 10)).drop("query_id")


def keyword_jaccard(spark, d):
    score = T.keyword_overlap(T.keyword_terms(F.lit(QUERY_TEXT)), T.keyword_terms(F.col("text")))
    return texts(spark, d).select("chunk_id", F.round(score, 6).alias("keyword_score"))


def token_estimates(spark, d):
    return texts(spark, d).select("chunk_id", T.token_estimate(F.coalesce("text", F.lit(""))).cast("bigint").alias("tokens"))


def chunk_words(spark, d):
    return ingest.chunked(table(spark, d, "documents"))


def chunk_words_min_len(spark, d):
    return ingest.chunked(table(spark, d, "documents"), 200, 40, least_chars=400)


def chunk_chars_budget(spark, d):
    importable(spark)
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.posexplode(T.char_chunks(500)(T.words(F.col("text")))).alias("chunk_index", "text"))


def ingest_new_docs(spark, d):
    docs = table(spark, d, "documents")
    return ingest.chunked(ingest.new_documents(docs, table(spark, d, "labels"))).groupBy("doc_id").agg(F.count("*").alias("n_chunks"))


# --- retrieval -------------------------------------------------------------------------------------------------------


def _shown(df: DataFrame) -> DataFrame:
    return df.select("rank", "chunk_id", "score", "cosine_score", "page_score", "keyword_score", "doc_id", "page_number")


def hybrid_linear(spark, d):
    return _shown(retrieve(chunks(spark, d), spec(spark, d), lexical_index(spark, d, "chunks")))


def hybrid_rrf(spark, d):
    return _shown(retrieve(chunks(spark, d), spec(spark, d, ranker="rrf"), lexical_index(spark, d, "chunks")))


def vector_only(spark, d):
    return _shown(retrieve(chunks(spark, d), spec(spark, d, mode="vector"), lexical_index(spark, d, "chunks")))


def hybrid_no_page(spark, d):
    return _shown(retrieve(chunks(spark, d), spec(spark, d, page_index=False), lexical_index(spark, d, "chunks")))


def retrieval_raw(spark, d):
    return _shown(retrieve(chunks(spark, d), spec(spark, d, ranker="none"), lexical_index(spark, d, "chunks")))


def retrieval_bm25(spark, d):
    return _shown(retrieve(chunks(spark, d), spec(spark, d, mode="bm25"), lexical_index(spark, d, "chunks")))


def hybrid_expanded(spark, d):
    return _shown(retrieve(chunks(spark, d), spec(spark, d, expand=True), lexical_index(spark, d, "chunks"), chunk_entities=entity_index(spark, d, "chunks")))


def page_proximity(spark, d):
    c = chunks(spark, d)
    near = knn.nearest(c, query_vector(spark, d), 30, "chunk_id").withColumn("cand_pos", F.lit(0))
    return ranking.signals(near.join(c, "chunk_id"), QUERY_TEXT).select("chunk_id", "page_score")


def _allowed(spark, d) -> DataFrame:
    """Chunks that a label of good quality links."""
    labels = table(spark, d, "labels")
    obj = labels.select(F.col("doc_id").alias("id"), F.lit("label").alias("type_name"), F.to_json(F.struct("quality", "toxic")).alias("props"), F.lit(1).cast("bigint").alias("sync_clock"), F.lit("").alias("writer"), F.lit(False).alias("is_deleted"))
    edges = labels.select(F.lit(RELATION).alias("relation"), F.col("doc_id").alias("from_id"), F.col("doc_id").alias("to_id"))
    return linked_chunks(objects.where(obj, "label", "quality", "1", limit=None), edges, RELATION)


def hybrid_filtered_post(spark, d):
    return _shown(retrieve(chunks(spark, d), spec(spark, d), lexical_index(spark, d, "chunks"), allowed=_allowed(spark, d)))


def hybrid_filtered_pre(spark, d):
    return _shown(retrieve(chunks(spark, d), spec(spark, d, filter_mode="pre"), lexical_index(spark, d, "chunks"), allowed=_allowed(spark, d)))


def context_budget(spark, d):
    rows = context.entries(retrieve(chunks(spark, d), spec(spark, d, top_k=8), lexical_index(spark, d, "chunks")), 1500)
    return rows.select("rank", "chunk_id", F.col("tokens").cast("bigint"), F.col("total").cast("bigint"), "fits")


def context_string(spark, d):
    return context.assemble(retrieve(chunks(spark, d), spec(spark, d, top_k=8), lexical_index(spark, d, "chunks")), 1500).select("context", "truncated", F.col("tokens").cast("bigint").alias("tokens"))


def context_words_skip(spark, d):
    return context.assemble_words(retrieve(chunks(spark, d), spec(spark, d, top_k=8), lexical_index(spark, d, "chunks")))


# --- objects and relations -------------------------------------------------------------------------------------------


def event_objects(spark, d) -> DataFrame:
    """Events as typed objects; errors are tombstones."""
    e = table(spark, d, "events")
    return e.select(F.col("event_id").alias("id"), F.col("event_type").alias("type_name"), "props", F.col("event_id").alias("sync_clock"), F.lit("a").alias("writer"), (F.col("event_type") == "error").alias("is_deleted"))


def order_edges(spark, d) -> DataFrame:
    """Order to customer, and order to part."""
    o, i = table(spark, d, "orders"), table(spark, d, "lineitem")
    placed = o.select(F.lit("placed_by").alias("relation"), F.col("o_orderkey").alias("from_id"), F.col("o_custkey").alias("to_id"))
    return placed.unionByName(i.select(F.lit("contains").alias("relation"), F.col("l_orderkey").alias("from_id"), F.col("l_partkey").alias("to_id")))


def object_by_property(spark, d):
    return objects.where(event_objects(spark, d), "click", "k", "7", limit=None).select("id", "props")


def object_list_page(spark, d):
    return objects.where(event_objects(spark, d), "click", limit=50, offset=20).select("id", "props")


def object_counts(spark, d):
    return objects.counts(event_objects(spark, d))


def object_latest(spark, d):
    """Events of a user as versions of one object."""
    e = event_objects(spark, d).join(table(spark, d, "events").select(F.col("event_id").alias("id"), "user_id"), "id")
    return objects.latest(e.withColumn("id", F.col("user_id")).drop("user_id")).select("id", "type_name", "props", "sync_clock", "is_deleted")


def object_upsert(spark, d):
    """Deleted events are written anew."""
    e = event_objects(spark, d)
    again = e.filter("is_deleted").select("id", "type_name", F.lit('{"k": -1}').alias("props"))
    return objects.upsert(e, again).select("id", "props", "sync_clock", "is_deleted")


def property_index(spark, d):
    return objects.property_index(event_objects(spark, d)).groupBy("type_name", "key", "value").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def relation_targets(spark, d):
    ids = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    return objects.targets(order_edges(spark, d), "contains", ids)


def relation_sources(spark, d):
    ids = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("id"))
    return objects.sources(order_edges(spark, d), "placed_by", ids)


def relation_edges_distinct(spark, d):
    return objects.distinct_edges(order_edges(spark, d)).groupBy("relation").agg(F.count("*").alias("n"))


def relation_cascade_delete(spark, d):
    ids = table(spark, d, "orders").filter("o_orderpriority = '1-URGENT'").select(F.col("o_orderkey").alias("id"))
    return objects.without_records(order_edges(spark, d), ids).groupBy("relation").agg(F.count("*").alias("n"), F.sum("from_id").alias("sum_from"))


def relation_edges_removed(spark, d):
    edges = order_edges(spark, d)
    ids = table(spark, d, "orders").filter("o_orderstatus = 'F'").select(F.col("o_orderkey").alias("id"))
    gone = objects.targets(edges, "placed_by", ids).withColumn("relation", F.lit("placed_by"))
    return objects.remove_edges(edges, gone).groupBy("relation").agg(F.count("*").alias("n"), F.sum("to_id").alias("sum_to"))


def relation_two_hops(spark, d):
    """Nation to region through customers: orders of each region."""
    o, c = table(spark, d, "orders"), table(spark, d, "customer")
    n, r = table(spark, d, "nation"), table(spark, d, "region")
    path = o.join(c, o["o_custkey"] == c["c_custkey"]).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    return path.groupBy("r_name").agg(F.count("*").alias("n_orders"))


# --- entity graph ----------------------------------------------------------------------------------------------------


def entity_index(spark: SparkSession, d: str, kind: str = "windows") -> DataFrame:
    """chunk_id, entity of all documents (texts), those with a vector (chunks), or windows of words of each document, whose
    chunk_id is the document's times 1000, plus its place: extracted and written once an application."""
    key = (spark.sparkContext.applicationId, d, "entities of " + kind)
    if key not in _INDEXES:
        if kind == "windows":
            found = entities.window_entities(table(spark, d, "documents")).select((F.col("doc_id") * 1000 + F.col("chunk_index")).alias("chunk_id"), "entity")
        else:
            found = entities.chunk_entities(texts(spark, d) if kind == "texts" else chunks(spark, d).select("chunk_id", "text"))
        _INDEXES[key] = materialise(found, "entities")
    return _INDEXES[key]


def entities_extracted(spark, d):
    return entities.extracted(texts(spark, d))


def entity_chunks(spark, d):
    return entity_index(spark, d).groupBy("entity").agg(F.count("*").alias("n_chunks"), F.min("chunk_id").alias("first_chunk"))


def entity_cooccurrence(spark, d):
    return entities.cooccurrence(entity_index(spark, d))


def entity_related_2hop(spark, d):
    s = entity_index(spark, d)
    start = s.filter("chunk_id % 20 = 0").select("entity")
    return entities.related_by_chunks(start, s, 2)


def kg_expand(spark, d):
    best = bm25_normalized(spark, d).select("rank", "chunk_id").filter("rank <= 5")
    return entities.expand(best, entity_index(spark, d, "texts"))


def entity_remove(spark, d):
    s = entity_index(spark, d)
    return entities.remove_chunks(s, s.filter("chunk_id % 3 = 0")).groupBy("entity").agg(F.count("*").alias("n_chunks"))


def graph_rrf(spark, d):
    """Reciprocal ranks with the entities of the 40 nearest chunks as the query's."""
    c = chunks(spark, d)
    s = entity_index(spark, d, "chunks")
    near = knn.nearest(c, query_vector(spark, d), 200, "chunk_id")
    placed = near.withColumn("cand_pos", F.row_number().over(Window.partitionBy().orderBy("distance", "chunk_id")))
    wanted = s.join(placed.filter("cand_pos <= 40").select("chunk_id"), "chunk_id", "left_semi").select("entity")
    scored = ranking.reciprocal(ranking.signals(placed.join(c.drop("embedding"), "chunk_id"), QUERY_TEXT), overlap=entities.shared_entities(s, wanted))
    return ranking.best(scored, 10).select("rank", "chunk_id", "score")


# --- replicas --------------------------------------------------------------------------------------------------------


def change_log(spark, d) -> DataFrame:
    """Events as changes: record = user, device = user mod 3 by name, clock = event; errors delete."""
    e = table(spark, d, "events")
    return e.select(F.col("user_id").alias("record_id"), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("device"), F.expr("event_id div 2").alias("clock"), "value", (F.col("event_type") == "error").alias("is_deleted"))


def replica(spark, d, which: str) -> DataFrame:
    log = change_log(spark, d).filter(F.col("device") == which)
    rows = log.select(F.col("record_id").alias("id"), F.lit("event").alias("type_name"), F.col("value").cast("string").alias("props"), F.col("clock").alias("sync_clock"), F.col("device").alias("writer"), "is_deleted")
    return objects.latest(rows)


_RECORD = ["id", "sync_clock", "writer", "is_deleted"]


def sync_export_since(spark, d):
    records = replica(spark, d, "d0")
    cut = 200
    delta = sync.export_since(cut, "d0", records, order_edges(spark, d), chunks(spark, d).withColumn("sync_clock", F.col("chunk_id")), spark.createDataFrame([(1, 100), (2, 300)], "chunk_id long, clock long"))
    return delta.groupBy("kind").agg(F.count("*").alias("n"))


def sync_lww_merge(spark, d):
    return sync.merge_records(sync.merge_records(replica(spark, d, "d0"), replica(spark, d, "d1")), replica(spark, d, "d2")).select(_RECORD)


def sync_idempotent(spark, d):
    """Rows in which merging twice differs from merging once: none."""
    one, other = replica(spark, d, "d0"), replica(spark, d, "d1")
    once = sync.merge_records(one, other)
    twice = sync.merge_records(once, other)
    return twice.exceptAll(once).select(_RECORD)


def sync_conflict_stats(spark, d):
    return sync.merge_counts(replica(spark, d, "d0"), replica(spark, d, "d1"))


def sync_tombstones(spark, d):
    """Chunks of even ids are local; all others arrive, but tombstones hold back every third, where their clock reaches."""
    c = texts(spark, d).withColumn("sync_clock", F.col("chunk_id") % 10)
    dead = c.filter("chunk_id % 3 = 0").select("chunk_id", F.lit(5).cast("bigint").alias("clock"))
    return sync.merge_chunks(c.filter("chunk_id % 2 = 0"), c, dead).select("chunk_id", "sync_clock")


def sync_apply_deletes(spark, d):
    """Deletes of toxic documents reach a replica that has all of them; rows that stay come with clock -1."""
    c, none = texts(spark, d).select("chunk_id"), spark.createDataFrame([], "chunk_id long, clock long")
    deletes = table(spark, d, "labels").filter("toxic = 1").select(F.col("doc_id").alias("chunk_id"), F.col("doc_id").alias("clock"))
    kept, tombstones = sync.apply_deletes(c, none, deletes)
    return kept.select("chunk_id", F.lit(-1).cast("bigint").alias("clock")).unionByName(tombstones.select("chunk_id", "clock"))


def sync_lamport(spark, d):
    return change_log(spark, d).groupBy("device").agg(F.max("clock").alias("clock")).unionByName(sync.current_clock((change_log(spark, d), "clock")).select(F.lit("all").alias("device"), "clock"))


def delta_round_trip(spark, d):
    """The records of a delta of all four kinds, written as JSON lines and read again; any row that differs comes with a null id."""
    path = scratch(spark, "delta")
    sent = sync.export_since(100, "d0", replica(spark, d, "d0"), order_edges(spark, d), chunks(spark, d).withColumn("sync_clock", F.col("chunk_id")), spark.createDataFrame([(1, 100), (2, 300)], "chunk_id long, clock long"))
    sync.write_delta(sent, path)
    got = sync.read_delta(spark, path)
    lost = sync.differing(sent, got).select(F.lit(None).cast("bigint").alias("id"), F.lit(None).cast("bigint").alias("sync_clock"), F.col("kind").alias("writer"), F.lit(None).cast("boolean").alias("is_deleted"))
    return got.filter("kind = 'record'").select("record.id", "record.sync_clock", "record.writer", "record.is_deleted").unionByName(lost)


# --- streams ---------------------------------------------------------------------------------------------------------


def _events(spark, d) -> DataFrame:
    e = changes.file_stream(spark, f"{d}/events.parquet")
    return e.withColumn("ts", F.col("ts").cast("timestamp"))


def stream_lww(spark, d):
    e = _events(spark, d)
    log = e.select(F.col("user_id").alias("record_id"), F.concat(F.lit("d"), (F.col("event_id") % 3).cast("string")).alias("device"), F.expr("event_id div 2").alias("clock"), "value", (F.col("event_type") == "error").alias("is_deleted"))
    return changes.stream_lww(log)


def stream_tumbling_events(spark, d):
    out = changes.stream_tumbling(_events(spark, d), "1 day")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_sliding_events(spark, d):
    """Windows of two days that begin every day."""
    out = changes.stream_tumbling(_events(spark, d), "2 days", slide="1 day")
    return out.select(F.unix_timestamp("window_start").alias("window_start"), "event_type", "n", F.round("total", 4).alias("total"))


def stream_session_events(spark, d):
    out = changes.stream_sessions(_events(spark, d), "12 hours")
    return out.select("user_id", F.unix_micros("session_start").alias("session_start"), F.unix_micros("session_end").alias("session_end"), "n")


# --- embeddings ------------------------------------------------------------------------------------------------------

#: Whole texts of an Arrow batch, at most.
TEXT_ROWS = 1024


def letter_vocabulary() -> dict[str, int]:
    """Special tokens, ASCII letters and digits, and each of them inside a word."""
    plain = [chr(c) for c in (*range(48, 58), *range(97, 123))]
    return {t: i for i, t in enumerate(["[PAD]", "[UNK]", "[CLS]", "[SEP]", *plain, *("##" + c for c in plain)])}


def wordpiece_encode(spark, d):
    """Whole texts: no limit of ids."""
    importable(spark)
    arrow_rows(spark, TEXT_ROWS)
    coded = texts(spark, d).select("chunk_id", WordPiece(letter_vocabulary(), None).column(F.col("text"), "input_ids", "actual_length").alias("e"))
    return coded.select("chunk_id", F.col("e.actual_length").alias("n_ids"), F.aggregate("e.input_ids", F.lit(0).cast("bigint"), lambda s, x: s + x).alias("id_sum"))


def hash_embed(spark, d):
    """Whole texts; two components of each unit vector."""
    importable(spark)
    arrow_rows(spark, TEXT_ROWS)
    v = HashEmbedder(letter_vocabulary(), 64, None).column(F.col("text"))
    at = lambda i: F.round(F.get("v", F.lit(i)).cast("double"), 3)
    return texts(spark, d).select("chunk_id", v.alias("v")).select("chunk_id", F.round(V.norm(F.col("v")), 4).alias("norm"), at(0).alias("first"), at(63).alias("last"))


NAMES = """
knn_exact knn_batch knn_radius true_cosine_top vector_norm_check l2_normalize int8_quantize int8_two_stage_knn
knn_difficulty_gap ivf_recall lsh_recall
term_frequencies doc_lengths bm25_idf bm25_search bm25_normalized keyword_jaccard token_estimates
chunk_words chunk_words_min_len chunk_chars_budget ingest_new_docs
hybrid_linear hybrid_rrf hybrid_expanded retrieval_raw retrieval_bm25 vector_only hybrid_no_page page_proximity hybrid_filtered_post hybrid_filtered_pre
context_budget context_string context_words_skip
object_by_property object_list_page object_counts object_latest object_upsert property_index
relation_targets relation_sources relation_edges_distinct relation_cascade_delete relation_edges_removed relation_two_hops
entities_extracted entity_chunks entity_cooccurrence entity_related_2hop kg_expand entity_remove graph_rrf
sync_export_since sync_lww_merge sync_idempotent sync_conflict_stats sync_tombstones sync_apply_deletes sync_lamport delta_round_trip
stream_lww stream_tumbling_events stream_sliding_events stream_session_events
wordpiece_encode hash_embed
""".split()


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: globals()[name] for name in NAMES}


def oracle_sql() -> dict[str, str]:
    return {name: SQL[name] for name in NAMES if name in SQL}

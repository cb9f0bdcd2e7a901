"""One database over the base tables: documents in, queries, objects, relations, and exchange with other replicas."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.session import materialise
from .operators import context, entities, ingest, objects, sync
from .operators.ann import VectorIndex
from .operators.lexical import LexicalIndex
from .operators.retrieval import RetrievalSpec, linked_chunks, retrieve
from .sources.store import Store

#: What the tables of a store hold their clock in.
CLOCKS = {"chunks": "sync_clock", "objects": "sync_clock", "tombstones": "clock"}


class Database:
    """A store, the device that writes to it, and the indexes that follow its tables.

    Every change is stamped with the next tick of the Lamport clock. Changes are plans until `save` commits them and
    reads them back, so plans stay short. Indexes are derived: the lexical and entity ones are built again when they are
    next asked for, a vector index that `follow` was given takes what was added and removed, and `on_change` functions
    are called with the kind of change and its rows.
    """

    def __init__(self, store: Store, device: str, embedder=None):
        self.store, self.device, self.embedder = store, device, embedder
        self.listeners: list[Callable[[str, DataFrame], None]] = []
        self.vectors: VectorIndex | None = None
        self._lexical = self._entities = None
        self.clock = sync.current_clock(*((store.tables[t], c) for t, c in CLOCKS.items())).first()["clock"]

    @classmethod
    def open(cls, spark: SparkSession, path: str, device: str, embedder=None) -> Database:
        return cls(Store.open(spark, path), device, embedder)

    @property
    def tables(self) -> dict[str, DataFrame]:
        return self.store.tables

    def save(self) -> int:
        """Commits a version and goes on from its files."""
        version = self.store.save()
        self.store = Store.open(self.store.spark, self.store.path, version)
        return version

    def follow(self, index: VectorIndex) -> None:
        self.vectors = index

    def on_change(self, listener: Callable[[str, DataFrame], None]) -> None:
        self.listeners.append(listener)

    def _changed(self, kind: str, rows: DataFrame) -> None:
        if kind in ("chunks added", "chunks removed"):
            self._lexical = self._entities = None
            if self.vectors is not None:
                change = self.vectors.upsert if kind == "chunks added" else self.vectors.remove
                self.vectors = change(rows, id_column="chunk_id")
        for listener in self.listeners:
            listener(kind, rows)

    def _tick(self) -> int:
        self.clock = sync.tick(self.clock)
        return self.clock

    # --- chunks ---

    def insert(self, docs: DataFrame, size: int = 200, overlap: int = 40) -> DataFrame:
        """Cuts and embeds documents (doc_id, text) that are not there yet; gives the new chunks."""
        fresh = ingest.new_documents(docs, self.tables["chunks"])
        return self.insert_chunks(ingest.ingest(fresh, self.embedder, size, overlap))

    def insert_chunks(self, chunks: DataFrame) -> DataFrame:
        """Adds chunks (chunk_id, text, embedding, doc_id, page_number); those of an id that is there take its place."""
        clock, own = self._tick(), self.tables["chunks"]
        rows = materialise(chunks.withColumn("sync_clock", F.lit(clock).cast("long")).select(own.columns), "chunks")
        self.tables["chunks"] = ingest.remove_chunks(own, rows).unionByName(rows)
        self._changed("chunks added", rows)
        return rows

    def remove_chunks(self, ids: DataFrame) -> None:
        """Removes chunks (chunk_id) and remembers that at this clock."""
        gone = ids.select("chunk_id", F.lit(self._tick()).cast("long").alias("clock")).distinct()
        self._delete(materialise(gone, "gone"))

    def _delete(self, gone: DataFrame) -> None:
        self.tables["chunks"], self.tables["tombstones"] = sync.apply_deletes(self.tables["chunks"], self.tables["tombstones"], gone)
        self._changed("chunks removed", gone.select("chunk_id"))

    # --- objects and relations ---

    def put(self, changes: DataFrame) -> None:
        """Writes objects (id, type_name, props) whole; tombstones of their ids are lifted."""
        rows = changes.select("id", "type_name", "props", F.lit(self._tick()).cast("long").alias("sync_clock"), F.lit(self.device).alias("writer"), F.lit(False).alias("is_deleted"))
        self.tables["objects"] = self.tables["objects"].join(rows.select("id"), "id", "left_anti").unionByName(rows)
        self._changed("objects", rows)

    def remove_objects(self, ids: DataFrame) -> None:
        """Live objects (id) become tombstones; their relations go."""
        own = self.tables["objects"]
        gone = objects.live(own).join(ids.select("id"), "id", "left_semi")
        dead = gone.withColumns({"sync_clock": F.lit(self._tick()).cast("long"), "writer": F.lit(self.device), "is_deleted": F.lit(True)})
        self.tables["edges"] = objects.without_records(self.tables["edges"], gone)
        self.tables["objects"] = own.join(gone.select("id"), "id", "left_anti").unionByName(dead)
        self._changed("objects", dead)

    def relate(self, edges: DataFrame) -> None:
        self.tables["edges"] = objects.add_edges(self.tables["edges"], edges)
        self._changed("edges", edges)

    # --- queries ---

    def lexical(self) -> LexicalIndex:
        if self._lexical is None:
            self._lexical = LexicalIndex.build(self.tables["chunks"])
        return self._lexical

    def entities(self) -> DataFrame:
        if self._entities is None:
            self._entities = materialise(entities.chunk_entities(self.tables["chunks"]), "entities")
        return self._entities

    def query(self, spec: RetrievalSpec, type_name: str | None = None, relation: str | None = None, name: str | None = None, value: str | None = None) -> DataFrame:
        """The best chunks; with a relation, only those it links with live objects of a type and, maybe, a property."""
        if spec.vector is None and spec.text and self.embedder is not None and spec.mode != "bm25":
            spec = spec.with_vector(map(float, self.embedder.embed(spec.text)), spec.text)
        allowed = None
        if relation is not None:
            allowed = linked_chunks(objects.where(self.tables["objects"], type_name, name, value, limit=None), self.tables["edges"], relation)
        graph = self.entities() if spec.expand or spec.ranker == "graph_rrf" else None
        return retrieve(self.tables["chunks"], spec, self.lexical(), allowed, graph)

    def answer_context(self, spec: RetrievalSpec, **filters) -> DataFrame:
        """One row: the context of a query's results within the budget of its settings."""
        return context.assemble(self.query(spec, **filters), spec.token_budget, spec.token_ratio)

    # --- replicas ---

    def export(self, since: int = 0) -> DataFrame:
        t = self.tables
        return sync.export_since(since, self.device, t["objects"], t["edges"], t["chunks"], t["tombstones"])

    def apply(self, delta: DataFrame) -> dict[str, int]:
        """Takes in another replica's delta: records, edges, chunks, then deletes. Gives records applied and skipped as older."""
        delta = materialise(delta, "delta")
        part = lambda kind: delta.filter(F.col("kind") == kind).select(f"{kind}.*")
        records, chunks, gone, own = part("record"), part("chunk"), part("tombstone"), self.tables
        counts = sync.merge_counts(own["objects"], records).first()
        own["objects"] = sync.merge_records(own["objects"], records)
        own["edges"] = objects.add_edges(own["edges"], part("edge"))
        fresh = materialise(sync.merge_chunks(own["chunks"].limit(0), chunks.join(own["chunks"].select("chunk_id"), "chunk_id", "left_anti"), own["tombstones"]), "fresh")
        own["chunks"] = own["chunks"].unionByName(fresh)
        self._changed("objects", records)
        self._changed("chunks added", fresh)
        self._delete(gone)
        self.clock = sync.observe(self.clock, sync.current_clock((chunks, "sync_clock"), (records, "sync_clock"), (gone, "clock")).first()["clock"])
        return {"records_applied": counts["inserted"] + counts["newer"] + counts["ties_won"], "records_skipped_older": counts["skipped"]}

"""One database from documents to answers, and replicas that exchange deltas through files."""

from seamlight.database import Database
from seamlight.functions.embed import HashEmbedder
from seamlight.operators import sync
from seamlight.operators.ann import VectorIndex
from seamlight.operators.retrieval import RetrievalSpec
from seamlight.sources.store import Store

DOCS = [(1, "The zephyrium alloy datasheet. Ada Lovelace wrote it."), (2, "General metallurgy overview by Ada Lovelace."), (3, "Introduction to cooking.")]


def database(spark, path, device="a"):
    return Database.open(spark, str(path), device, HashEmbedder(dim=16))


def ids(df, column="chunk_id"):
    return sorted(r[0] for r in df.select(column).collect())


def test_documents_to_answers(spark, tmp_path):
    db, seen = database(spark, tmp_path / "db"), []
    db.on_change(lambda kind, rows: seen.append((kind, rows.count())))
    docs = spark.createDataFrame(DOCS, "doc_id long, text string")
    chunks = db.insert(docs).select("chunk_id", "doc_id").collect()
    assert len(chunks) == 3 and db.insert(docs).count() == 0  # known documents are skipped
    of = {r["doc_id"]: r["chunk_id"] for r in chunks}
    best = lambda **k: [r["chunk_id"] for r in db.query(RetrievalSpec(text="zephyrium alloy", **k)).orderBy("rank").collect()]
    assert best(mode="bm25") == [of[1]] and of[1] in best() and "zephyrium" in db.answer_context(RetrievalSpec(text="zephyrium", mode="bm25")).first()["context"]
    assert best(mode="bm25", top_k=1, expand=True) == [of[1], of[2]]  # both name Lovelace
    raw = db.query(RetrievalSpec(text="zephyrium alloy", ranker="none")).collect()
    assert all(r["score"] == r["cosine_score"] and r["keyword_score"] == 0 for r in raw)

    db.put(spark.createDataFrame([(7, "Topic", '{"name": "metal"}')], "id long, type_name string, props string"))
    db.relate(spark.createDataFrame([("about", 7, of[2])] * 2, "relation string, from_id long, to_id long"))
    found = db.query(RetrievalSpec(text="overview"), type_name="Topic", relation="about", name="name", value="metal")
    assert ids(found) == [of[2]]
    db.remove_objects(spark.createDataFrame([(7,)], "id long"))
    assert db.tables["edges"].count() == 0 and db.query(RetrievalSpec(text="overview"), type_name="Topic", relation="about").count() == 0
    assert {k for k, _ in seen} == {"chunks added", "objects", "edges"}

    db.remove_chunks(spark.createDataFrame([(of[1],)], "chunk_id long"))
    assert best(mode="bm25") == [] and db.save() == 1
    again = database(spark, tmp_path / "db")
    assert ids(again.tables["chunks"]) == sorted([of[2], of[3]]) and again.clock == db.clock > 0


def chunk_rows(spark, *rows):
    return spark.createDataFrame([(i, t, [1.0, 0.0], 1, i) for i, t in rows], "chunk_id long, text string, embedding array<float>, doc_id long, page_number long")


def test_replicas_converge_through_files(spark, tmp_path):
    a, b = (Database(Store(spark, str(tmp_path / x)), x) for x in "ab")
    a.follow(VectorIndex.build(chunk_rows(spark, (99, "first")), str(tmp_path / "vectors"), id_column="chunk_id"))
    a.insert_chunks(chunk_rows(spark, (1, "alpha"), (2, "beta"), (4, "doomed")))
    b.insert_chunks(chunk_rows(spark, (3, "gamma")))
    props = lambda v: spark.createDataFrame([(5, "T", v)], "id long, type_name string, props string")
    a.put(props("from a"))
    b.put(props("from b"))
    b.put(props("from b, again"))
    a.relate(spark.createDataFrame([("r", 5, 1)], "relation string, from_id long, to_id long"))

    def send(one, other, n):
        sync.write_delta(one.export(), str(tmp_path / f"delta{n}"))
        return other.apply(sync.read_delta(spark, str(tmp_path / f"delta{n}")))

    assert send(a, b, 1) == {"records_applied": 0, "records_skipped_older": 1}
    assert send(b, a, 2) == {"records_applied": 1, "records_skipped_older": 0}
    assert send(b, a, 3)["records_applied"] == 0  # nothing new
    b.remove_chunks(spark.createDataFrame([(4,)], "chunk_id long"))
    send(b, a, 4)
    send(a, b, 5)
    for db in (a, b):
        assert ids(db.tables["chunks"]) == [1, 2, 3] and ids(db.tables["tombstones"]) == [4]
        assert db.tables["objects"].first()["props"] == "from b, again" and db.tables["edges"].count() == 1
    assert a.clock == b.clock and ids(a.vectors.rows(), "id") == [1, 2, 3, 99]

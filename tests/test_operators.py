"""Small literal cases of single operators."""

import os

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from seamlight.functions import embed, text, vector
from seamlight.operators import context, entities, ingest, knn, objects, ranking, sync
from seamlight.operators.lexical import LexicalIndex
from seamlight.operators.retrieval import RetrievalSpec, linked_chunks, retrieve
from seamlight.plans import catalog
from seamlight.sources.store import Store
from seamlight.sources.versions import Conflict, Versions
from seamlight.streaming import changes

SMALL = ["the quick brown fox jumps over the lazy dog", "a fast auburn fox leaps across a sleepy hound", "stock market prices rallied after the announcement", " ".join(["fox"] * 10), "the dog slept"]


def table(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def search(spark, rows, query, k=5):
    index = LexicalIndex.build(table(spark, rows, "chunk_id long, text string"))
    return [r["chunk_id"] for r in index.search(table(spark, [(0, query)], "query_id int, text string"), k).orderBy("rank").collect()]


def test_bm25(spark):
    rows = list(enumerate(SMALL, 1))
    assert search(spark, rows, "brown fox")[0] == 1 and 3 not in search(spark, rows, "brown fox")
    assert search(spark, rows, "quick brown fox")[0] == 1
    assert 1 not in search(spark, rows[1:], "brown fox")
    assert search(spark, [*rows, (6, "the the the the announcement")], "announcement")[0] in (3, 6)
    assert search(spark, rows, "") == [] and search(spark, [(1, None)], "fox") == []


def hot(at, dim=8):
    return [1.0 if i == at else 0.0 for i in range(dim)]


QUERY = tuple(0.9 if i == 0 else 0.436 if i == 1 else 0.0 for i in range(8))
CHUNK = "chunk_id long, text string, embedding array<float>, doc_id long, page_number long"


def modes(spark):
    return table(spark, [(1, "the zephyrium alloy datasheet", hot(7), 1, 0), (2, "general metallurgy overview", hot(0), 1, 1), (3, "introduction to materials science", hot(0), 1, 2)], CHUNK)


def test_modes(spark):
    c = modes(spark)
    ids = lambda **k: [r["chunk_id"] for r in retrieve(c, RetrievalSpec(text="zephyrium alloy", vector=QUERY, **k)).orderBy("rank").collect()]
    assert 1 in ids(top_k=3) and 1 not in ids(top_k=2, mode="vector")
    found = retrieve(c, RetrievalSpec(text="zephyrium datasheet", top_k=2, mode="bm25"))
    assert found.orderBy("rank").first()["chunk_id"] == 1
    assert "zephyrium" in context.assemble(found).first()["context"]
    assert retrieve(c, RetrievalSpec(text="x")).count() == 0  # no vector


def fusion(spark, distances):
    texts = ["unrelated wording entirely", "neural network training guide", "completely different subject matter"]
    rows = [(i + 1, i + 1, float(d), t, 1, 3) for i, (d, t) in enumerate(zip(distances, texts))]
    return ranking.signals(table(spark, rows, "chunk_id long, cand_pos int, distance double, text string, doc_id long, page_number long"), "neural network training")


def order(df, k=3):
    return [r["chunk_id"] for r in ranking.best(df, k).orderBy("rank").collect()]


def test_fusion(spark):
    wide, close = fusion(spark, (0.05, 0.40, 0.45)), fusion(spark, (0.05, 0.07, 0.09))
    assert order(ranking.linear(wide))[0] == 1 and order(ranking.linear(close))[0] == 2
    assert order(ranking.reciprocal(wide)) == order(ranking.reciprocal(close))
    equal = fusion(spark, (0.10, 0.10, 0.10))
    shared = table(spark, [(2, 1)], "chunk_id long, shared long")
    assert order(ranking.reciprocal(equal, overlap=shared))[0] == 2 and len(order(ranking.reciprocal(equal))) == 3


def test_filter_is_authoritative(spark):
    c, none = modes(spark), table(spark, [], "chunk_id long")
    for mode in ("post", "pre"):
        assert retrieve(c, RetrievalSpec(text="alloy", vector=QUERY, filter_mode=mode), allowed=none).count() == 0
    edges = table(spark, [("about", 9, 1), ("about", 2, 9), ("other", 9, 3)], "relation string, from_id long, to_id long")
    assert {r[0] for r in linked_chunks(table(spark, [(9,)], "id long"), edges, "about").collect()} == {1, 2}


@pytest.mark.parametrize("pair,want", [(("hello world", "hello world"), 1.0), (("cat dog", "airplane boat"), 0.0), (("machine learning model", "deep learning algorithm"), 0.2), ((None, "a"), 0.0)])
def test_keyword_overlap(spark, pair, want):
    df = table(spark, [pair], "a string, b string")
    assert df.select(text.keyword_overlap(text.keyword_terms(F.col("a")), text.keyword_terms(F.col("b")))).first()[0] == pytest.approx(want)


def test_chunkers(spark):
    words = " ".join(f"word{i}" for i in range(1, 21))
    docs = table(spark, [("a", words), ("b", "one short sentence"), ("c", None), ("d", "  ")], "doc_id string, text string")
    got = ingest.chunked(docs, 5, 2).orderBy("doc_id", "chunk_index").collect()
    mine = [r["text"].split() for r in got if r["doc_id"] == "a"]
    assert len(mine) == 7 and all(x[-2:] == y[:2] for x, y in zip(mine, mine[1:]) if len(x) == 5)
    assert [r["chunk_index"] for r in got if r["doc_id"] == "b"] == [0] and not [r for r in got if r["doc_id"] in "cd"]
    assert ingest.chunked(docs, 5, 2, least_chars=20).filter("doc_id = 'a'").count() == 6
    with pytest.raises(ValueError):
        text.word_windows(F.col("text"), 5, 5)


def test_context_cut(spark):
    rows = table(spark, [(1, 1, "x" * 100, 0), (2, 2, "é" * 200, 1), (3, 3, "z", 2)], "rank int, chunk_id long, text string, page_number int")
    whole = context.assemble(rows).first()
    assert not whole["truncated"] and whole["context"].startswith("[Page 0] xxx")
    cut = context.assemble(rows, 60).first()
    assert cut["truncated"] and cut["context"].endswith("\n[Context truncated for length]") and "é" in cut["context"] and "�" not in cut["context"]
    scored = rows.withColumn("score", F.lit(0.5))
    assert "[1] (score: 0.500) xxx" in context.assemble_words(scored).first()["context"]


def test_vectors(spark):
    df = table(spark, [([3.0, 4.0], [0.0, 0.0])], "a array<float>, z array<float>")
    row = df.select(vector.l2_normalize(F.col("a")).alias("n"), vector.l2_normalize(F.col("z")).alias("zero"), vector.int8_scale(F.col("z")).alias("s"), vector.int8_codes(F.col("a"), vector.int8_scale(F.col("a"))).alias("c")).first()
    assert row["n"] == pytest.approx([0.6, 0.8]) and row["zero"] == [0, 0] and row["s"] == 1 and row["c"] == [95, 127]
    assert df.select(F.crc32(F.lit("123456789"))).first()[0] == 0xCBF43926


def test_exact_and_batch_agree(spark):
    import numpy as np

    rng = np.random.default_rng(42)
    x = rng.standard_normal((300, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    v = table(spark, [(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    q = v.filter("vec_id < 20").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("vector"))
    many = knn.nearest_many(v, q, 3)
    for i in (0, 7):
        one = [tuple(r) for r in knn.nearest(v, x[i].tolist(), 3).collect()]
        assert one == [(r["vec_id"], r["distance"]) for r in many.filter(f"query_id = {i}").orderBy("rank").collect()] and one[0][0] == i
    assert knn.nearest_many(v, q, 3, include_self=False).filter("query_id = vec_id").count() == 0
    few = many.filter("rank = 1").withColumnRenamed("vec_id", "id")
    assert knn.recall(knn.checked(few, many.withColumnRenamed("vec_id", "id")), many.withColumnRenamed("vec_id", "id"), "id").first()[0] == 1


def test_entities():
    found = {e["text"]: e for e in entities.extract("The system uses BERT and MiniLM. John Smith wrote about BERT.", ["system"])}
    assert found["bert"]["confidence"] == 0.75 and found["system"]["type"] == "TECHNICAL_TERM" and "minilm" in found and "smith" in found
    assert entities.extract(None) == [] and entities.extract("She is Dr. The") == []


@settings(max_examples=3, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.lists(st.sampled_from(["the", "The", "BERT", "Ada", "Lovelace-", "'Ada", "x", "X", "42", "é", "Dr", ". ", "! ", " ", ", ", "\n", "minilm"]), max_size=25).map(" ".join), min_size=30, max_size=60))
def test_entities_in_the_jvm_agree(spark, rows):
    df = table(spark, [*enumerate(rows), (999, None)], "chunk_id long, text string")
    for terms in ((), ("minilm", "ada")):
        got = {(r["chunk_id"], r["entity"], r["type"], r["confidence"]) for r in entities.extracted(df, terms).collect()}
        assert got == {(i, e["text"], e["type"], e["confidence"]) for i, t in enumerate(rows) for e in entities.extract(t, terms)}


def test_entity_graph(spark):
    e = table(spark, [(1, "a"), (1, "b"), (2, "b"), (2, "c"), (3, "c"), (4, "a"), (4, "c")], "chunk_id long, entity string")
    pairs = entities.cooccurrence(e)
    start = table(spark, [("a",)], "entity string")
    assert {r[0] for r in entities.related(start, pairs, 1).select("entity").collect()} == {"b", "c"}
    got = entities.expand(table(spark, [(1, 1)], "rank int, chunk_id long"), e).orderBy("rank").collect()
    assert [r["chunk_id"] for r in got] == [2, 4, 3]
    assert entities.remove_chunks(e, table(spark, [(1,)], "chunk_id long")).filter("entity = 'b'").count() == 1


def test_objects(spark):
    rows = [(i, "User", f'{{"name": "{"Alice" if i < 5 else "Bob"}", "index": {i}, "ok": true}}', 1, "a", False) for i in range(10)] + [(10, "User", "broken", 1, "a", False)]
    o = table(spark, rows, objects.OBJECTS)
    assert objects.where(o, "User", "name", "Alice").count() == 5 and objects.where(o, "User", "index", "7").count() == 1
    assert objects.where(o, "User", "ok", "true").count() == 0 and objects.where(o, "User", limit=3, offset=9).count() == 2
    assert objects.property_index(o).count() == 20
    edges = table(spark, [("knows", 1, 2), ("knows", 3, 4), ("knows", 1, 2)], "relation string, from_id long, to_id long")
    gone, rest = objects.remove(o, edges, table(spark, [(2,), (99,)], "id long"))
    assert objects.counts(gone).first()["n"] == 10 and rest.count() == 1 and objects.distinct_edges(edges).count() == 2
    again, _ = objects.remove(gone, edges, table(spark, [(2,)], "id long"))
    assert again.filter("id = 2").first()["sync_clock"] == 2
    back = objects.upsert(gone, table(spark, [(2, "User", '{"name": "Eve"}')], "id long, type_name string, props string"))
    assert back.filter("id = 2 and not is_deleted and sync_clock = 3").count() == 1
    got = objects.get(o, table(spark, [(1,), (10,)], "id long")).collect()
    assert len(got) == 1 and '"_type":"User"' in got[0]["props"] and '"index": 1' in got[0]["props"]


record = st.tuples(st.integers(0, 3), st.sampled_from("ab"), st.integers(0, 3), st.booleans())


@settings(max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(record, max_size=6), st.lists(record, max_size=6))
def test_merge_converges(spark, one, other):
    def made(rows):
        return objects.latest(table(spark, [(i, "t", f"{i}{w}{c}{d}", c, w, d) for i, w, c, d in rows], objects.OBJECTS))

    a, b = made(one), made(other)
    ab, ba = sorted(map(tuple, sync.merge_records(a, b).collect())), sorted(map(tuple, sync.merge_records(b, a).collect()))
    assert ab == ba == sorted(map(tuple, sync.merge_records(sync.merge_records(a, b), b).collect()))


def test_replicas(spark, tmp_path):
    chunk = "chunk_id long, text string, embedding array<float>, doc_id long, page_number long, sync_clock long"
    a = table(spark, [(1, "alpha", [1.0], 1, 0, 1), (2, "beta", [1.0], 1, 0, 2)], chunk)
    b = table(spark, [(9, "gamma", [1.0], 1, 0, 1)], chunk)
    none = table(spark, [], "chunk_id long, clock long")
    assert sync.merge_chunks(a, b, none).count() == sync.merge_chunks(b, a, none).count() == 3
    left, dead = sync.apply_deletes(a, none, table(spark, [(1, 5)], "chunk_id long, clock long"))
    assert left.count() == 1 and sync.merge_chunks(left, a, dead).count() == 1
    delta = sync.export_since(0, "A", table(spark, [], objects.OBJECTS), table(spark, [("r", 1, 2)], "relation string, from_id long, to_id long"), a, dead)
    path = f"file://{tmp_path}/delta"
    sync.write_delta(delta, path)
    assert sync.read_delta(spark, path).groupBy("kind").count().count() == 3
    (tmp_path / "delta" / "part-x.txt").write_text("{broken\n")
    assert sync.read_delta(spark, path).count() == 0
    assert sync.device_hash("A") != sync.device_hash("B") and sync.observe(3, 5) == 5 and sync.tick(5) == 6


def test_store(spark, tmp_path):
    path = f"file://{tmp_path}/db"
    with Store.open(spark, path) as store:
        store.tables["edges"] = table(spark, [("r", 1, 2)], "relation string, from_id long, to_id long")
    again = Store.open(spark, path)
    assert {r["table_name"]: r["n"] for r in again.stats().collect()} == {"chunks": 0, "objects": 0, "edges": 1, "tombstones": 0}
    assert again.save() == 2 and Store.versions(spark, path) == [1, 2]


def test_word_pieces():
    vocabulary = embed.load_vocabulary(["[PAD]", "[UNK]", "[CLS]", "[SEP]", "hello", "world", "cafe", "naive", "un", "##able", "", "foo"])
    coder = embed.WordPiece(vocabulary, 8)
    assert vocabulary["foo"] == 11 and coder.encode("hello world") == ([2, 4, 5, 3, 0, 0, 0, 0], 4)
    assert coder.encode("Café naïve unable 中文")[0][:7] == [2, 6, 7, 8, 9, 1, 3] and coder.encode(None)[1] == 2


def test_hash_embedding():
    import numpy as np

    for e in (embed.HashEmbedder(dim=16), embed.HashEmbedder({"[CLS]": 0, "a": 1}, 16)):
        assert np.linalg.norm(e.embed("a text")) == pytest.approx(1) and e.embed("")[0] == 1 and (e.embed("a") == e.embed("a")).all()


def test_long_words_and_whole_texts():
    vocabulary = {"[PAD]": 0, "[UNK]": 1, "[CLS]": 2, "[SEP]": 3, "a": 4, "##a": 5, "É": 6, "é": 7, "?": 8}
    ids, n = embed.WordPiece(vocabulary, None).encode("a" * 200_000 + " z")
    assert n == len(ids) == 200_003 and ids[:3] == [2, 4, 5] and ids[-2:] == [1, 3]
    coder = embed.UnicodeWordPiece(vocabulary, 8)
    assert coder.encode("É?aa " + "a" * 101) == ([2, 7, 8, 4, 5, 1, 3, 0], 7) and coder.encode(None)[1] == 2


def test_hash_embedding_by_plain_loops():
    import hashlib
    import math

    def unit(v):
        length = math.sqrt(sum(x * x for x in v))
        return [x / length for x in v] if length > 1e-8 else v

    for words in (["b", "a", "b"], ["zwölf"] * 5000, []):
        want = [sum((((int(hashlib.sha256(w.encode()).hexdigest(), 16) ^ d * 2654435761 ^ i * 40503) & 0xFFFF) - 32768) / 32768 for i, w in enumerate(words)) / max(1, len(words)) for d in range(5)]
        assert embed.WordHashEmbedder(5).embed(" ".join(words).upper()) == pytest.approx(unit(want))
    for t in ("", "hello", "\U0001F600 é" * 50):
        seed = 0
        for i in range(0, len(raw := t.encode("utf-16-be")), 2):
            seed = (seed * 31 + raw[i] * 256 + raw[i + 1]) & 0xFFFFFFFF
        seed -= (seed >> 31) << 32
        want = [((((seed * 6364136223846793005 + 1442695040888963407) & (2**64 - 1)) ^ d) & 0xFFFFF) / 0xFFFFF * 2 - 1 for d in range(7)]
        assert embed.SeededEmbedder(7).embed(t) == pytest.approx(unit(want))
    body, wide = "long text " * 3000, 2**64
    want = []
    for d in range(3):
        total = 0
        for i, c in enumerate(body.encode()):
            h = (c * 2654435761 + d * 40503 + i * 1000003) % wide
            total += ((((h ^ (h >> 16)) * 0x45D9F3B) % wide & 0xFFFF) - 32768) / 32768
        want.append(total / len(body))
    assert embed.HashEmbedder(dim=3).embed(body) == pytest.approx(unit(want))


def test_tumbling_stream_of_many_files(spark, tmp_path):
    """More files than one micro-batch reads, the latest first: no row is late."""
    day, files = 86_400, 130
    (tmp_path / "events.parquet").mkdir()
    for i in range(files):
        stamps = pa.array([(files - i) * day * 10**6 + 5, (files - i) // 2 * day * 10**6], pa.timestamp("us"))
        path = tmp_path / "events.parquet" / f"part-{i:05}.parquet"
        pq.write_table(pa.table({"event_id": [2 * i, 2 * i + 1], "ts": stamps, "user_id": [1, 2], "event_type": ["a", "a"], "value": [1.0, 2.0], "props": ["", ""]}), path)
        os.utime(path, (10**9 + i, 10**9 + i))  # files are taken by age
    want: dict[int, tuple[int, float]] = {}
    for i in range(files):
        for at, value in (((files - i) * day, 1.0), ((files - i) // 2 * day, 2.0)):
            n, total = want.get(at, (0, 0.0))
            want[at] = n + 1, total + value
    got = {r["window_start"]: (r["n"], r["total"]) for r in catalog.stream_tumbling_events(spark, str(tmp_path)).collect()}
    assert got == want and sum(n for n, _ in got.values()) == 2 * files


def test_delta_holds_every_kind(spark, sf, monkeypatch):
    """All four kinds are written, and a text or an edge that does not come back is seen."""
    read, kinds = sync.read_delta, {}

    def damaged(session, path):
        rows = read(session, path)
        kinds.update({r["kind"]: r["count"] for r in rows.groupBy("kind").count().collect()})
        return rows.filter("kind <> 'edge'").withColumn("chunk", F.when(F.col("chunk").isNotNull(), F.col("chunk").withField("text", F.lit(""))))

    edges = catalog.order_edges(spark, sf).count()
    monkeypatch.setattr(sync, "read_delta", damaged)
    lost = {r["writer"]: r["count"] for r in catalog.delta_round_trip(spark, sf).filter("id is null").groupBy("writer").count().collect()}
    assert set(kinds) == {"record", "edge", "chunk", "tombstone"} and kinds["edge"] == edges
    assert lost == {"edge": edges, "chunk": 2 * kinds["chunk"]}


def test_two_writers_of_a_version(spark, tmp_path):
    """Two that opened the same version: one saves, the other is told, and nothing of the first is lost."""
    path = f"file://{tmp_path}/db"
    one, other = Store.open(spark, path), Store.open(spark, path)
    edge = "relation string, from_id long, to_id long"
    one.tables["edges"], other.tables["edges"] = table(spark, [("r", 1, 2)], edge), table(spark, [("r", 3, 4)], edge)
    assert one.save() == 1
    with pytest.raises(Conflict):
        other.save()
    assert [r["from_id"] for r in Store.open(spark, path).tables["edges"].collect()] == [1]
    again = Store.open(spark, path)
    again.tables["edges"] = again.tables["edges"].unionByName(other.tables["edges"])
    assert again.save() == 2 and Store.open(spark, path).tables["edges"].count() == 2 and Store.open(spark, path, 1).tables["edges"].count() == 1


def test_versions_publish_once(spark, tmp_path):
    """Both writers are past every look at what is there when they publish."""
    known = Versions(spark, f"file://{tmp_path}/v")
    folders = [known.new_folder() for _ in range(2)]
    assert known.publish(folders[0], 1) == 1
    with pytest.raises(Conflict):
        known.publish(folders[1], 1)
    assert known.folder(1) == folders[0] and known.numbers() == [1] and known.folder(2) is None


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60), st.integers(5, 60))
def test_chunk_bounds_rule(sizes, most):
    """Each chunk fits or is as short as it must be, could not be longer, and a fifth of its words comes again."""
    bounds = text.chunk_bounds(sizes, most)
    long = lambda a, b: sum(sizes[a:b]) + b - a
    assert bool(bounds) == bool(sizes) and (not bounds or bounds[0][0] == 0 and bounds[-1][1] == len(sizes))
    before = 0
    for i, (a, b) in enumerate(bounds):
        assert b > before and (long(a, b) <= most or b == before + 1) and (b == len(sizes) or long(a, b + 1) > most)
        if i:
            p, q = bounds[i - 1]
            assert a == q - max(1, (q - p) // 5)
        before = b


def test_repeated_remote_chunks_agree(spark):
    """Whatever the order of rows, replicas take the same of several versions of a chunk."""
    rows = [(1, t, [0.5], 1, 0, c) for t, c in (("b", 2), ("a", 2), ("z", 1))]
    none = table(spark, [], "chunk_id long, clock long")
    chunk = "chunk_id long, text string, embedding array<float>, doc_id long, page_number long, sync_clock long"
    for turn in (rows, rows[::-1]):
        got = sync.merge_chunks(table(spark, [], chunk), table(spark, turn, chunk).repartition(3), none).collect()
        assert [(r["text"], r["sync_clock"]) for r in got] == [("b", 2)]


def test_late_events(spark, tmp_path):
    """With a watermark an event that comes later than allowed is lost; without one it counts."""
    day = 86_400 * 10**6
    (tmp_path / "events").mkdir()
    for i, at in enumerate((10, 12, 1)):  # the watermark of a batch holds back rows from the next but one
        path = tmp_path / "events" / f"part-{i}.parquet"
        pq.write_table(pa.table({"ts": pa.array([at * day], pa.timestamp("us", "UTC")), "event_type": ["a"], "value": [1.0]}), path)
        os.utime(path, (10**9 + i, 10**9 + i))
    stream = lambda: changes.file_stream(spark, f"file://{tmp_path}/events", 1)
    starts = lambda df: sorted(r["window_start"].timestamp() // 86_400 for r in df.collect())
    assert starts(changes.stream_tumbling(stream(), "1 day")) == [1, 10, 12]
    assert starts(changes.stream_tumbling(stream(), "1 day", late="2 days")) == [10, 12]

"""What a task holds and what a shuffle carries stay within bounds that do not grow with the square of the input."""

import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.classic.dataframe import DataFrame

from seamlight.operators import ann, knn


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture
def kernels(monkeypatch):
    """The functions that go to mapInArrow from now on."""
    found, plain = [], DataFrame.mapInArrow
    monkeypatch.setattr(DataFrame, "mapInArrow", lambda self, f, *a, **k: found.append(f) or plain(self, f, *a, **k))
    return found


def unit(n, dim=16, seed=42):
    x = np.random.default_rng(seed).standard_normal((n, dim))
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def frames(spark, x, q):
    v = spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(x)], "vec_id long, embedding array<double>")
    return v, spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(q)], "query_id long, vector array<double>")


def brute(x, q, k):
    d = np.floor((1.0 - q @ x.T) * 1e6 + 0.5) / 1e6
    return [[(int(i), float(row[i])) for i in np.lexsort((np.arange(len(x)), row))[:k]] for row in d]


def by_rank(df, column):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r[column], r["distance"]))
    return [out[i] for i in sorted(out)]


def test_batch_neighbours_hold_few_scores(spark, kernels):
    """3,000 queries meet 8,000 vectors: all scores of a batch would take 98 MB, and were held several times over."""
    x, q = unit(8000), unit(3000, seed=7)
    v, asked = frames(spark, x[:10], q)
    knn.nearest_many(v, asked, 5)
    column = lambda m: pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1) * 16, pa.int32()), pa.array(m.ravel()))
    batches = [pa.RecordBatch.from_arrays([pa.array(np.arange(i, i + 4000)), column(x[i : i + 4000])], names=["id", "vector"]) for i in (0, 4000)]
    tracemalloc.start()
    rows = pa.Table.from_batches(kernels[-1](iter(batches))).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 120e6
    got = {}
    for r in rows:
        got.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    assert [got[i] for i in range(3000)] == brute(x, q, 5)


def test_batch_neighbours_of_equal_vectors(spark, monkeypatch):
    """Ties go to the smaller ids, over all blocks of scores, rounds of queries and tasks."""
    monkeypatch.setattr(knn, "SCORES", 64)
    monkeypatch.setattr(knn, "ROUND_QUERIES", 7)
    x = np.repeat(unit(20), 9, 0)
    v, asked = frames(spark, x, x[::9])
    assert by_rank(knn.nearest_many(v.repartition(3), asked, 5), "vec_id") == brute(x, x[::9], 5)


def test_lsh_makes_no_row_of_a_pair(spark):
    x = unit(400)
    v, asked = frames(spark, x, x[:50])
    found = knn.nearest_lsh(v, asked, 5, bucket=0.3, tables=2)
    assert "Join" not in plan(found)
    want = brute(x, x[:50], 400)
    for mine, (who, true) in zip(by_rank(found, "id"), enumerate(want)):
        assert mine[0][0] == who and len(mine) == 5 and set(mine) <= set(true) and mine == [p for p in true if p in mine]
    wide = knn.nearest_lsh(v, asked, 5, bucket=100.0, tables=16)
    assert by_rank(wide, "id") == brute(x, x[:50], 5)


def test_lists_are_read_where_they_lie(spark, tmp_path, monkeypatch):
    """Neither vectors nor queries are shuffled to their lists, of which a query reads many."""
    monkeypatch.setattr(ann, "ROUND_PROBES", 100)
    x = unit(300)
    v, asked = frames(spark, x, x[:40])
    index = ann.VectorIndex.build(v, str(tmp_path / "i"))
    found = index.search(asked, 5, 1000)
    assert "CoGroup" not in plan(found)
    single = np.float32(x).astype(float)
    assert by_rank(found, "id") == brute(single, single[:40], 5)
    assert index.search(asked.filter("query_id < 0"), 5, 3).count() == 0
    few = index.search(asked, 5, 2)
    assert few.count() == 200 and knn.recall(few, found, "id").first()[0] < 1


def test_encodings_leave_in_parts(spark, monkeypatch):
    """400 texts of 20,000 letters: the ids of all take 64 MB a field, and a worker holds some of them only."""
    import pyspark.sql.functions as F

    from seamlight.functions import embed
    from seamlight.plans.catalog import letter_vocabulary

    kept = []
    for name in ("arrow_udf", "pandas_udf"):
        monkeypatch.setattr(embed.F, name, lambda f, kind, make=getattr(F, name): kept.append(f) or make(f, kind))
    embed.WordPiece(letter_vocabulary(), None).column(F.lit(""))
    text, parts, most = pa.array(["abcde " * 4000] * 400), [], 0
    tracemalloc.start()
    for part in kept[0](iter([text])):
        parts.append(part.field("actual_length").to_pylist())
        most = max(most, tracemalloc.get_traced_memory()[1] + pa.total_allocated_bytes())
    tracemalloc.stop()
    assert sum(parts, []) == [20_002] * 400 and len(parts) > 4 and most < 80e6


def test_encodings_of_both_ways_agree(spark):
    from pyspark.sql import functions as F

    from seamlight.functions import embed
    from seamlight.plans.catalog import letter_vocabulary

    texts = [None, "", " ", "Ab-c é çA x" * 30, "word " * 50, "中 a", "\t?\n"]
    for most in (None, 2, 8):
        coder = embed.WordPiece(letter_vocabulary(), most)
        df = spark.createDataFrame(list(enumerate(texts)), "i int, t string").select("i", coder.column(F.col("t")).alias("e"))
        for r in df.collect():
            ids, n = coder.encode(texts[r["i"]])
            assert r["e"]["input_ids"] == ids and r["e"]["actual_length"] == n and r["e"]["attention_mask"] == [1] * n + [0] * (len(ids) - n) and set(r["e"]["token_type_ids"]) <= {0}
    slow = embed.WordPiece(letter_vocabulary(), None)
    slow.letters = None
    assert all(slow.encode(t) == embed.WordPiece(letter_vocabulary(), None).encode(t) for t in texts)


def test_long_texts_are_cut_between_words(monkeypatch):
    from seamlight.functions import embed
    from seamlight.plans.catalog import letter_vocabulary

    text = "ab-c d\te,f\n" * 50 + "x" * 40 + " end"
    whole = embed.WordPiece(letter_vocabulary(), None).encode(text)
    monkeypatch.setattr(embed, "_BLOCK_CHARACTERS", 5)
    assert embed.WordPiece(letter_vocabulary(), None).encode(text) == whole


def test_terms_are_counted_within_a_row(spark):
    """Postings and lengths of an index need no shuffle, and a search shuffles its best only."""
    from pyspark.sql import functions as F

    from seamlight.operators.lexical import LexicalIndex

    texts = ["b a b ba", "", None, "ba ba BA x y", "x ab"]
    index = LexicalIndex.build(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    assert "Exchange" not in plan(index.postings) and "Exchange" not in plan(index.lengths())
    assert {tuple(r) for r in index.postings.collect()} == {(0, "ba", 1, 1), (3, "ba", 3, 3), (4, "ab", 1, 1)}
    assert {tuple(r) for r in index.document_frequency().collect()} == {("ba", 2), ("ab", 1)}
    asked = spark.createDataFrame([(7, "ba ab"), (8, "none"), (9, "ab")], "query_id int, text string")
    found = index.search(asked, 2)
    assert "Join" not in plan(found) and found.dtypes[:3] == [("query_id", "int"), ("rank", "int"), ("chunk_id", "bigint")]
    got = [(r["query_id"], r["rank"], r["chunk_id"]) for r in found.orderBy("query_id", "rank").collect()]
    assert got == [(7, 1, 4), (7, 2, 3), (9, 1, 4)]
    only = spark.createDataFrame([(0,), (3,)], "chunk_id long")
    assert [(r["query_id"], r["chunk_id"]) for r in index.search(asked, 1, only).collect()] == [(7, 3)]


def test_search_in_rounds_agrees(spark, monkeypatch):
    from seamlight.operators import lexical

    texts = [f"{'ab ' * (i % 3)}{'cd ' * (i % 5)}{'e' * (2 + i % 2)} w{i % 7}" for i in range(60)]
    index = lexical.LexicalIndex.build(spark.createDataFrame(list(enumerate(texts)), "chunk_id long, text string"))
    asked = spark.createDataFrame([(i, f"ab cd w{i}") for i in range(9)], "query_id long, text string")
    rows = lambda: sorted(tuple(r) for r in index.search(asked, 6).collect())
    want = rows()
    monkeypatch.setattr(lexical, "ROUND_QUERIES", 4)
    monkeypatch.setattr(lexical, "SCORES", 30)
    assert rows() == want and len(want) == 54


def test_entities_are_found_within_a_row(spark):
    from seamlight.operators import entities, ingest

    words = ["the", "Ada", "Lovelace-", "BERT", "x", "42", "é.", "ok!", "\tB2", "\x1cZed", "Dr"]
    texts = [" ".join(words[(i * j + j // 7) % len(words)] for j in range(1, n)) for i, n in enumerate((1, 2, 30, 250, 900))] + [None, " \n"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    whole = entities.extracted(docs.withColumnRenamed("doc_id", "chunk_id"), ("ok",))
    assert "Exchange" not in plan(whole)
    assert {tuple(r) for r in whole.collect()} == {(i, e["text"], e["type"], e["confidence"]) for i, t in enumerate(texts) for e in entities.extract(t, ("ok",))}
    cut = entities.window_entities(docs, 50, 10)
    assert "Exchange" not in plan(cut)
    want = {(r["doc_id"], r["chunk_index"], e["text"]) for r in ingest.chunked(docs, 50, 10).collect() for e in entities.extract(r["text"])}
    assert {tuple(r) for r in cut.collect()} == want and len(want) > 30


def test_related_entities_by_chunks(spark):
    from seamlight.operators import entities

    e = spark.createDataFrame([(c, f"e{x}") for c in range(30) for x in (c, c + 1, c * c % 17)], "chunk_id long, entity string").distinct()
    start = spark.createDataFrame([("e0",), ("e9",), ("none",)], "entity string")
    for hops in (1, 2, 3):
        got = entities.related_by_chunks(start, e, hops)
        assert sorted(map(tuple, got.collect())) == sorted(map(tuple, entities.related(start, entities.cooccurrence(e), hops).collect()))


def test_delta_is_parsed_and_compared_once(spark, tmp_path):
    from seamlight.operators import sync

    schema = "kind string, v struct<a:array<float>,b:string>"
    one = spark.createDataFrame([("x", ([1.0], "p")), ("x", ([1.0], "p")), ("y", (None, "q")), ("z", None)], schema)
    other = spark.createDataFrame([("x", ([1.0], "p")), ("y", (None, None)), ("z", None), ("z", None)], schema)
    assert sorted(r["kind"] for r in sync.differing(one, other).collect()) == ["x", "y", "y", "z"]
    assert sync.differing(one, one.repartition(3)).count() == 0
    shown = plan(sync.differing(one, other))
    assert shown.split("Initial Plan")[0].count("Exchange hashpartitioning") == 1
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "a.txt").write_text('{"kind":"edge","device":"d","edge":{"relation":"r","from_id":1,"to_id":2}}\n')
    got = sync.read_delta(spark, f"file://{tmp_path}/d")
    assert got.count() == 1 and "from_json" not in plan(got)

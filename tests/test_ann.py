"""The approximate index of vectors: recall, what it reads, changes, hot lists, awkward rows."""

import pytest
from pyspark.sql import functions as F

from seamlight.operators import ann, knn
from seamlight.sources.versions import Conflict, Versions

VECTORS = "vec_id long, embedding array<float>"


def by_query(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r["query_id"], []).append((r["id"], r["distance"]))
    return out


@pytest.mark.parametrize("k, target", [(5, 0.968), (10, 0.958)])
def test_recall_while_reading_a_quarter(spark, tmp_path, k, target):
    vectors, queries = ann.clustered_vectors(spark, 20, 40, sigma=0.0375, seed=123, queries=120)
    tuned, asked = queries.filter("query_id < 60"), queries.filter("query_id >= 60")
    index = ann.VectorIndex.build(vectors, str(tmp_path / "i"))
    probes = index.probes_for(tuned, k, 0.99)
    truth = knn.nearest_many(vectors, asked, k).withColumnRenamed("vec_id", "id")
    assert knn.recall(index.search(asked, k, probes), truth, "id").first()[0] >= target
    assert index.share_read(asked, probes).first()[0] <= 0.25


def test_all_lists_are_exact(spark, tmp_path):
    vectors, queries = ann.clustered_vectors(spark, 5, 20, 8, queries=12)
    index = ann.VectorIndex.build(vectors, str(tmp_path / "i"))
    exact = knn.nearest_many(vectors, queries, 4).withColumnRenamed("vec_id", "id")
    assert by_query(index.search(queries, 4, 1000)) == by_query(exact)
    assert by_query(index.search(queries, 4, 1, widen_below=1e9)) == by_query(index.search(queries, 4, 2))
    assert index.share_read(queries, 1000).first()[0] == 1


def test_hot_list_in_small_groups(spark, tmp_path, monkeypatch):
    """A third of the vectors are equal, and so are a third of the queries; groups hold ten or so."""
    monkeypatch.setattr(ann, "CELL", 10)
    vectors, queries = ann.clustered_vectors(spark, 6, 20, 8, queries=40)
    same = F.array(*(F.lit(1.0 if i == 0 else 0.0).cast("float") for i in range(8)))
    vectors = vectors.withColumn("embedding", F.when(F.col("vec_id") % 3 == 0, same).otherwise(F.col("embedding")))
    queries = queries.withColumn("vector", F.when(F.col("query_id") % 3 == 0, same).otherwise(F.col("vector")))
    index = ann.VectorIndex.build(vectors, str(tmp_path / "i"))
    assert by_query(index.search(queries, 7, 1000)) == by_query(knn.nearest_many(vectors, queries, 7).withColumnRenamed("vec_id", "id"))


def test_changes_and_versions(spark, tmp_path):
    path = str(tmp_path / "i")
    vectors, queries = ann.clustered_vectors(spark, 10, 40, 8, queries=10)
    index = ann.VectorIndex.build(vectors, path)
    less = ann.VectorIndex.open(spark, path).remove(vectors.filter("vec_id < 160").unionByName(spark.createDataFrame([(10**9, [0.0])], VECTORS)))
    assert (less.version, less.size(), index.size()) == (2, 240, 400)
    assert less.search(queries, 300, 1000).agg(F.min("id")).first()[0] == 160
    with pytest.raises(Conflict):
        index.remove(vectors)  # still stands on version 1
    # what was removed may come back, and what is there may move
    moved = spark.createDataFrame([(3, [1.0] + [0.0] * 7), (200, [0.0] * 7 + [1.0])], VECTORS)
    more = less.upsert(moved)
    assert more.size() == 241
    asked = spark.createDataFrame([(1, [0.0] * 7 + [1.0]), (2, [1.0] + [0.0] * 7)], "query_id long, vector array<float>")
    assert {q: hits[0] for q, hits in by_query(more.search(asked, 1, 1000)).items()} == {1: (200, 0.0), 2: (3, 0.0)}
    whole = more.compact()
    assert whole.version == 4 and len(whole._of("rows")) == 1 and not whole._of("tombstones")
    assert by_query(whole.search(queries, 5, 1000)) == by_query(more.search(queries, 5, 1000))
    assert whole.compact() is whole
    assert ann.VectorIndex.open(spark, path, 1).size() == 400


def test_damaged_index_is_built_again(spark, tmp_path):
    import shutil

    path = str(tmp_path / "i")
    vectors, _ = ann.clustered_vectors(spark, 3, 10, 4)
    with pytest.raises(FileNotFoundError):
        ann.VectorIndex.open(spark, path)
    first = ann.VectorIndex.recover(vectors, path)
    assert ann.VectorIndex.recover(vectors, path).version == first.version == 1
    shutil.rmtree(first._of("rows")[0][1])
    assert ann.VectorIndex.recover(vectors, path).size() == 30 and Versions(spark, path).latest() == 2


def test_awkward_rows(spark, tmp_path):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, None), (3, [nan, 0.0]), (4, [inf, 0.0]), (5, [None, 0.0]), (6, []), (None, [1.0, 0.0]), (7, [0.0, 1.0])]
    vectors = spark.createDataFrame(rows, VECTORS).withColumn("list", F.lit("clash")).withColumn("n", F.lit(1))
    index = ann.VectorIndex.build(vectors, str(tmp_path / "i"))
    asked = spark.createDataFrame([(1, [1.0, 0.0]), (1, [1.0, 0.0]), (2, None)], "query_id long, vector array<float>")
    assert by_query(index.search(asked, 3, 9)) == {1: [(1, 0.0), (7, 1.0)]}
    with pytest.raises(Exception, match="a vector of 3 components"):
        index.upsert(spark.createDataFrame([(9, [1.0, 0.0, 0.0])], VECTORS))
    none = ann.VectorIndex.build(vectors.limit(0), str(tmp_path / "none"))
    assert none.size() == 0 and none.search(asked, 3).count() == 0
    assert none.upsert(vectors).size() == 2


def test_self_check(spark, tmp_path):
    rows = {r["mode"]: r for r in ann.self_check(spark, str(tmp_path / "i")).collect()}
    assert set(rows) == {"plain", "adaptive"} and rows["plain"]["enabled"] and rows["adaptive"]["recall"] >= rows["plain"]["recall"]

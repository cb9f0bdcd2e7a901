"""Nearest neighbours: exact for one query or many, within a radius, over int8 codes, and approximate by LSH; inverted lists are in `ann`."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vector as V
from ..functions.session import arrow_rows, importable

#: Queries that every task holds at once: 16 MB at 64 components.
ROUND_QUERIES = 32_768
#: Vectors that are multiplied at once.
BLOCK_ROWS = 4096
#: Scores that a task holds at once: 16 MB, and as much again a few times while they are compared.
SCORES = 1 << 21
FOUND = "query_id long, id long, distance double"


def nearest(vectors: DataFrame, query, k: int, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, distance of the k vectors nearest to one query vector; ties go to the smaller id. A vector of another length raises."""
    d = F.round(V.cosine_distance(F.col(vector_column), V.literal(query)), 6)
    return vectors.filter(F.col(vector_column).isNotNull()).select(id_column, d.alias("distance")).orderBy("distance", id_column).limit(k)


def within(vectors: DataFrame, query, radius: float, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """id, distance of all vectors at most `radius` away."""
    d = F.round(V.cosine_distance(F.col(vector_column), V.literal(query)), 6)
    return vectors.select(id_column, d.alias("distance")).filter(F.col("distance") <= radius)


def nearest_many(vectors: DataFrame, queries: DataFrame, k: int, include_self: bool = True, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, id, distance for every row of `queries` (query_id, vector).

    The vectors are dealt to as many tasks as the cluster has cores, twice over, and queries go round in blocks of bounded
    size; each task sends its k best per query only, so the shuffle is tasks times queries times k rows. A task holds SCORES
    scores at once, whatever the numbers of vectors and queries.
    """
    rows = vectors.filter(F.col(vector_column).isNotNull()).select(F.col(id_column).alias("id"), F.col(vector_column).alias("vector"))
    found = _nearest_many(rows, queries, k, include_self)
    return found.select("query_id", "rank", F.col("id").alias(id_column), "distance")


def _nearest_many(rows: DataFrame, queries: DataFrame, k: int, include_self: bool = True) -> DataFrame:
    """query_id, rank, id, distance of rows (id, vector). Where rows and queries also have `codes`, arrays of long of one
    length, only rows that have a code of the query in its place count."""
    import numpy as np

    spark = rows.sparkSession
    importable(spark)
    arrow_rows(spark, BLOCK_ROWS)
    rounds = max(1, -(-queries.count() // ROUND_QUERIES))
    most, out = k + (0 if include_self else 1), None
    kind = rows.schema["id"].dataType.simpleString()
    coded = ["codes"] if "codes" in rows.columns else []
    dealt = rows.select(F.col("id").cast("long").alias("id"), "vector", *coded).repartition(2 * max(1, spark.sparkContext.defaultParallelism), "id")
    for r in range(rounds):
        block = queries.filter(F.pmod(F.xxhash64("query_id"), F.lit(rounds)) == r).select(F.col("query_id").cast("long"), F.col("vector").cast("array<double>"), *coded).toArrow()
        sent = spark.sparkContext.broadcast((np.asarray(block.column(0)), *(_rows_of(c) for c in block.columns[1:])))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, matrix, *codes = sent.value
            best = Best(ids.size, most)
            for batch in batches:
                if not batch.num_rows or not ids.size:
                    continue
                own, (v, *marks) = np.asarray(batch.column(0)), map(_rows_of, batch.columns[1:])
                step = max(1, SCORES // batch.num_rows)
                for start in range(0, ids.size, step):
                    part = slice(start, start + step)
                    scores = matrix[part] @ v.T
                    if codes:
                        scores[~np.logical_or.reduce([q[:, None] == x for q, x in zip(codes[0][part].T, marks[0].T)])] = -np.inf
                    best.add(np.arange(start, start + len(scores)), scores, own)
            yield from best.batches(ids)

        part = dealt.mapInArrow(run, FOUND)
        out = part if out is None else out.unionByName(part)
    if not include_self:
        out = out.filter("id <> query_id")
    return ranked(out, k).select("query_id", "rank", F.col("id").cast(kind).alias("id"), "distance")


def _rows_of(column):
    """The arrays of an Arrow column, all of one length, as rows of a matrix of doubles or longs."""
    import numpy as np

    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = np.asarray(column.flatten())
    return flat.astype(np.int64 if flat.dtype.kind == "i" else np.float64, copy=False).reshape(len(column), -1 if flat.size else 0)


class Best:
    """The k rows of least distance of each of some queries, ties to smaller ids, of all scores that were added."""

    #: A distance is this less a score, rounded.
    at_most = 1.0

    @staticmethod
    def distance(scores):
        import numpy as np

        return np.floor((1.0 - scores) * 1e6 + 0.5) / 1e6

    def __init__(self, queries: int, k: int):
        import numpy as np

        self.k, self.distances, self.ids = k, np.full((queries, k), np.inf), np.full((queries, k), np.iinfo(np.int64).max)

    def add(self, at, scores, own) -> None:
        """Products of the queries numbered `at`, each once, with the rows whose ids are `own`; -inf or NaN for pairs that do not count."""
        import numpy as np

        if not len(at) or not len(own):
            return
        slack = 2e-6  # distances are rounded to six places
        scores[~np.isfinite(scores)] = -np.inf
        last = self.distances[at, -1]
        least = self.at_most - last - slack
        if self.k < len(own) and (new := np.isinf(last)).any():
            least[new] = np.partition(scores[new], -self.k, 1)[:, -self.k] - slack
        q, c = np.nonzero((scores >= least[:, None]) & (scores > -np.inf))
        d, who = self.distance(scores[q, c]), own[c]
        closer = (d < last[q]) | (d == last[q]) & (who < self.ids[at[q], -1])
        q, d, who = q[closer], d[closer], who[closer]
        if not q.size:
            return
        met = np.unique(q)
        q = np.concatenate([np.repeat(met, self.k), q])
        d, who = np.concatenate([self.distances[at[met]].ravel(), d]), np.concatenate([self.ids[at[met]].ravel(), who])
        order = np.lexsort((who, d, q))
        begins = np.searchsorted(q[order], met)
        chosen = order[begins[:, None] + np.arange(self.k)]
        self.distances[at[met]], self.ids[at[met]] = d[chosen], who[chosen]

    def batches(self, queries) -> Iterator[pa.RecordBatch]:
        """FOUND of all queries, whose ids are given."""
        import numpy as np

        for start in range(0, len(queries), BLOCK_ROWS):
            d = self.distances[start : start + BLOCK_ROWS]
            q, j = np.nonzero(np.isfinite(d))
            yield pa.RecordBatch.from_arrays([pa.array(queries[start + q], pa.int64()), pa.array(self.ids[start + q, j], pa.int64()), pa.array(d[q, j], pa.float64())], names=["query_id", "id", "distance"])


def ranked(scored: DataFrame, k: int) -> DataFrame:
    """The k rows of least distance of each query, ties by id."""
    order = Window.partitionBy("query_id").orderBy("distance", "id")
    return scored.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def nearest_int8(vectors: DataFrame, query, k: int, beam: int = 2, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """Two steps: `beam` times k rows by int8 codes, then the k nearest of them by their exact distance."""
    v, q = F.col(vector_column), V.literal(query)
    scale, query_scale = V.int8_scale(v), V.int8_scale(q)
    rough = F.round(V.int8_distance(V.int8_codes(v, scale), scale, V.int8_codes(q, query_scale), query_scale), 6)
    first = vectors.select(id_column, vector_column, rough.alias("rough")).orderBy("rough", id_column).limit(beam * k)
    return nearest(first, query, k, id_column, vector_column)


def difficulty_gap(neighbours: DataFrame) -> DataFrame:
    """query_id, gap: (last - first distance) over the first, at least 1e-6; small gaps call for a wider search."""
    first, last = F.min("distance"), F.max("distance")
    return neighbours.groupBy("query_id").agg(F.round((last - first) / F.greatest(first, F.lit(1e-6)), 6).alias("gap"))


def recall(found: DataFrame, truth: DataFrame, id_column: str = "vec_id") -> DataFrame:
    """One row: the share of true (query_id, id) pairs that were found."""
    hit = truth.select("query_id", id_column).join(found.select("query_id", id_column).distinct().withColumn("_hit", F.lit(1)), ["query_id", id_column], "left")
    return hit.agg(F.round(F.count("_hit") / F.count("*"), 6).alias("recall"))


def nearest_lsh(vectors: DataFrame, queries: DataFrame, k: int, bucket: float = 0.6, tables: int = 8, seed: int = 42, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """query_id, rank, id, distance among the vectors that share a random-projection bucket with the query.

    Wide buckets hold a large part of all vectors, so pairs are never rows: they are met as in `nearest_many`, and those
    without a common bucket do not count.
    """
    from pyspark.ml.feature import BucketedRandomProjectionLSH
    from pyspark.ml.functions import array_to_vector, vector_to_array

    def rows(df: DataFrame, column: str, vector: str) -> DataFrame:
        return df.filter(F.col(vector).isNotNull()).select(F.col(column), F.col(vector).cast("array<double>").alias("vector")).withColumn("features", array_to_vector("vector"))

    known = rows(vectors.withColumnRenamed(id_column, "id"), "id", vector_column)
    model = BucketedRandomProjectionLSH(inputCol="features", outputCol="hashes", bucketLength=bucket, numHashTables=tables, seed=seed).fit(known)
    codes = F.array(*(vector_to_array(F.get("hashes", F.lit(i)))[0].cast("long") for i in range(tables)))

    def keyed(df: DataFrame, column: str) -> DataFrame:
        return model.transform(df).select(column, "vector", codes.alias("codes"))

    return _nearest_many(keyed(known, "id"), keyed(rows(queries, "query_id", "vector"), "query_id"), k)


def checked(approximate: DataFrame, exact: DataFrame, loss: float = 0.01, id_column: str = "id") -> DataFrame:
    """The approximate results if their recall is at most `loss` below 1, else the exact ones."""
    return approximate if recall(approximate, exact, id_column).first()["recall"] >= 1 - loss else exact

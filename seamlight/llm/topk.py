"""Exact top-k by inner product (operator 7): no-random-access aggregation over sorted lists of components."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialise, small_batches

#: Rows whose components are sorted into lists together, and queries that read them together.
BLOCK_ROWS, BLOCK_QUERIES = 4096, 256
#: Parts of a list after which its readers look whether they can stop; 0 stands for the heads alone.
STOPS = (0, 1 / 64, 1 / 16, 1 / 4)
#: Queries of one round, which every task holds: 16 MB at 64 components.
ROUND_QUERIES = 32_768
_NONE = -(2**62)


def quantised(vectors: DataFrame, id_column: str = "vec_id", vector_column: str = "embedding") -> DataFrame:
    """(id, v): floor(256 * x) of each component as a long; rows without id, and null vectors or such with null or non-finite components, are left out."""
    x = F.col(vector_column)
    sound = x.isNotNull() & F.forall(x, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    return vectors.filter(sound & F.col(id_column).isNotNull()).select(F.col(id_column).cast("long").alias("id"), F.transform(x, lambda c: F.floor(256 * c.cast("double"))).alias("v"))


def numbered(rows: DataFrame) -> DataFrame:
    """(row, id, v): each row with a number of its own, written so that it stays the same: ids may come more than once."""
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", "v"), "vectors")


class SortedLists:
    """The components of a block of vectors, one list a component, sorted once and read by all queries.

    A query reads a list from its largest values downwards where its own component is positive, else upwards. What it
    has read of a row adds up; for the rest, the list's far end bounds its score from below, and the value that the list
    has come to from above.
    """

    def __init__(self, block, kind):
        import numpy as np

        self.block = block.astype(kind)
        self.n, self.width = block.shape
        self.order = np.argsort(self.block, axis=0, kind="stable")
        self.values = np.take_along_axis(self.block, self.order, 0)
        self.place = np.empty_like(self.order)
        np.put_along_axis(self.place, self.order, np.arange(self.n)[:, None], 0)
        self.read = 0  # entries that queries have read

    def frontier(self, depth: int):
        """The values that lists have come to after `depth` entries: (downwards, upwards)."""
        at = max(depth, 1) - 1
        return self.values[self.n - 1 - at], self.values[at]

    def bounds(self, depth: int, up, down, least: bool):
        """Scores (rows x queries) of what was met after `depth` entries, the unseen at the frontier or (least) the far ends."""
        import numpy as np

        a, b = (self.values[0], self.values[-1]) if least else self.frontier(depth)
        met_a, met_b = self.place >= self.n - depth, self.place < depth
        return np.where(met_a, self.block - a, 0) @ up.T + np.where(met_b, self.block - b, 0) @ down.T + (up @ a + down @ b)

    def read_on(self, wanted):
        """The vectors of the wanted rows (a mask), from one pass along all lists that keeps these rows' entries."""
        import numpy as np

        slot = np.cumsum(wanted) - 1
        out = np.zeros((int(wanted.sum()), self.width), self.block.dtype)
        keep, column = np.nonzero(wanted[self.order])
        out[slot[self.order[keep, column]], column] = self.values[keep, column]
        return out

    def scan(self, queries, bar, k: int):
        """NRA: (row, query, score) of all that may be among the k best, given scores `bar` to reach (_NONE: none yet).

        All lists are read in step. At each stop a row met in no list can reach the sum of the frontiers at most; once
        that is below the bar, or below the k-th best lower bound where there is no bar, the query stops. Of the rows met,
        those whose upper bound reaches as far are read on to their final scores. Equal scores stay in, as the smaller id
        may win. A query that cannot stop reads its lists to the end.
        """
        import numpy as np

        queries = queries.astype(self.block.dtype)
        up, down, found = np.maximum(queries, 0), np.minimum(queries, 0), []
        active = np.arange(len(queries))
        for depth in sorted({int(self.n * s) for s in STOPS}):
            if not active.size:
                break
            a, b = self.frontier(depth)
            outside = up[active] @ a + down[active] @ b
            best = bar[active].copy()
            fresh = np.flatnonzero(best == _NONE)
            if fresh.size and depth >= k:
                low = self.bounds(depth, up[active[fresh]], down[active[fresh]], True)
                best[fresh] = np.partition(low, self.n - k, axis=0)[self.n - k]
            done = outside < best
            if not done.any():
                continue
            stopped, best = active[done], best[done]
            self.read += stopped.size * depth * self.width
            active = active[~done]
            if depth:
                high = self.bounds(depth, up[stopped], down[stopped], False)
                rows, cols = np.nonzero(high >= best)
                wanted = np.zeros(self.n, bool)
                wanted[rows] = True
                final = (self.read_on(wanted) @ queries[stopped].T)[(np.cumsum(wanted) - 1)[rows], cols]
                self.read += rows.size * self.width
                found.append((rows, stopped[cols], final))
        if active.size:
            self.read += active.size * self.n * self.width
            scores = self.block @ queries[active].T
            best = bar[active].copy()
            if self.n >= k:
                best = np.maximum(best, np.partition(scores, self.n - k, axis=0)[self.n - k])
            rows, cols = np.nonzero(scores >= best)
            found.append((rows, active[cols], scores[rows, cols]))
        if not found:
            return (np.zeros(0, np.int64),) * 3
        rows, cols, scores = (np.concatenate(x) for x in zip(*found))
        return rows, cols, scores.astype(np.int64)


class Best:
    """The k best (score, id) of each query so far; rows and queries are told apart by row numbers, not by id."""

    def __init__(self, query_rows, queries, k: int):
        import numpy as np

        self.own, self.queries, self.k, self.read = query_rows, queries, k, 0
        self.scores, self.ids = np.full((query_rows.size, k), _NONE, np.int64), np.zeros((query_rows.size, k), np.int64)

    def add(self, rows, ids, block) -> None:
        import numpy as np

        width = max(block.shape[1], self.queries.shape[1])
        pad = lambda x: np.pad(x, ((0, 0), (0, width - x.shape[1])))
        block, queries = pad(block), pad(self.queries)
        # sums and differences of these products are exact in floats of so many bits; beyond them, in integers
        most = 2.0 * float(np.abs(block).max(initial=0)) * float(np.abs(queries).max(initial=0)) * max(1, width)
        lists = SortedLists(block, np.float32 if most < 2.0**24 else np.float64 if most < 2.0**53 else np.int64)
        for a in range(0, self.own.size, BLOCK_QUERIES):
            b = min(a + BLOCK_QUERIES, self.own.size)
            # one more than k, as the query's own row may be among the k
            row, query, score = lists.scan(queries[a:b], self.scores[a:b, -1], self.k + 1)
            keep = rows[row] != self.own[a:b][query]
            who, query, score = ids[row[keep]], query[keep], score[keep]
            query = np.concatenate([query, np.repeat(np.arange(b - a), self.k)])
            score = np.concatenate([score, self.scores[a:b].ravel()])
            who = np.concatenate([who, self.ids[a:b].ravel()])
            order = np.lexsort((who, -score, query))
            rank = np.arange(order.size) - np.searchsorted(query[order], query[order])
            top = order[rank < self.k]
            self.scores[a:b], self.ids[a:b] = score[top].reshape(b - a, self.k), who[top].reshape(b - a, self.k)
        self.read += lists.read

    def rows_out(self):
        import numpy as np

        q, j = np.nonzero(self.scores > _NONE)
        return self.own[q], self.ids[q, j], self.scores[q, j]


def _matrix(lists: pa.Array):
    """Vectors as rows of integers, shorter ones filled with zeros."""
    import numpy as np

    size = np.asarray(lists.value_lengths()).astype(np.int64)
    out = np.zeros((size.size, max(1, int(size.max(initial=0)))), np.int64)
    out[np.arange(out.shape[1])[None] < size[:, None]] = np.asarray(lists.flatten())
    return out


def top_k(vectors: DataFrame, asked: str, k: int = 5) -> DataFrame:
    """Operator 7: query_id, rank (from 1), vec_id, score of the k best of the `vectors` (row, id, v) for each of their
    rows that the SQL condition `asked` holds for.

    Rows are told apart by `row` (see `numbered`): of an id that comes more than once, each row is a query and each is a
    candidate of the others. Only a query's own row is no candidate of it; ties go to the smaller id; fewer than k
    candidates give fewer rows; vectors of another length count as if filled with zeros; an empty table or no query gives
    no rows. Scores must fit in 64 bits.

    Queries go round in blocks of bounded size that every task holds, one round after the other, each written and its
    block released; candidates are read in place. A task sends its k best per query only, so a vector that ties with
    thousands of rows costs k rows a task.
    """
    import numpy as np

    spark = vectors.sparkSession
    small_batches(spark)
    queries = vectors.filter(asked)
    rounds = max(1, -(-queries.count() // ROUND_QUERIES))
    out = None
    for r in range(rounds):
        block = queries.filter(F.pmod(F.xxhash64("row"), F.lit(rounds)) == r).select("row", "id", "v").toArrow().combine_chunks()
        column = lambda name: block.column(name).combine_chunks() if block.num_rows else None
        rows, ids, v = (np.asarray(column("row")), np.asarray(column("id")), _matrix(column("v"))) if block.num_rows else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, 1), np.int64))
        sent = spark.sparkContext.broadcast((rows, ids, v))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, query_ids, matrix = sent.value
            best, held = Best(own, matrix, k), []

            def flush():
                width = max(h[2].shape[1] for h in held)
                best.add(np.concatenate([h[0] for h in held]), np.concatenate([h[1] for h in held]), np.concatenate([np.pad(h[2], ((0, 0), (0, width - h[2].shape[1]))) for h in held]))
                held.clear()

            for batch in batches:
                if batch.num_rows and own.size:
                    held.append((np.asarray(batch.column(0)), np.asarray(batch.column(1)), _matrix(batch.column(2))))
                if sum(h[0].size for h in held) >= BLOCK_ROWS:
                    flush()
            if held:
                flush()
            query_row, vec, score = best.rows_out()
            order = np.argsort(own)
            name = query_ids[order[np.searchsorted(own[order], query_row)]] if own.size else query_row
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (query_row, name, vec, score)], names=["query_row", "query_id", "vec_id", "score"])

        part = vectors.select("row", "id", "v").mapInArrow(run, "query_row long, query_id long, vec_id long, score long")
        window = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id")
        part = part.withColumn("rank", F.row_number().over(window)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        if rounds > 1:
            part = materialise(part, "round")
            sent.destroy()
        out = part if out is None else out.unionByName(part)
    return out

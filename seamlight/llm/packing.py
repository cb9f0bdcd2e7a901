"""Best-fit packing (operator 2): documents into fixed-length sequences by the sum-of-squares rule."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytepair import ranked
from .shared import materialise, plain_strings, small_batches

#: Tokens that one task packs: some thousands of sequences, so that what stays open at its end is a small part.
GROUP_TOKENS = 1 << 24


def pack_order(lengths, capacity: int):
    """Sum-of-squares packing of one group: (bin, offset) arrays for the lengths (1..capacity), bins numbered from 0.

    Pieces are placed by falling length (ties: as they stand). Each goes where the sum over gaps of (open bins with that
    gap) squared becomes smallest; of equal places, the smallest gap is taken. A new bin is opened only if no open one fits.
    """
    import numpy as np

    lengths = np.asarray(lengths, np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open bins by gap; 0 and capacity stay 0: such bins are not open
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    to_bin, offset = np.zeros(lengths.size, np.int64), np.zeros(lengths.size, np.int64)
    bins = 0
    for i in np.argsort(-lengths, kind="stable").tolist():
        s = int(lengths[i])
        gaps = s + np.flatnonzero(count[s:capacity])
        best_gap = capacity
        if gaps.size:
            # count[g] falls by one, count[g - s] grows by one, unless nothing is left open
            change = -2 * count[gaps] + 1 + np.where(gaps > s, 2 * count[gaps - s] + 1, 0)
            best_gap = int(gaps[np.argmin(change)])
        if best_gap == capacity:
            b, bins = bins, bins + 1
        else:
            b = open_bins[best_gap].pop()
            count[best_gap] -= 1
        to_bin[i], offset[i] = b, capacity - best_gap
        if left := best_gap - s:
            open_bins[left].append(b)
            count[left] += 1
    return to_bin, offset


def pieces(docs: DataFrame, tokenizer: str, capacity: int, end_id: int = 0, with_ids: bool = False, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Token pieces of whole texts: `id`, piece, start, length, ids_crc32 and, on request, the ids themselves."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        encoder, end = ranked(tokenizer), np.array([end_id], "<u4")
        for batch in batches:
            for start, _, flat, bounds in encoder.batches(plain_strings(batch.column(1))):
                rows: list[list] = [[], [], [], [], [], []]
                for k, (a, b) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist())):
                    own = np.concatenate([flat[a:b], end])
                    first = own.size % capacity or capacity
                    cuts = [0, *range(first, own.size + 1, capacity)]
                    for n, (x, y) in enumerate(zip(cuts[:-1], cuts[1:])):
                        for to, value in zip(rows, (start + k, n, x, y - x, zlib.crc32(own[x:y].tobytes()), own[x:y].astype("i4") if with_ids else None)):
                            to.append(value)
                made = [batch.column(0).take(pa.array(rows[0], pa.int64())), pa.array(rows[1], pa.int32()), *(pa.array(r, pa.int64()) for r in rows[2:5])]
                if with_ids:
                    made.append(pa.array(rows[5], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(made, names=[id_column, "piece", "start", "length", "ids_crc32", "ids"][: len(made)])

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(id_column, text_column).mapInArrow(run, f"`{id_column}` {kind}, piece int, start long, length long, ids_crc32 long" + (", ids array<int>" if with_ids else ""))


def best_fit_packing(docs: DataFrame, capacity: int = 2048, tokenizer: str = "byte_bpe_50k.json", end_id: int = 0, with_ids: bool = False, group_tokens: int = GROUP_TOKENS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Operator 2: one row per piece with its place, sequence_id and offset.

    A document is its text's ids and `end_id`; only longer ones than `capacity` are cut, the first piece being the
    shorter one. Pieces are dealt by hash into groups of about `group_tokens` tokens; each group is packed on its own,
    so memory and time of a task do not grow with the corpus, and a third of all rows with one text or id spread like
    others. A null or empty text is `end_id` alone; repeated rows are packed as often as they come; null ids stay null;
    other columns are dropped; an empty table gives an empty table.
    """
    cut = materialise(pieces(docs, tokenizer, capacity, end_id, with_ids, id_column, text_column), "pieces")
    tokens = cut.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(tokens / group_tokens))
    cut = cut.withColumn("_group", F.pmod(F.xxhash64("piece", "start", "ids_crc32", F.col(id_column), F.monotonically_increasing_id()), F.lit(groups)).cast("int"))

    def place(key, group):
        import numpy as np

        group = group.sort_values(["length", "ids_crc32", id_column, "piece"], ascending=[False, True, True, True], kind="stable")
        to_bin, offset = pack_order(group["length"].to_numpy(), capacity)
        return group.drop(columns="_group").assign(sequence_id=(np.int64(key[0]) << 36) + to_bin, offset=offset)

    rest = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema if f.name != "_group")
    return cut.groupBy("_group").applyInPandas(place, f"{rest}, sequence_id long, offset long")

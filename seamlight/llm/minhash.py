"""MinHash near-duplicates (operator 1): one-permutation hashing, optimal densification, banded buckets, star edges."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import BROADCAST_ROWS, HUB_ROWS, discard, hubs_of, lookup, materialise, plain_strings, salted_join, small_batches

#: Buckets that each document's sketch is put in.
BANDS = 42
#: Two documents just similar enough share no bucket at most so often; bins a bucket follow from it.
MISS = 1e-4
#: Centres of a bucket in the first rounds: its most central members, to which most copies of a text are linked.
CENTRAL = (1, 4)
#: Centres of a bucket in a later round, at most; rounds go on until every bucket is done.
CENTRES = 256
#: In later rounds, bytes of a marked set (one for each bin), members of a bucket compared at once, and how many standard
#: deviations below the threshold an estimate by marks must be for a pair to be no candidate (6: once in a billion).
MARKS, BLOCK, SIGMAS = 2048, 256, 6
#: Texts of so many bytes, or one text, are shingled at once.
SLICE_BYTES = 1 << 22
#: Up to so many links are joined to components on the driver; more by shuffles. The result is the same.
FEW_LINKS = BROADCAST_ROWS
_M1, _M2, _M3 = 0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB


def bins_per_band(percent: int, bands: int = BANDS) -> int:
    """The most bins a bucket key may hash, so that a pair of that similarity is missed with at most MISS."""
    rows = 1
    while (1 - (percent / 100) ** (rows + 1)) ** bands <= MISS:
        rows += 1
    return rows


def _mix(x):
    """A 64-bit finaliser over uint64 arrays."""
    import numpy as np

    x = (x ^ (x >> np.uint64(30))) * np.uint64(_M2)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(_M3)
    return x ^ (x >> np.uint64(31))


def shingle_hashes(texts: pa.Array, size: int) -> list:
    """Sorted distinct 64-bit shingle hashes of each text's words: ASCII lower case, split at ASCII blanks.

    Each distinct word of the block is hashed once (Arrow dictionary); the rest is arithmetic on whole arrays.
    """
    import numpy as np
    import xxhash

    split = pc.ascii_split_whitespace(pc.ascii_trim_whitespace(pc.ascii_lower(pc.fill_null(texts, ""))))
    bounds = np.asarray(split.offsets).astype(np.int64)
    coded = split.flatten().dictionary_encode()
    words = np.fromiter(map(xxhash.xxh3_64_intdigest, coded.dictionary.to_pylist()), np.uint64, len(coded.dictionary))
    w = words[np.asarray(coded.indices)] if len(coded) else np.zeros(0, np.uint64)
    bounds = bounds - bounds[0]
    blank = np.uint64(xxhash.xxh3_64_intdigest(""))

    def hashed(x, n):
        total = np.full(max(0, x.size - n + 1), n, np.uint64)
        for k in range(n):
            total = total * np.uint64(_M1) + x[k : x.size - n + 1 + k]
        return _mix(total)

    whole = hashed(w, size)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a == 1 and w[a] == blank:  # a text without words splits into one empty word
            out.append(whole[:0])
            continue
        x = np.sort(whole[a : b - size + 1]) if b - a >= size else hashed(w[a:b], b - a)
        out.append(x[np.append(True, x[1:] != x[:-1])] if x.size > 1 else x)
    return out


def probes(bins: int):
    """order[attempt, bin]: where each bin borrows from, a hash of bin and attempt (optimal densification)."""
    import numpy as np

    a, b = np.meshgrid(np.arange(1, 4 * bins + 1, dtype=np.uint64), np.arange(bins, dtype=np.uint64), indexing="ij")
    return (_mix(b * np.uint64(_M1) + a * np.uint64(_M2)) % np.uint64(bins)).astype(np.int64)


def sketches(sets: list, bins: int, order):
    """(sets x bins) the smallest hash of each bin under one permutation; empty bins take that of the first full bin they are sent to.

    Every set must have a member. A bin that finds none in all attempts takes the set's first full bin.
    """
    import numpy as np

    sizes = np.array([s.size for s in sets], np.int64)
    flat = np.concatenate(sets)
    # multiply-shift on the top 32 bits keeps the hashes of one bin together in the sorted sets, smallest first
    at = ((flat >> np.uint64(32)) * np.uint64(bins) >> np.uint64(32)).astype(np.int64) + np.repeat(np.arange(sizes.size) * bins, sizes)
    first = np.flatnonzero(np.diff(at, prepend=-1))
    value, full = np.zeros(sizes.size * bins, np.uint64), np.zeros(sizes.size * bins, bool)
    value[at[first]], full[at[first]] = flat[first], True
    least = at[np.append(0, np.cumsum(sizes)[:-1])]
    empty = np.flatnonzero(~full)
    alone = np.repeat(sizes == 1, bins)[empty]
    value[empty[alone]] = value[least[empty[alone] // bins]]
    empty = empty[~alone]
    base, place = empty - empty % bins, empty % bins
    for step in order:
        if not empty.size:
            break
        lender = base + step[place]
        hit = full[lender]
        value[empty[hit]] = value[lender[hit]]
        empty, base, place = empty[~hit], base[~hit], place[~hit]
    value[empty] = value[least[empty // bins]]
    return value.reshape(sizes.size, bins)


def band_keys(sketched, bands: int, rows: int):
    """(sets x bands) bucket keys, which hash a band's number and its bins."""
    import numpy as np

    v = sketched.reshape(len(sketched), bands, rows)
    keys = (np.arange(bands, dtype=np.uint64) * np.uint64(_M3))[None]
    for k in range(rows):
        keys = _mix(keys * np.uint64(_M1) + v[:, :, k])
    return keys.view(np.int64)


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) of a batch in blocks of at most SLICE_BYTES, or one text."""
    import numpy as np

    texts = plain_strings(batch.column(column))
    size = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)).astype(np.int64)) if len(texts) else np.zeros(0)
    start = 0
    while start < len(texts):
        stop = max(start + 1, int(np.searchsorted(size, (size[start - 1] if start else 0) + SLICE_BYTES, "right")))
        yield start, texts.slice(start, stop - start)
        start = stop


def signatures(docs: DataFrame, size: int, bands: int, rows: int, id_column: str, text_column: str) -> DataFrame:
    """id, n_shingles, set_hash (128 bits), h (63 bits), bands: one bucket key per band; the last three null for an empty set."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        order = probes(bands * rows)
        for batch in batches:
            for start, texts in _slices(batch, 1):
                sets = shingle_hashes(texts, size)
                full = [s for s in sets if s.size]
                keys = band_keys(sketches(full, bands * rows, order), bands, rows) if full else np.zeros((0, bands), np.int64)
                some = np.array([s.size > 0 for s in sets])
                offsets = pa.array(np.append(0, np.cumsum(some * bands)), pa.int32(), mask=np.append(~some, False))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(sets)),
                        pa.array([s.size for s in sets], pa.int64()),
                        pa.array([xxhash.xxh3_128_digest(s) if s.size else None for s in sets], pa.binary()),
                        pa.array([xxhash.xxh3_64_intdigest(s) >> 1 if s.size else None for s in sets], pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(keys.ravel())),
                    ],
                    names=["id", "n_shingles", "set_hash", "h", "bands"],
                )

    return docs.select(F.col(id_column).cast("long"), F.col(text_column)).mapInArrow(run, "id long, n_shingles long, set_hash binary, h long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, size: int, id_column: str, text_column: str) -> DataFrame:
    """(rep, h, shingles) of the documents among `wanted` (rep, h), each once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np
        import xxhash

        for batch in batches:
            for start, texts in _slices(batch, 1):
                sets = shingle_hashes(texts, size)
                made = [pa.array([xxhash.xxh3_64_intdigest(s) >> 1 for s in sets], pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), *made], names=["rep", "h", "shingles"])

    ids = wanted.select("rep").distinct()
    rows = docs.select(F.col(id_column).cast("long").alias("rep"), F.col(text_column).alias("text")).join(ids.hint("shuffle_hash"), "rep", "left_semi")
    return rows.mapInArrow(run, "rep long, h long, shingles array<long>").dropDuplicates(["rep", "h"])


def marked(sets: DataFrame, bands: int, rows: int) -> DataFrame:
    """(rep, h, marks, bands): a byte for each of MARKS bins, 0 if empty, else of the bin's smallest hash; and the bucket keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        order = probes(bands * rows)
        for batch in batches:
            if not batch.num_rows:
                continue
            found = [np.asarray(x.values).view(np.uint64) for x in batch.column(2)]
            made = np.zeros((len(found), MARKS), np.uint8)
            for i, x in enumerate(found):
                at = ((x >> np.uint64(32)) * np.uint64(MARKS) >> np.uint64(32)).astype(np.int64)
                first = np.flatnonzero(np.diff(at, prepend=-1))
                made[i, at[first]] = _mix(x[first]) % np.uint64(255) + np.uint64(1)
            keys = band_keys(sketches(found, bands * rows, order), bands, rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([m.tobytes() for m in made], pa.binary()), pa.array(list(keys), pa.list_(pa.int64()))], names=["rep", "h", "marks", "bands"])

    return sets.mapInArrow(run, "rep long, h long, marks binary, bands array<long>")


def least_estimate(percent: int, bins, marks: int = MARKS):
    """The estimate by `bins` full bins that a pair of that similarity falls short of once in a billion.

    Full bins sample the union without replacement: `bins` of about -marks * ln(1 - bins / marks) members.
    """
    import numpy as np

    t = percent / 100
    bins = np.maximum(bins, 1)
    union = -marks * np.log1p(-np.minimum(bins, marks - 0.5) / marks)
    return t - SIGMAS * np.sqrt(t * (1 - t) / bins * np.clip(1 - bins / np.maximum(union, bins), 0, 1)) - 2 / bins


def near_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of structs (rep, h) from rows (key, members, centres) whose marks say that they may be linked.

    A pair comes out of the first bucket that both are in only; as every bucket is gone through, it is met there.
    """
    pair = "a struct<rep:long,h:long>, b struct<rep:long,h:long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        def table(column, i):
            rows = column[i].values
            get = lambda name: np.asarray(rows.field(name))
            marks = np.frombuffer(b"".join(rows.field("marks").to_pylist()), np.uint8).reshape(len(rows), MARKS)
            return get("rep"), get("h"), get("n"), get("label"), marks, np.asarray(rows.field("bands").flatten()).reshape(len(rows), -1)

        for batch in batches:
            out = []
            for i, key in enumerate(batch.column(0).to_pylist()):
                rep, h, n, label, marks, bands = table(batch.column(1), i)
                full = marks > 0
                size = full.sum(1)
                for c_rep, c_h, c_n, c_label, c_marks, c_bands in zip(*table(batch.column(2), i)):
                    shared = bands == c_bands
                    first = shared.argmax(1)
                    at = np.flatnonzero((label != c_label) & (100 * np.minimum(n, c_n) >= percent * np.maximum(n, c_n)) & (bands[np.arange(rep.size), first] == key) & shared[np.arange(rep.size), first])
                    if not at.size:
                        continue
                    both = (full[at] & (c_marks > 0)).sum(1)
                    either = size[at] + (c_marks > 0).sum() - both
                    same = ((marks[at] == c_marks) & full[at]).sum(1)
                    for j in at[same >= least_estimate(percent, either) * either].tolist():
                        one, other = (rep[j], h[j]), (c_rep, c_h)
                        out.append((min(one, other), max(one, other)))
            kind = pa.struct([("rep", pa.int64()), ("h", pa.int64())])
            sides = [pa.array([{"rep": int(x[0]), "h": int(x[1])} for x in side], kind) for side in (zip(*out) if out else ((), ()))]
            yield pa.RecordBatch.from_arrays(sides, names=["a", "b"])

    return blocks.mapInArrow(run, pair)


def _blocks(met: DataFrame, centres: DataFrame, marks: DataFrame) -> DataFrame:
    """(key, members, centres): members of a bucket in blocks of some BLOCK, each with all centres of this round, and their marks.

    Centres are repeated for each block, so a crowded bucket is as many rows as it has blocks, not one task.
    """
    marks = marks.withColumnsRenamed({"rep": "_rep", "h": "_h"})
    row = F.struct("rep", "h", "n", "label", "marks", "bands")
    here = lambda df: df.join(marks.hint("merge"), (F.col("rep") == F.col("_rep")) & (F.col("h") == F.col("_h")))
    blocks = F.ceil(F.col("total") / BLOCK)
    few = here(centres.select("key", "total", F.explode("centres").alias("c")).select("key", "total", "c.rep", "c.h", "c.n", "c.label"))
    few = few.groupBy("key").agg(F.collect_list(row).alias("centres"), F.max("total").alias("total")).select("key", "centres", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)).alias("block"))
    many = here(met.select("key", "rep", "h", "n", "label", F.pmod(F.xxhash64("rep", "h"), blocks).alias("block"))).groupBy("key", "block").agg(F.collect_list(row).alias("members"))
    return many.join(few.hint("merge"), ["key", "block"]).select("key", "members", "centres")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of the pairs (a, b) of structs (rep, h), those with 100 * intersection >= percent * union on full sets.

    The set of a star's centre, which very many pairs need, is repeated, and these pairs are dealt over the copies.
    """
    both = pairs
    for end, other, name in (("b", "a", "y"), ("a", "b", "x")):
        hubs = hubs_of(pairs.groupBy(end).agg(F.count("*").alias("_n")), end, "_n")
        both = salted_join(both, sets.select(F.struct("rep", "h").alias(end), F.col("shingles").alias(name)), end, [other], hubs, "_n")
    both = both.withColumn("same", F.size(F.array_intersect("x", "y")))
    return both.filter(100 * F.col("same") >= percent * (F.size("x") + F.size("y") - F.col("same"))).select(F.col("a.rep").alias("a"), F.col("b.rep").alias("b")).filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(id, component): the smallest id reachable over edges (a, b), by alternating large and small stars.

    Rounds grow with the logarithm of the longest path; each is a few shuffles of the edges, kept in the shared folder.
    A star's centre is the end of very many edges: its least neighbour is broadcast to them (`lookup`).
    """
    now = materialise(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).filter("u <> v").distinct(), "edges")
    mark = None
    while True:
        both = now.union(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = materialise(both.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")).select("u", F.least("u", "m").alias("m"), "n"), "least")
        large = materialise(lookup(both.filter("v > u"), least.drop("n"), "u", hubs_of(least, "u", "n")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        below = materialise(large.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n")), "least")
        small = lookup(large, below.drop("n"), "u", hubs_of(below, "u", "n")).select("v", "m").union(below.select(F.col("u").alias("v"), "m")).filter("v <> m")
        before, now = now, materialise(small.select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "edges")
        discard(before, least, large, below)
        seen = tuple(now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if seen == mark:
            return now.select(F.col("u").alias("id"), F.col("v").alias("component"))
        mark = seen


def joined(links: DataFrame) -> DataFrame | None:
    """(id, component) as by `components`, small enough to be broadcast, by union-find on the driver; None for more than FEW_LINKS links."""
    import numpy as np

    if links.count() > FEW_LINKS:
        return None
    found = links.select("a", "b").toArrow()
    ids, ends = np.unique(np.concatenate([found["a"].to_numpy(), found["b"].to_numpy()]), return_inverse=True)
    root = list(range(ids.size))  # places in the sorted ids, so the least place is that of the least id
    for a, b in zip(ends[: found.num_rows].tolist(), ends[found.num_rows :].tolist()):
        while a != root[a]:
            root[a] = a = root[root[a]]
        while b != root[b]:
            root[b] = b = root[root[b]]
        root[max(a, b)] = min(a, b)
    for i, above in enumerate(root):
        root[i] = root[above]
    return links.sparkSession.createDataFrame(pa.table({"id": pa.array(ids, pa.int64()), "component": pa.array(ids[root], pa.int64())}))


def _central(entries: DataFrame, slots: int, turn: int) -> DataFrame:
    """(key, centres, total, size): for each bucket with two labels or more, up to `slots` members, those of most bucket mates first."""
    slot = F.pmod(F.xxhash64("rep", "h", F.lit(turn)), F.lit(slots))
    each = entries.groupBy("key", slot.alias("slot")).agg(F.max(F.struct("mates", "rep", "h", "n", "label")).alias("c"), F.min("label").alias("low"), F.max("label").alias("high"), F.count("*").alias("members"), F.max("size").alias("size"))
    return _divided(each)


def _strangers(entries: DataFrame, slots: int, turn: int) -> DataFrame:
    """(key, centres, total, size): for each bucket with two labels or more, a member of each of up to `slots` labels, of few members first."""
    each = entries.groupBy("key", "label").agg(F.count("*").alias("members"), F.max(F.struct("mates", "rep", "h", "n", "label")).alias("c"), F.max("size").alias("size"))
    slot = F.pmod(F.xxhash64("label", F.lit(turn)), F.lit(slots))
    each = each.groupBy("key", slot.alias("slot")).agg(F.min_by("c", F.struct("members", "label")).alias("c"), F.min("label").alias("low"), F.max("label").alias("high"), F.sum("members").alias("members"), F.max("size").alias("size"))
    return _divided(each)


def _divided(each: DataFrame) -> DataFrame:
    whole = each.groupBy("key").agg(F.collect_list("c").alias("centres"), F.min("low").alias("low"), F.max("high").alias("high"), F.sum("members").alias("total"), F.max("size").alias("size"))
    return whole.filter("low < high").select("key", "centres", "total", "size")


def _met(entries: DataFrame, centres: DataFrame) -> DataFrame:
    """Entries with the centres of their bucket. `size` is the bucket's first size on both sides: of a crowded bucket the
    centres are repeated, and its entries are dealt over the copies."""
    copies = F.ceil(F.col("size") / HUB_ROWS).cast("int")
    dealt = entries.withColumn("_salt", F.pmod(F.xxhash64("rep", "h"), copies).cast("int"))
    each = centres.select("key", "centres", "total", F.explode(F.sequence(F.lit(0), copies - 1)).alias("_salt"))
    return dealt.join(each.hint("merge"), ["key", "_salt"]).drop("_salt")


def _spread(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(id, component): labels after two steps over the links; a star's members all come to have its least label."""
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    both = materialise(both.union(both.select("a", F.col("a").alias("b")).distinct()), "both")
    ends = materialise(both.groupBy("b").agg(F.count("*").alias("n")), "ends")
    hubs = hubs_of(ends, "b", "n")
    own = ends.select("b", F.col("b").alias("l"))
    if labels is not None:
        own = own.join(labels.select(F.col("id").alias("b"), "component").hint("merge"), "b", "left").select("b", F.coalesce("component", "b").alias("l"))
    least = materialise(lookup(both, own, "b", hubs).groupBy("a").agg(F.min("l").alias("m")), "least")
    out = materialise(lookup(both, least.withColumnRenamed("a", "b"), "b", hubs).groupBy("a").agg(F.min("m").alias("component")).withColumnRenamed("a", "id"), "labels")
    discard(both, ends, hubs, least)
    return out


def near_duplicates(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = BANDS, rows: int | None = None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Operator 1: per document its id, n_shingles, component_id and kept.

    Sets are distinct `size`-word shingles; a shorter text is one shingle; without words the set is empty and linked
    with nothing. Documents with 100 * intersection >= percent * union are linked, and component_id is the smallest id
    reachable; kept if that is its own.

    Equal sets collapse to the smallest id first, so thousands of copies cost one row each. In each bucket that holds
    two or more labels, a few members are centres of stars: all members of other labels are candidates with them,
    confirmed on full sets, and the centres leave; linked members take one label. The first rounds take as centres
    those that share most buckets with others, so the copies of a text get the label of their common origin at once;
    the later ones take members of the rarest labels. Rounds go on until no bucket holds two labels, so any two members
    of a bucket meet unless they are connected already. Later rounds compare members and centres in blocks by byte marks
    of their sets, so that of the many strangers in a crowd of loosely similar texts only those become pairs that full
    sets may confirm. Nothing is dropped or capped. Components of all links follow at the end.

    Repeated rows come out as often as they go in; rows that share an id but not a text each count by their own text.
    Rows with a null id take no part: component_id null, not kept. Null texts have no words. Other columns are dropped;
    an empty table gives an empty table.
    """
    rows = rows or bins_per_band(percent, bands)
    signed = materialise(signatures(docs, size, bands, rows, id_column, text_column), "signatures")
    classes = materialise(signed.filter("set_hash is not null and id is not null").groupBy("set_hash").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    firsts = signed.join(classes.hint("merge"), (signed["set_hash"] == classes["set_hash"]) & (F.col("id") == F.col("rep"))).select("rep", "h", F.col("n_shingles").alias("n"), "bands")
    firsts = materialise(firsts.dropDuplicates(["rep", "h"]), "firsts")
    found = firsts.select(F.explode("bands").alias("key"), "rep", "h", "n")
    # only buckets of two or more go on
    crowded = materialise(found.groupBy("key").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    met = materialise(lookup(found, crowded, "key", hubs_of(crowded, "key", "size")), "entries")
    mates = met.groupBy("rep", "h").agg(F.sum("size").alias("mates"))
    entries = materialise(met.join(mates.hint("merge"), ["rep", "h"]).withColumn("label", F.col("rep")), "entries")
    discard(met, crowded)
    firsts_of = materialise(entries.select("rep").distinct(), "wanted")
    sets = marks = tested = links = labels = few = None
    turn = 0
    while True:
        centres = materialise(_central(entries, CENTRAL[turn], turn) if turn < len(CENTRAL) else _strangers(entries, CENTRES, turn), "centres")
        if centres.isEmpty():
            break
        met = _met(entries, centres)
        if turn < len(CENTRAL):
            # only centres that can be linked with a member are taken out of the array
            apart = lambda c: (c["label"] != F.col("label")) & (100 * F.least("n", c["n"]) >= percent * F.greatest("n", c["n"]))
            here, there = F.struct("rep", "h"), F.struct("c.rep", "c.h")
            stars = met.select("rep", "h", F.explode(F.filter("centres", apart)).alias("c"))
            pairs = stars.select(F.least(here, there).alias("a"), F.greatest(here, there).alias("b")).distinct()
        else:
            if sets is None:
                sets = materialise(shingle_sets(docs, firsts_of, size, id_column, text_column), "sets")
            if marks is None:
                marks = materialise(marked(sets, bands, rows), "marks")
            pairs = near_pairs(_blocks(met, centres, marks), percent)
        pairs = materialise(pairs if tested is None else pairs.join(tested.hint("merge"), ["a", "b"], "left_anti"), "pairs")
        tested = pairs if tested is None else tested.union(pairs)
        fresh = False
        if not pairs.isEmpty():
            if sets is None:
                sets = materialise(shingle_sets(docs, firsts_of, size, id_column, text_column), "sets")
            new = materialise(confirm(pairs, sets, percent), "links")
            if fresh := not new.isEmpty():
                links = new if links is None else links.union(new)
                few = joined(links)
                before, labels = labels, few if few is not None else _spread(links, labels)
                discard(before)
        rest = met.filter(~F.exists("centres", lambda c: (c["rep"] == F.col("rep")) & (c["h"] == F.col("h")))).select(*entries.columns)
        if fresh:
            rest = rest.join(labels.hint("merge" if few is None else "broadcast"), rest["rep"] == labels["id"], "left").withColumn("label", F.coalesce("component", "label")).select(*entries.columns)
        before, entries = entries, materialise(rest, "entries")
        discard(before, centres)
        turn += 1
    discard(firsts, firsts_of, entries, centres, sets, marks)
    # classes get their component, then all rows of a class, which may be a third of the table, look it up
    named = classes.select("set_hash", F.col("rep").alias("component"))
    if links is not None:
        reached = (components(links) if few is None else labels).select(F.col("id").alias("rep"), F.col("component").alias("reached"))
        named = materialise(classes.join(reached.hint("merge" if few is None else "broadcast"), "rep", "left").select("set_hash", F.coalesce("reached", "rep").alias("component")), "named")
    own = F.col("set_hash").isNotNull() & F.col("id").isNotNull()
    some = lookup(signed.filter(own).select("set_hash", "id", "n_shingles"), named, "set_hash", hubs_of(classes, "set_hash", "copies"))
    every = some.select("id", "n_shingles", "component").unionByName(signed.filter(~own).select("id", "n_shingles", F.col("id").alias("component")))
    return every.select(F.col("id").alias(id_column), "n_shingles", F.col("component").alias("component_id"), F.coalesce(F.col("id") == F.col("component"), F.lit(False)).alias("kept"))

"""The training-data operators against brute force, exact round trips and held-out labels, and on awkward rows."""

import hashlib
import itertools
import re
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from compare import same
from pyspark.sql import functions as F

from seamlight.llm import bytepair, minhash, packing, quality_model, quality_rules, registry, rollups, sharding, shared, topk, toxicity, training, warc
from seamlight.llm.shared import file_system, scratch, table
from seamlight.sources.versions import Conflict

CLASHES = ("_score", "_toxic", "_threshold", "_kept_id", "_place", "_salt", "_ratios", "_grams", "_copies", "_id", "_label", "row", "place", "id", "key", "label", "rep", "h", "n", "score", "bucket", "piece", "length", "text_hash", "_text", "_row", "_words", "value", "digest", "bytes", "refers")


def clashing(df):
    return df.withColumns({c: F.lit(7) for c in CLASHES})


@pytest.fixture(scope="module")
def docs(spark, sf):
    return table(spark, sf, "documents")


@pytest.fixture(scope="module")
def awkward(spark):
    """Nulls in every column, empty and very long texts, ties, repeated rows, one source, clashing names."""
    long = " ".join(f"w{i * i % 7919}" for i in range(60_000))
    rows = [(1, "a b c d e f g h i j k l", "en", "s", 1), (1, "a b c d e f g h i j k l", "en", "s", 1), (2, "A b c d e f g h i j k l", None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, " \t\n", "en", "s", 3), (6, long, "en", "s", 9), (7, long + " end", "en", "s", 9), (None, "a b c d e f g h i j k l", "en", "s", 1), (None, None, None, None, None), (8, "one", "de", "s", 1), (9, "One", "de", "s", 1)]
    return clashing(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long"))


@pytest.fixture(scope="module")
def empty(awkward):
    return awkward.limit(0)


def lowered(text):
    return re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))


def shingles(text, size):
    w = lowered(text)
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def linked(texts: dict, size, percent):
    sets = {i: shingles(t, size) for i, t in texts.items()}
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sets, 2):
        x, y = sets[a], sets[b]
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            low, high = sorted((root(a), root(b)))
            parent[high] = low
    return {i: (len(sets[i]), root(i)) for i in sets}


def test_op1_brute_force(spark, sf, docs):
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    got = registry.op1_minhash_dedup(spark, sf).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == linked(texts, 3, 85)
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got) and len(got) == len(texts)


def test_op1_families(spark):
    """Chains and a crowd of copies of one text, each changed elsewhere: links hold though most pairs are strangers."""
    rng = np.random.default_rng(3)
    base = [f"b{i}" for i in range(200)]
    rows = {0: " ".join(base)}
    for i in range(1, 60):
        words = list(base)
        for at in rng.choice(200, int(rng.integers(1, 12)), replace=False):
            words[at] = f"x{i}_{at}"
        rows[i] = " ".join(words)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == linked(rows, 3, 85)


@pytest.mark.parametrize("most", [3, 1000])
def test_op1_recall_with_hubs(spark, monkeypatch, most):
    """A hot group of exact copies, a star of near copies of one text, and chains at the threshold: with hubs from `most` rows on, all links of the brute force hold."""
    monkeypatch.setattr(shared, "HUB_ROWS", most)
    monkeypatch.setattr(minhash, "HUB_ROWS", most)
    rng = np.random.default_rng(9)
    base = [f"b{i}" for i in range(120)]
    rows = {i: " ".join(base) for i in range(40, 70)}
    for i in range(40):
        words = list(base)
        words[i * 3] = f"x{i}"
        rows[i] = " ".join(words)
    for family in range(6):
        words = [f"f{family}_{i}" for i in range(150)]
        for step in range(6):
            words[int(rng.integers(0, 150))] = f"s{step}"
            rows[100 + 10 * family + step] = " ".join(words)
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(5)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 3, 85).collect()}
    assert got == linked(rows, 3, 85)


def test_components(spark, monkeypatch):
    """A star whose centre has the largest id, one whose centre has the smallest, and a path, with hubs and without."""
    edges = [(1000, i) for i in range(10, 60)] + [(2, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5)]
    df = spark.createDataFrame(edges, "a long, b long")
    for most in (4, 1000):
        monkeypatch.setattr(shared, "HUB_ROWS", most)
        got = dict(map(tuple, minhash.components(df).collect()))
        assert got == {1000: 10, **{i: 10 for i in range(11, 60)}, **{i: 2 for i in range(100, 160)}, **{i: 200 for i in range(201, 231)}}


def test_op1_few_links(spark, monkeypatch):
    """Chains, stars and a hot group: joined on the driver, links give the components that shuffles give, in far fewer jobs."""
    rng, tracker, rows, jobs = np.random.default_rng(4), spark.sparkContext.statusTracker(), {}, {}
    for family in range(5):
        words = [f"f{family}_{i}" for i in range(150)]
        for step in range(8):
            rows[500 - 50 * family - step * (-1) ** family] = " ".join(words)
            words[int(rng.integers(0, 150))] = f"s{step}"
    rows |= {i: rows[500] for i in range(900, 930)}
    df = spark.createDataFrame(list(rows.items()), "doc_id long, text string").repartition(3)
    for few in (0, 100_000):
        monkeypatch.setattr(minhash, "FEW_LINKS", few)
        spark.sparkContext.setJobGroup(f"links-{few}", "")
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in minhash.near_duplicates(df, 3, 85).collect()}
        assert got == linked(rows, 3, 85)
        jobs[few] = len(tracker.getJobIdsForGroup(f"links-{few}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert jobs[100_000] < 0.75 * jobs[0], jobs

    edges = spark.createDataFrame([(1000, i) for i in range(10, 60)] + [(2, i) for i in range(100, 160)] + [(i, i + 1) for i in range(200, 230)] + [(5, 5)], "a long, b long")
    got = dict(map(tuple, minhash.joined(edges).collect()))
    assert {i: c for i, c in got.items() if i != c} == dict(map(tuple, minhash.components(edges).filter("id <> component").collect()))
    monkeypatch.setattr(minhash, "FEW_LINKS", 100)
    assert minhash.joined(edges) is None


def test_op1_awkward(awkward, empty):
    got = [tuple(r) for r in minhash.near_duplicates(awkward, 3, 85).select("doc_id", "n_shingles", "component_id", "kept").collect()]
    assert sorted(got, key=str) == sorted([(1, 10, 1, True), (1, 10, 1, True), (2, 10, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), *[(i, n, c, i == c) for i, (n, c) in linked({r["doc_id"]: r["text"] for r in awkward.filter("doc_id in (6, 7)").collect()}, 3, 85).items()], (None, 10, None, False), (None, 0, None, False), (8, 1, 8, True), (9, 1, 8, False)], key=str)
    assert minhash.near_duplicates(empty).count() == 0


def test_sketch_densifies():
    sets = [np.sort(np.random.default_rng(i).integers(0, 2**63, 5).astype(np.uint64)) for i in range(3)] + [np.array([5], np.uint64)]
    out = minhash.sketches(sets, 64, minhash.probes(64))
    assert all(set(row) <= set(s.tolist()) for row, s in zip(out.tolist(), sets)) and (out[3] == 5).all()


def pack_ids(texts):
    import public_tokenizers
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return [np.array(e.ids + [0], "<u4") for e in own.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check_packing(rows, ids):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for seq in by.values():
        end = 0
        for offset, length in sorted(seq):
            assert offset == end and 0 < length
            end += length
        assert end <= 2048
    for doc_id, own in ids.items():
        pieces = sorted((r for r in rows if r["doc_id"] == doc_id), key=lambda r: r["piece"])
        assert [r["start"] for r in pieces] == [sum(p["length"] for p in pieces[:k]) for k in range(len(pieces))]
        assert len(pieces) == -(-len(own) // 2048) and sum(p["length"] for p in pieces) == len(own)
        assert all(p["length"] == 2048 for p in pieces[1:]) and [r["piece"] for r in pieces] == list(range(len(pieces)))
        assert [r["ids_crc32"] for r in pieces] == [zlib.crc32(own[r["start"] : r["start"] + r["length"]].tobytes()) for r in pieces]
    return len(by)


def test_op2_against_library(spark, sf, docs):
    rows = docs.collect()
    ids = dict(zip((r["doc_id"] for r in rows), pack_ids([r["text"] for r in rows])))
    bins = check_packing(registry.op2_best_fit_packing(spark, sf).collect(), ids)
    assert bins <= np.ceil(sum(map(len, ids.values())) / 2048) * 1.02 + 1


def test_op2_awkward(awkward, empty):
    some = awkward.filter("doc_id in (2, 3, 4, 5, 6, 7)")
    rows = some.collect()
    check_packing(packing.best_fit_packing(some).collect(), dict(zip((r["doc_id"] for r in rows), pack_ids([r["text"] for r in rows]))))
    assert packing.best_fit_packing(awkward).filter("doc_id is null and piece = 0").count() == 2
    assert packing.best_fit_packing(empty).count() == 0


def test_sum_of_squares_rule():
    to_bin, offset = packing.pack_order([6, 4, 5, 5, 3, 7, 10], 10)
    assert len(set(to_bin.tolist())) == 4 and offset.max() <= 7


def test_packing_fills_open_bins():
    """No worse than plain best fit by more than a few sequences, where a third or half of the pieces are of one length."""
    rng = np.random.default_rng(1)
    for lengths in (np.append(np.full(10_000, 700), rng.integers(1, 2049, 20_000)), np.append(np.ones(20_000, int), rng.integers(1, 2049, 20_000)), rng.integers(500, 900, 20_000)):
        count, bins = np.zeros(2049, int), 0
        for n in np.sort(lengths)[::-1]:
            gaps = n + np.flatnonzero(count[n:2048])
            gap = gaps[0] if gaps.size else 2048
            bins += not gaps.size
            count[gap] -= gap < 2048
            count[gap - n] += gap > n
        to_bin, _ = packing.pack_order(lengths, 2048)
        assert np.bincount(to_bin, lengths).max() <= 2048 and to_bin.max() + 1 <= bins * 1.001


def test_op3(spark, sf):
    same(registry.op3_warc(spark, sf), registry.SQL["op3_warc"], sf)


def test_op3_magic_in_payloads(spark):
    trap = "WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 4\r\n\r\nabcd\r\n\r\n"
    big = trap * 40
    rows = [(1, "u\r\nX: y", big), (2, None, big), (3, "u", None), (4, "u", ""), (5, "u", "é" * 600), (6, "u", "é" * 600), (7, "u", trap), (8, "u", trap), (None, "u", "z"), (2, None, big)]
    pages = clashing(spark.createDataFrame(rows, "page_id long, url string, html string"))
    path = scratch(spark, "warc")
    warc.write_warc(pages, path)
    got = sorted((tuple(r) for r in warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=str)
    want = []
    for i, _, html in rows:
        raw = (html or "").encode()
        to = max((j for j, _, h in rows if h == html and j is not None), default=i)
        revisit = len(raw) >= 1000 and i is not None and to != i
        want.append((i, len(raw), hashlib.sha1(raw).hexdigest(), "revisit" if revisit else "response", to if revisit else None))
    assert got == sorted(want, key=str)
    warc.write_warc(pages.limit(0), path + "-none")
    assert warc.read_warc(spark, path + "-none").count() == 0


def test_op3_archives_of_long_payloads(spark):
    """40 different pages of 2 MB, 260 copies of one, 500 short ones: no archive is so long that reading it fills a worker, and few are short."""
    html = F.when(F.col("id") < 40, F.repeat(F.md5(F.col("id").cast("string")), F.lit(1 << 16))).when(F.col("id") < 300, F.repeat(F.lit("x"), F.lit(1 << 21))).otherwise(F.concat(F.lit("page "), F.col("id")))
    pages = spark.range(0, 800, 1, 1).select(F.col("id").alias("page_id"), F.lit("u").alias("url"), html.alias("html"))
    path = scratch(spark, "warc")
    warc.write_warc(pages, path)
    fs, to_path = file_system(spark, path)
    sizes = [s.getLen() for s in fs.listStatus(to_path(path)) if s.getPath().getName().startswith("part-")]
    assert max(sizes) < 33 << 20 and len(sizes) <= 8
    got = {r["page_id"]: tuple(r)[1:] for r in warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()}
    digests = pages.select("page_id", F.octet_length("html"), F.sha1("html")).collect()
    assert got == {i: (n, digest, *(("revisit", 299) if 40 <= i < 299 else ("response", None))) for i, n, digest in digests}


def record(page, body, more=b""):
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:%d>\r\n" % page + more
    return head + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


HOSTILE = [
    "WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:x>\r\nContent-Length: 1\r\n\r\na\r\n\r\n",
    "\r\n\r\nWARC/1.0\r\nWARC-Record-ID: <urn:page:99999999999999999999999>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    "\r\n\r\nWARC/1.0\r\nWARC-Type: revisit\r\nWARC-Payload-Length: many\r\nWARC-Refers-To: <urn:page:>\r\nContent-Length: 0\r\n\r\n\r\n\r\n",
    "\r\n\r\nWARC/1.0\r\nContent-Length: " + "9" * 5000 + "\r\n\r\nx\r\n\r\n",
    "\r\n\r\nWARC/1.0\r\nContent-Length: -4\r\n\r\nx", "\r\n\r\nWARC/1.0\r\nContent-Length:\r\n\r\n", "\r\n\r\nWARC/1.0\r\n: \r\n\u00ff:\r\n\r\n", "\r\n\r\nWARC/1.0\r\n", "WARC/1.0\r\n" * 40_000,
    "\r\n\r\nWARC/1.0\r\n" * 40_000, "".join(f"\r\n\r\nWARC/1.0\r\nContent-Length: {1_000_000 - 50 * i}\r\n\r\n" for i in range(20_000)),
]


def test_op3_hostile_payloads(spark):
    """Every field malformed, magics without end, nested look-alikes that claim the rest of the page: pages come back whole, soon."""
    pages = spark.createDataFrame([(i, f"u{i}/WARC/1.0", h) for i, h in enumerate(HOSTILE)], "page_id long, url string, html string")
    path = scratch(spark, "warc")
    warc.write_warc(pages, path)
    began = time.monotonic()
    got = {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"]) for r in warc.read_warc(spark, path).collect()}
    assert got == {i: (len(h.encode()), hashlib.sha1(h.encode()).hexdigest(), "response") for i, h in enumerate(HOSTILE)}
    assert time.monotonic() - began < 30


def test_op3_foreign_archives(spark, tmp_path):
    """Archives of other hands: what no chain of sound lengths reaches from the start falls out."""
    sound = record(1, b"a" * 10) + record(-5, b"") + record(2**62, b"\x00\xff", b"Content-Type: x\r\nnonsense\r\n")
    broken = record(3, b"b") + b"WARC/1.0\r\nContent-Length: 999\r\n\r\nshort\r\n\r\n" + record(4, b"c")
    for i, raw in enumerate((sound, broken, b"", b"noise" + record(6, b"d"), b"WARC/1.0\r\n")):
        (tmp_path / f"part-{i}").write_bytes(raw)
    assert sorted((r["page_id"], r["payload_bytes"]) for r in warc.read_warc(spark, f"file://{tmp_path}").collect()) == [(-5, 0), (1, 10), (3, 1), (2**62, 2)]


def test_op4(spark, sf):
    same(registry.op4_sharding(spark, sf), registry.SQL["op4_sharding"], sf)


def test_op4_compaction(spark, awkward, empty):
    store = sharding.ShardStore(spark, scratch(spark, "shards"))
    for part in range(9):
        store.append(awkward.coalesce(1))
    before = store.manifest().count()
    store.compact(awkward.schema, 64 << 20)
    assert store.manifest().count() < before and store.shards(awkward.schema).count() < 9
    assert store.read(awkward.schema).count() == 9 * awkward.count() and store.read(awkward.schema, 1).count() == awkward.count()
    runs = store.manifest().count()
    store.append(empty)
    assert store.manifest().count() == runs
    stale = store.version() - 1
    with pytest.raises(Conflict):
        store._commit(store.manifest(), stale)
    unlisted = store._write(awkward.coalesce(1)).first()["run"]  # a writer at work
    store.vacuum()
    assert store.read(awkward.schema).count() == 9 * awkward.count()
    fs, to_path = file_system(spark, store.path)
    left = {s.getPath().getName() for s in fs.listStatus(to_path(f"{store.path}/data"))}
    assert left == {r["run"] for r in store.manifest().collect()} | {unlisted} or len(left) == store.manifest().count() + 2  # the empty arrival's folder too
    assert sharding.ShardStore(spark, scratch(spark, "shards")).read(awkward.schema).count() == 0


def test_op4_every_tier_is_merged(spark):
    """A tier that a merge cannot make smaller does not keep the others from theirs."""
    store = sharding.ShardStore(spark, scratch(spark, "shards"))
    for n, times in ((10, 4), (20_000, 4), (200_000, 4)):
        for _ in range(times):
            store.append(spark.range(n).coalesce(1))
    rows = store.read(spark.range(1).schema).count()
    store.compact(spark.range(1).schema, 1 << 20)
    mean = [r["bytes"] / r["shards"] for r in store.manifest().collect()]
    tiers = Counter(int(np.log(m) / np.log(4)) for m in mean if m < 1 << 19)
    assert max(tiers.values(), default=0) < 4 and store.read(spark.range(1).schema).count() == rows


def test_op4_two_writers(spark):
    """Both have read the manifest when they commit: one is told, nothing of the other is lost."""
    store = sharding.ShardStore(spark, scratch(spark, "shards"))
    lists = [store._write(spark.range(k)) for k in (5, 10)]
    store._commit(lists[0], 0)
    with pytest.raises(Conflict):
        store._commit(lists[1], 0)
    assert store.read(spark.range(1).schema).count() == 5
    store._commit(store.manifest().unionByName(lists[1]), store.version())
    assert store.read(spark.range(1).schema).count() == 15


def base_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = Counter(windows)
    covered = {j for i, w in enumerate(windows) if twice[w] > 1 for j in range(i, i + 5)}
    n = len(words)
    return n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered), n < 10 or 100 * len(covered) > 20 * n


def test_op5_base(spark, sf, docs):
    want = {r["doc_id"]: base_counts(r["text"]) for r in docs.collect()}
    got = registry.op5_quality_rules(spark, sf).collect()
    assert {r["doc_id"]: (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got} == want
    assert len(got) == len(want) and not any(r["kept"] and r["base_failed"] for r in got)


def test_op5_ratio(spark, docs):
    """The mean log ratio again, from counts of the same buckets in plain Python."""
    few = docs.limit(40).persist()
    trusted = few.filter("doc_id % 3 = 0").select("doc_id")
    grams = {r["doc_id"]: r["g"] for r in few.select("doc_id", quality_rules.grams(quality_rules.words_of(F.col("text"))).alias("g")).collect()}
    raw, target = Counter(), Counter()
    for i, g in grams.items():
        raw.update(g)
        if i % 3 == 0:
            target.update(g)
    share = sum(target.values()) / sum(raw.values())
    for r in quality_rules.quality_rules(few, trusted).collect():
        g = grams[r["doc_id"]]
        llr = np.mean([np.log((target[b] + 4) / (raw[b] * share + 4)) for b in g]) if g else 0
        assert r["llr"] == pytest.approx(llr, abs=1e-6)


def test_op5_awkward(awkward, empty):
    got = quality_rules.quality_rules(awkward, awkward.select("doc_id")).collect()
    want = [base_counts(r["text"]) for r in awkward.collect()]
    assert sorted((r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == sorted(want)
    assert quality_rules.quality_rules(empty, empty.select("doc_id")).count() == 0
    assert all(r["llr"] == 0 for r in quality_rules.quality_rules(awkward, empty.select("doc_id")).collect())


def coded(texts):
    import public_tokenizers
    import tiktoken

    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bytepair.load_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")), special_tokens={})
    return [np.array(own.encode_ordinary(t or ""), "<u4") for t in texts]


def expect6(rows):
    return sorted(((r["doc_id"], len(i), hashlib.sha256(i.tobytes()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()) for r, i in zip(rows, coded([r["text"] for r in rows]))), key=str)


def test_op6_against_library(spark, sf, docs, awkward, empty):
    assert sorted(map(tuple, registry.op6_byte_bpe(spark, sf).collect()), key=str) == expect6(docs.collect())
    odd = ["a  b", " lead", "trail ", "\n\n x", "   y", "it's I'LL", "1234567890", "🙂🙂 日本語", "\u0000\u0001", "a" * 500, "  ", "x\t \ty"]
    more = awkward.select("doc_id", "text").union(spark.createDataFrame([(100 + i, t) for i, t in enumerate(odd)], "doc_id long, text string"))
    assert sorted(map(tuple, bytepair.encode_decode(more, ids=False).collect()), key=str) == expect6(more.collect())
    assert bytepair.encode_decode(empty).count() == 0


def test_op7(spark, sf):
    same(registry.op7_exact_top_k(spark, sf), registry.SQL["op7_exact_top_k"], sf)


def test_op7_awkward(spark):
    """Nulls and non-finite components take no part; of repeated ids each row is a query and a candidate of the others."""
    rows = [(0, [1.0, 0.5]), (50, [1.0, 0.5]), (51, [1.0, 0.5]), (52, None), (53, [None, 1.0]), (54, [float("nan"), 1.0]), (55, [float("inf"), 1.0]), (None, [1.0, 1.0]), (56, [-0.001, 2.0])]
    v = topk.numbered(topk.quantised(clashing(spark.createDataFrame(rows, "vec_id long, embedding array<float>"))))
    got = [tuple(r) for r in topk.top_k(v, "id % 50 = 0").orderBy("query_id", "rank").collect()]
    assert got == [(0, 1, 50, 81920), (0, 2, 51, 81920), (0, 3, 56, 65280), (50, 1, 0, 81920), (50, 2, 51, 81920), (50, 3, 56, 65280)]
    assert topk.top_k(topk.numbered(v.limit(0)), "id = 0").count() == 0 and topk.top_k(v, "id = -1").count() == 0


def test_op7_repeated_ids(spark, tmp_path, monkeypatch):
    rng = np.random.default_rng(2)
    rows = [(int(i), rng.standard_normal(6).tolist()) for i in rng.integers(0, 40, 300)] + [(0, [1.0] * 6)] * 5
    spark.createDataFrame(rows, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    same(registry.op7_exact_top_k(spark, str(tmp_path)), registry.SQL["op7_exact_top_k"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'"), "/root/testdata/sf0.001")
    monkeypatch.setattr(topk, "ROUND_QUERIES", 5)  # more rounds than one
    same(registry.op7_exact_top_k(spark, str(tmp_path)), registry.SQL["op7_exact_top_k"].replace("FROM embeddings", f"FROM '{tmp_path}/embeddings.parquet/*.parquet'"), "/root/testdata/sf0.001")


def brute_top(v, q, own, k):
    s = v @ q.T
    out = []
    for j in range(len(q)):
        order = [i for i in np.lexsort((np.arange(len(v)), -s[:, j])) if i != own[j]][:k]
        out.append((order, s[order, j].tolist()))
    return out


@pytest.mark.parametrize("high", [50, 10**6, 10**8])
def test_op7_scan_is_exact(high):
    """In floats of both sizes and in integers, over several blocks, with ties."""
    rng = np.random.default_rng(1)
    v, q = rng.integers(-high, high, (500, 12)), rng.integers(-high, high, (9, 12))
    v[100:120], q[0] = v[0], v[0]
    best = topk.Best(np.array([0, *range(1000, 1008)]), q, 5)
    for a in range(0, 500, 125):
        best.add(np.arange(a, a + 125), np.arange(a, a + 125), v[a : a + 125])
    for j, (order, scores) in enumerate(brute_top(v, q, best.own, 5)):
        assert best.ids[j].tolist() == order and best.scores[j].tolist() == scores


def test_op7_reads_stop_early():
    """Where a few rows stand out, the sorted lists are left soon, and a block that cannot qualify is left at its heads."""
    rng = np.random.default_rng(4)
    v, q = rng.integers(0, 20, (4096, 8)), rng.integers(1, 9, (16, 8))
    v[rng.choice(4096, 10, replace=False)] += 200
    best = topk.Best(np.arange(10_000, 10_016), q, 5)
    best.add(np.arange(4096), np.arange(4096), v)
    whole = 16 * v.size
    assert 0 < best.read < whole / 10
    for j, (order, scores) in enumerate(brute_top(v, q, best.own, 5)):
        assert best.ids[j].tolist() == order and best.scores[j].tolist() == scores
    before = best.read
    best.add(np.arange(5000, 9096), np.arange(5000, 9096), rng.integers(0, 20, (4096, 8)))
    assert best.read == before


def auc(score, truth):
    order = np.argsort(np.argsort(score)) + 1.0
    pos = truth.sum()
    return (order[truth == 1].sum() - pos * (pos + 1) / 2) / (pos * (len(truth) - pos))


@pytest.mark.parametrize("name,label,mod,rest", [("op8_toxicity_cnn", "toxic", 4, 2), ("op9_quality_subwords", "quality", 3, 1)])
def test_classifiers_hold_out(spark, name, label, mod, rest):
    sf = "/root/testdata/sf0.1"
    got = registry.queries()[name](spark, sf).join(table(spark, sf, "labels"), "doc_id").toPandas()
    assert (got["held_out"] == [zlib.crc32(str(i).encode()) % mod == rest for i in got["doc_id"]]).all()
    out = got[got["held_out"]]
    assert out["score"].between(0, 1).all() and auc(out["score"].to_numpy(), out[label].to_numpy()) > 0.9


@pytest.mark.parametrize("module", [toxicity, quality_model])
def test_classifiers_awkward(spark, sf, docs, awkward, empty, module):
    labels = table(spark, sf, "labels")
    model = module.train(docs, labels)
    score = (lambda d: module.toxicity(d, labels, model)) if module is toxicity else (lambda d: module.quality_scores(d, labels, model))
    assert score(awkward).count() == awkward.count() and score(awkward).filter("score is null or score < 0 or score > 1").count() == 0
    assert score(empty).count() == 0
    blank = module.scored_by_fold(awkward, labels.limit(0))
    assert {r["score"] for r in blank.collect()} == {0.5} and blank.filter("doc_id is null and held_out").count() == 2


def test_sample_is_bounded(spark):
    """Repeated ids count once, in text and in label; bytes are bounded; a table's own columns of the same names do no harm."""
    docs = clashing(spark.createDataFrame([(7, "b" * 10)] * 3000 + [(i, "a" * 100) for i in range(20, 60)] + [(7, "a"), (None, "n"), (8, None)], "doc_id long, text string"))
    labels = spark.createDataFrame([(7, 1), (7, 0), (8, 1), (None, 1), (9, None), *((i, i % 2) for i in range(20, 60))], "doc_id long, toxic int")
    rows, counts = training.labelled_sample(docs, labels, "toxic", per_class=5)
    assert counts == {0: 21, 1: 21} and len(rows) == 10 and len({r["doc_id"] for r in rows}) == 10
    rows, _ = training.labelled_sample(docs, labels, "toxic", per_class=100)
    assert {(r["doc_id"], r["text"], r["label"]) for r in rows if r["doc_id"] < 20} == {(7, "a", 0), (8, "", 1)}
    few, _ = training.labelled_sample(docs, labels, "toxic", per_class=100, most_bytes=1000)
    assert 0 < sum(len(r["text"]) for r in few) <= 1000


def small_cnn(rng):
    model = toxicity.Model()
    for w in toxicity.WIDTHS:
        model.filters[w] = rng.standard_normal(model.filters[w].shape)
        model.bias[w] = rng.standard_normal(toxicity.FILTERS) * 0.1
    model.embedding = rng.standard_normal((toxicity.BUCKETS, toxicity.DIM)) * 0.5
    model.embedding[0] = 0
    model.out = rng.standard_normal(model.out.shape)
    return model


def slow_output(model, ids):
    """The network's output for one text's buckets, in plain loops."""
    z, k = model.shift, 0
    for w in toxicity.WIDTHS:
        for f in range(toxicity.FILTERS):
            best = 0.0
            for i in range(len(ids)):
                act = model.bias[w][f]
                for j in range(w):
                    if i + j < len(ids):  # beyond a text there is nothing
                        act += sum(model.embedding[ids[i + j]][d] * model.filters[w][j][d][f] for d in range(toxicity.DIM))
                best = max(best, act)
            z += best * model.out[k]
            k += 1
    return z


def test_op8_forward_and_gradients():
    """The scorer against plain loops, and the gradients against differences of the loss."""
    model = small_cnn(np.random.default_rng(5))
    texts = ["a b c d e", "one", "", "x y x y x, y"]
    ids, begin = toxicity.word_ids(texts, {})
    ends = [*begin[1:], ids.size]
    assert np.allclose(model.scorer(outputs=True)(texts), [slow_output(model, ids[a:b]) for a, b in zip(begin, ends)])
    labels = np.array([1, 0, 1, 0])

    def loss():
        z = np.array([slow_output(model, ids[a:b]) for a, b in zip(begin, ends)])
        return np.mean(np.log1p(np.exp(z)) - labels * z)

    grad, step = model.gradients(ids, begin, labels), 1e-5
    places = [(model.filters[w], grad[w], at) for w in toxicity.WIDTHS for at in ((0, 0, 0), (w - 1, 3, 2))]
    places += [(model.bias[w], grad["b", w], (1,)) for w in toxicity.WIDTHS] + [(model.out, grad["o"], (4,))]
    places += [(model.embedding, dict(zip(grad["rows"].tolist(), grad["e"]))[int(i)], (int(i),)) for i in ids[:3]]
    for weights, own, at in places:
        for d in [()] if np.ndim(weights[at]) == 0 else [(k,) for k in range(toxicity.DIM)]:
            was = weights[at + d]
            weights[at + d] = was + step
            up = loss()
            weights[at + d] = was - step
            down = loss()
            weights[at + d] = was
            assert (own[d] if np.ndim(own) == 1 and d else own[at]) == pytest.approx((up - down) / (2 * step), abs=2e-4)


def test_op8_thresholds_are_best():
    """No other cut between two scores has a better weighted F1; languages with few toxic documents take the common one."""
    rng = np.random.default_rng(6)
    for _ in range(30):
        n = int(rng.integers(2, 40))
        s, t, w = np.round(rng.random(n), 1), rng.integers(0, 2, n), rng.random(n)

        def f1(cut):
            p = s >= cut
            return 2 * (w * t * p).sum() / max((w * p).sum() + (w * t).sum(), 1e-12)

        cuts = np.unique(s)
        middle = (cuts[1:] + cuts[:-1]) / 2
        got = toxicity.best_threshold(s, t, w)
        if middle.size and got != 0.5:
            assert f1(got) == pytest.approx(max(map(f1, middle))) or f1(cuts[0]) >= max(map(f1, middle))


def test_op8_thresholds_on_all_labels(spark):
    """With a sample of 20 documents a class, all other labelled documents set the thresholds, also those by language."""
    rng, rows = np.random.default_rng(12), []
    for i in range(400):
        toxic = int(i % 4 == 0)
        words = [("bad" if rng.random() < (0.4 if toxic else 0.1) else "good") + str(rng.integers(0, 5)) for _ in range(12)]
        rows.append((i, " ".join(words), "de" if i % 3 else "en", toxic))
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, toxic int").repartition(3)
    model = toxicity.train(docs, docs, per_class=20)
    assert set(model.thresholds) == {"", "de", "en"}
    sample, _ = training.labelled_sample(docs, docs, "toxic", 20)
    fitted = {r["doc_id"] for i, r in enumerate(sample) if i % 5}
    rest = [r for r in rows if r[0] not in fitted]
    scores, truth = model.scorer()([r[1] for r in rest]), np.array([r[3] for r in rest])
    n = np.bincount(truth)
    weight = np.where(truth == 1, 100 / n[1], 300 / n[0])

    def f1(cut, own):
        p = scores >= cut
        return 2 * (weight * truth * p)[own].sum() / (weight * p + weight * truth)[own].sum()

    for lang, cut in model.thresholds.items():
        own = np.array([lang in ("", r[2]) for r in rest])
        # cuts within a step of the outputs are not told apart
        assert f1(cut, own) >= max(f1(x, own) for x in np.unique(scores[own])[1:]) - 0.005
    langs, labels, z, count = toxicity.labelled_outputs(docs, docs, "toxic", model, sorted(fitted))
    assert count.sum() == len(rest) and (count * labels).sum() == truth.sum()


def test_op8_thresholds_by_language(spark):
    """The query's verdict is by the threshold of the row's language, an unknown language's by the common one."""
    model = toxicity.Model()
    model.thresholds = {"": 0.4, "en": 0.0, "de": 1.1}
    docs = spark.createDataFrame([(1, "a", "en"), (2, "a", "de"), (3, "a", None), (4, "a", "xx")], "doc_id long, text string, lang string")
    got = {r["doc_id"]: (r["threshold"], r["toxic"]) for r in toxicity.toxicity(docs, docs, model).collect()}
    assert got[1] == (0.0, True) and got[2] == (1.1, False) and got[3][0] == got[4][0] == 0.4


def test_op9_forward_and_gradients():
    """The scorer against the plain average of a text's feature vectors, and the gradients against differences of the loss."""
    rng = np.random.default_rng(8)
    model = quality_model.Model()
    model.weights, model.bias = rng.standard_normal(model.weights.shape), np.array([0.1, -0.2])
    model.embedding = model.embedding.astype("f8")
    for text in ("alpha beta alpha", "x", "", "\u65e5\u672c\u8a9e ab"):
        words = text.split()
        flat, bounds = quality_model.word_features(list(dict.fromkeys(words)))
        at = {w: i for i, w in enumerate(dict.fromkeys(words))}
        rows = [b for w in words for b in flat[bounds[at[w]] : bounds[at[w] + 1]]]
        rows += quality_model.pair_features(np.array([flat[bounds[at[w]]] for w in words], np.int64)).tolist() if len(words) > 1 else []
        v = model.embedding[rows].mean(0) if rows else np.zeros(quality_model.DIM)
        z = v @ model.weights + model.bias
        assert model.scorer()([text])[0] == pytest.approx(1 / (1 + np.exp(z[0] - z[1])))
    rows, share, step = np.array([3, 9, 11]), np.array([0.5, 0.25, 0.25]), 1e-6

    def loss():
        z = share @ model.embedding[rows] @ model.weights + model.bias
        return np.log(np.exp(z).sum()) - z[1]

    dv, dw, db = model.gradients(rows, share, 1)
    for weights, own, at in [(model.weights, dw[2, 1], (2, 1)), (model.bias, db[0], (0,)), (model.embedding, share[1] * dv[4], (9, 4))]:
        was = weights[at]
        weights[at] = was + step
        up = loss()
        weights[at] = was - step
        down = loss()
        weights[at] = was
        assert own == pytest.approx((up - down) / (2 * step), abs=1e-5)


def test_op9_whole_words(monkeypatch):
    """A text without blanks counts to its end, in one window or several, in training and in scoring."""
    head = "".join(chr(0x4E00 + i) for i in range(64))
    tails = [chr(0x5000) * 40 + chr(0x5001 + i) for i in range(5)], [chr(0x6000) * 40 + chr(0x6001 + i) for i in range(5)]
    model = quality_model.Model()
    model.fit([head + t for t in (*tails[0], *tails[1])] * 20, ([0] * 5 + [1] * 5) * 20)
    texts = [head + chr(0x5000) * 50, head + chr(0x6000) * 50, "", "a b a", "ab " * 30]
    low, high, *_ = whole = model.scorer()(texts)
    assert low < 0.4 and high > 0.6
    word = "<" + texts[0] + ">"
    grams = [word[i : i + k] for k in quality_model.GRAMS for i in range(len(word) - k + 1)]
    assert np.diff(quality_model.word_features(texts[:1])[1]) == 1 + len(grams)
    for piece in range(1, 40):  # the last window is of any length
        monkeypatch.setattr(quality_model, "PIECE", piece)
        assert np.allclose(model.scorer()(texts), whole, atol=1e-12)


def test_op10_rollup(spark, sf, docs):
    rows = docs.collect()
    ids = pack_ids([r["text"] for r in rows])
    first = {}
    for r in rows:
        first[r["text"]] = min(r["doc_id"], first.get(r["text"], r["doc_id"]))
    want = Counter()
    for r, i in zip(rows, ids):
        if first[r["text"]] == r["doc_id"]:
            for k, v in (("d", 1), ("t", len(i) - 1), ("b", len((r["text"] or "").encode()))):
                want[r["source"], r["lang"], k] += v
    got = registry.op10_token_rollup(spark, sf).collect()
    assert {(r["source"], r["lang"]): (r["n_docs"], r["n_tokens"], r["n_bytes"]) for r in got} == {(s, g): tuple(want[s, g, k] for k in "dtb") for s, g, k in want if k == "d"}


def test_op10_recounts_the_table(spark, sf, docs, monkeypatch):
    """A batch of the query takes every document's count back under one tokenizer version and brings it in under another."""
    commit, seen = rollups.Rollup.commit, {}

    def watched(self, batch, changes):
        by = changes.groupBy("tokenizer_version", "sign").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("tokens")).collect()
        seen.setdefault(batch, {(r["tokenizer_version"], r["sign"]): (r["n"], r["tokens"]) for r in by})
        return commit(self, batch, changes)

    monkeypatch.setattr(rollups.Rollup, "commit", watched)
    total = {r["tokenizer_version"] for r in registry.op10_token_rollup(spark, sf).collect()}
    (load,), moved, n = seen["load"], seen["recount"], docs.count()
    assert len(total) == 1 and moved.keys() == {(load[0], -1), (*total, 1)} and load[0] not in total
    assert {v[0] for v in moved.values()} == {n} and moved[load[0], -1] == seen["load"][load] and len({v[1] for v in moved.values()}) == 2


def test_op10_batches(spark, awkward, empty):
    rollup = rollups.Rollup(spark, scratch(spark, "rollup"))
    counts = rollups.count_tokens(awkward, "byte_bpe_50k.json", "1").persist()
    assert rollup.commit("a", counts) and not rollup.commit("a", counts)
    assert rollup.totals().agg(F.sum("n_docs")).first()[0] == awkward.count()
    old = counts.filter("doc_id = 6")
    rollup.commit("b", rollups.revise(old, old.withColumn("n_tokens", F.lit(5).cast("long"))))
    rollup.commit("c", rollups.count_tokens(empty, "byte_bpe_50k.json", "1"))
    rollup.commit("d", rollups.retract(counts.filter("doc_id <> 6 or doc_id is null")))
    assert [(r["n_docs"], r["n_tokens"]) for r in rollup.totals().collect()] == [(1, 5)]


def test_op10_two_writers(spark, monkeypatch):
    """Both past every look at what is there: one raises, its batch is not taken for committed, and sending it again adds it once."""
    path = scratch(spark, "rollup")
    one = spark.createDataFrame([("s", None, "1", 1, 5, 9), (None, "en", "1", 1, None, 2)], "source string, lang string, tokenizer_version string, sign int, n_tokens long, n_bytes long")
    stale = rollups.Rollup(spark, path)
    assert rollups.Rollup(spark, path).commit("a", one)
    monkeypatch.setattr(stale, "version", lambda: 0)
    with pytest.raises(Conflict):
        stale.commit("b", one)
    monkeypatch.undo()
    assert not stale.has("b") and stale.has("a") and stale.commit("b", one) and not stale.commit("b", one)
    assert sorted((tuple(r) for r in stale.totals().collect()), key=str) == sorted([("s", None, "1", 2, 10, 18), (None, "en", "1", 2, 0, 4)], key=str)


def test_op10_hot_copies(spark, monkeypatch):
    """A text that holds a third of the rows is joined by broadcast, others by key: the same copies come out."""
    monkeypatch.setattr(shared, "HUB_ROWS", 20)
    rows = [(i, "hot" if i % 3 == 0 else f"t{i % 50}") for i in range(300)] + [(None, "hot"), (7, None), (0, "hot")]
    counts = spark.createDataFrame(rows, "doc_id long, text_hash string")
    first = {}
    for i, t in rows:
        if i is not None and t is not None:
            first[t] = min(i, first.get(t, i))
    want = sorted((i, t) for i, t in rows if i is not None and t is not None and i > first[t])
    assert sorted(map(tuple, rollups.copies_of(counts).collect())) == want


def test_long_runs_encode(spark):
    """Runs of blanks, letters and other signs of any length go through all three encoders, as the libraries have them."""
    texts = [" " * 60_000 + "x", "a " + "\u3000 \t" * 20_000 + "y", "abcdefghij" * 10_000, "#!" * 30_000 + "<|endoftext|>" + " " * 20_000 + "<|endoftext|>b", "\n" * 70_000, "\u65e5\u672c" * 9000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    check_packing(packing.best_fit_packing(df).collect(), dict(enumerate(pack_ids(texts))))
    huge = spark.createDataFrame([(1, " " * 5_000_000 + "x"), (2, "b" * 5_000_000), (3, "word" * 250_000)], "doc_id long, text string")
    pieces = {r["doc_id"]: r["n"] for r in packing.best_fit_packing(huge).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()}
    counted = {r["doc_id"]: r["n_tokens"] for r in rollups.count_tokens(huge.withColumns({"source": F.lit("s"), "lang": F.lit("en")}), "byte_bpe_50k.tiktoken", "1").collect()}
    coded_too = {r["doc_id"]: r["n_tokens"] for r in bytepair.encode_decode(huge, ids=False).collect()}
    assert counted == coded_too == {k: v - 1 for k, v in pieces.items()}

"""The corpus pipeline, stage by stage, against the operators' own brute-force rules."""

from collections import Counter

import corpus_pipeline as p
from pyspark.sql import functions as F
from test_llm import linked

from seamlight.llm import toxicity
from seamlight.llm.shared import table


def test_stages(spark, sf):
    assert [n for n, _ in p.STAGES] == ["toxicity", "quality_rules", "minhash_dedup", "packing"]
    docs = table(spark, sf, "documents")
    clean = p.drop_toxic(spark, docs, sf).persist()
    assert clean.columns == docs.columns
    flagged = {r["doc_id"] for r in toxicity.toxicity(docs, table(spark, sf, "labels")).filter("toxic").collect()}
    assert {r["doc_id"] for r in clean.collect()} == {r["doc_id"] for r in docs.collect()} - flagged
    good = p.keep_quality(spark, clean, sf).persist()
    assert good.columns == docs.columns and 0 < good.count() <= clean.count()
    single = p.drop_near_copies(spark, good, sf)
    want = linked({r["doc_id"]: r["text"] for r in good.collect()}, 5, 80)
    assert {r["doc_id"] for r in single.collect()} == {i for i, (_, c) in want.items() if i == c}


def test_run(spark, sf):
    out = p.run(spark, sf)
    assert out.count() > 0 and {"doc_id", "piece", "sequence_id", "offset"} <= set(out.columns)


def test_empty(spark, sf):
    none = table(spark, sf, "documents").limit(0)
    for _, stage in p.STAGES:
        assert stage(spark, none, sf).count() == 0


def test_rows_are_decided_one_by_one(spark, sf):
    """A null id is a document like others, and a sibling of the same id neither saves a row nor condemns it."""
    docs = table(spark, sf, "documents")
    kept = sorted(r["text"] for r in p.keep_quality(spark, docs, sf).collect())
    twins = docs.unionByName(docs.withColumn("text", F.lit("too short")))
    assert kept and not any(r["text"] == "too short" for r in p.keep_quality(spark, twins, sf).collect())

    words = [" ".join(f"{c}{i}" for i in range(30)) for c in "abcd"]
    rows = [(None, words[0]), (None, words[1]), (None, words[1]), (7, words[1]), (5, words[2]), (5, words[2]), (5, words[3]), (3, words[3]), (None, None)]
    got = p.drop_near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), sf).collect()
    assert Counter((r["doc_id"], r["text"]) for r in got) == Counter([(None, words[0]), (7, words[1]), (5, words[2]), (3, words[3]), (None, None)])


def test_awkward_rows(spark, sf):
    """Nulls in any column, empty and very long texts, ties, repeated rows and columns with clashing names, through all stages."""
    clean = [r["text"] for r in table(spark, sf, "labels").filter("quality = 1 and toxic = 0").join(table(spark, sf, "documents"), "doc_id").limit(3).collect()]
    long = " ".join(f"{w}{i}" for i in range(4000) for w in ("moal", "tirn", "veska", "oru"))
    rows = [(1, clean[0], "en", "s", 1), (1, clean[0], "en", "s", 1), (2, clean[0], None, None, None), (3, None, "en", "s", 0), (4, "", "en", "s", 0), (5, " \t\n", "xx", "s", 3), (6, long, "en", "s", 9), (None, clean[1], "en", "s", 1), (None, None, None, None, None), (7, clean[2], "de", "s", 1)]
    names = ("_score", "_Toxic", "_threshold", "_place", "score", "row", "key", "component_id", "kept", "own_id", "_text", "label", "n_shingles")
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({c: F.lit(False) for c in names})
    safe = p.drop_toxic(spark, docs, sf).persist()
    assert safe.columns == docs.columns and {r["_Toxic"] for r in safe.collect()} <= {False} and safe.count() > 0
    good = p.keep_quality(spark, docs, sf)
    assert good.columns == docs.columns and {r["text"] for r in good.collect()} <= {*clean, long}
    single = p.drop_near_copies(spark, docs, sf)
    assert single.columns == docs.columns
    got = Counter(r["text"] for r in single.collect())
    assert got == Counter([clean[0], None, "", " \t\n", long, clean[1], None, clean[2]])
    assert p.pack(spark, docs, sf).count() >= len(rows)

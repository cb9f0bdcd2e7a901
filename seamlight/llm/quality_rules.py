"""Quality rules (operator 5), in DataFrame functions only: surface rules, and a hashed n-gram log-likelihood ratio."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import BLANKS, materialise

#: Hash buckets of the two multinomials. Their ratios are the only thing that every task gets, as one array of so many
#: numbers, whatever the corpus. Unigrams and bigrams share the buckets; that a bucket stands for many n-grams of a large
#: corpus is the model, as in published data selection by hashed n-grams with 10,000 buckets.
BUCKETS = 1 << 16
#: Orders of word n-grams that are counted.
ORDERS = (1, 2)
#: Counts by which each bucket of the target is smoothed.
PRIOR = 4.0
#: A document is dropped if the mean log ratio of its n-grams is below this.
THRESHOLD = -0.2

_BLANK_CHARS = " \t\n\x0b\x0c\r"
_SYMBOLS = "[#*$%&|<>]"


def words_of(text: Column) -> Column:
    """Words between runs of blanks; none for a null or blank text."""
    inner = F.btrim(F.coalesce(text, F.lit("")), F.lit(_BLANK_CHARS))
    return F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, BLANKS))


def window_hashes(hashes: Column, window: int = 5) -> Column:
    """64-bit hashes that tell the windows of `window` words apart, in order, from the words' own hashes."""
    starts = F.when(F.size(hashes) >= window, F.sequence(F.lit(0), F.size(hashes) - window)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.xxhash64(*(F.get(hashes, i + k) for k in range(window))))


def covered_words(hashes: Column, window: int = 5) -> Column:
    """Words within windows that come twice or more.

    Sorted with their places, equal windows stand side by side; each such place then adds the words from the end of the
    one before, and at most a whole window. n log n in the words, whatever repeats.
    """
    pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(p: Column) -> Column:
        near = lambda j: F.get(p, j)["h"]
        again = lambda j: F.coalesce(near(j) == near(j - 1), F.lit(False)) | F.coalesce(near(j) == near(j + 1), F.lit(False))
        return F.sort_array(F.filter(F.transform(F.sequence(F.lit(0), F.size(p) - 1), lambda j: F.when(again(j), F.get(p, j)["i"])), lambda i: i.isNotNull()))

    # a one-element array binds the sorted pairs once for all places
    at = F.flatten(F.transform(F.array(pairs), places))
    return F.aggregate(
        at,
        F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")),
        lambda acc, i: F.struct((acc["n"] + F.lit(window) - F.greatest(acc["end"] - i, F.lit(0))).alias("n"), (i + window).alias("end")),
        lambda acc: acc["n"],
    )


def surface(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The counts of the base rules, and `_words`, for each row (null text: zeros)."""
    text = F.coalesce(F.col(text_column), F.lit(""))
    lines = F.transform(F.filter(F.split(F.col("_text"), "\n"), lambda x: F.btrim(x, F.lit(_BLANK_CHARS)) != ""), lambda x: F.xxhash64(x))
    out = docs.select(F.col(id_column), text.alias("_text")).withColumn("_words", words_of(F.col("_text"))).withColumn("_hashes", F.transform("_words", lambda w: F.xxhash64(w)))
    out = out.withColumn("_windows", window_hashes(F.col("_hashes"))).withColumn("_lines", lines)
    return out.select(
        id_column,
        "_words",
        F.size("_words").cast("long").alias("n_words"),
        F.aggregate("_words", F.lit(0).cast("long"), lambda s, w: s + F.length(w)).alias("word_chars"),
        (F.octet_length("_text") - F.octet_length(F.regexp_replace("_text", _SYMBOLS, ""))).cast("long").alias("n_symbols"),
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        F.when(F.size(F.array_distinct("_windows")) == F.size("_windows"), F.lit(0).cast("long")).otherwise(covered_words(F.col("_windows"))).alias("n_repeat_words"),
    )


def grams(words: Column, orders: tuple[int, ...] = ORDERS, buckets: int = BUCKETS) -> Column:
    """Hash buckets of all n-grams of the words, as an array<smallint>, which takes two bytes an n-gram in a shuffle."""
    if buckets > 1 << 16:
        raise ValueError("buckets must fit in 16 bits")

    def of(n: int) -> Column:
        bucket = lambda *w: (F.pmod(F.hash(*w), F.lit(buckets)) - (1 << 15)).cast("short")
        if n == 1:
            return F.transform(words, lambda w: bucket(w))
        starts = F.when(F.size(words) >= n, F.sequence(F.lit(0), F.size(words) - n)).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda i: bucket(*(F.get(words, i + k) for k in range(n))))

    return F.concat(*map(of, orders))


def ratio_table(corpus: DataFrame, target_ids: DataFrame, buckets: int = BUCKETS, id_column: str = "doc_id") -> DataFrame:
    """(bucket, llr): log of each bucket's share in the trusted target over its share in the whole corpus.

    The target's multinomial is smoothed towards the corpus's by PRIOR counts a bucket, so that buckets seen a few
    times say little whether or not one of those few documents is trusted. The ids are not broadcast, as they grow with
    the corpus: both sides of the join are dealt by id, whatever their size.
    `corpus` has the id and `_grams`. All rows are counted, with partial sums before a shuffle of at most `buckets`
    rows a task. Without a target row the ratio is 0 everywhere. Ids that come more than once in the target count once.
    """
    trusted = target_ids.select(F.col(id_column).alias("_id")).dropna().distinct().withColumn("_in", F.lit(1)).hint("merge")
    marked = corpus.select(id_column, "_grams").join(trusted, F.col(id_column) == F.col("_id"), "left")
    # not explode(): the filter that it implies would be pushed below the words and split the text again for each n-gram
    counts = marked.select("_in", F.explode_outer("_grams").alias("bucket")).groupBy("bucket").agg(F.count("*").alias("raw"), F.count("_in").alias("target"))
    counts = materialise(counts, "ratio").filter("bucket is not null")  # at most `buckets` rows
    raw, target = (x or 0 for x in counts.agg(F.sum("raw"), F.sum("target")).first())
    if not target:
        return counts.select("bucket", F.lit(0.0).alias("llr"))
    expected = F.col("raw") * F.lit(target / raw)
    return counts.select("bucket", F.log((F.col("target") + PRIOR) / (expected + PRIOR)).alias("llr"))


def ratio_array(ratios: DataFrame, buckets: int = BUCKETS) -> Column:
    """The ratios as one array by bucket, 0 where a bucket has none: a scalar subquery, whose one value each task gets once."""
    every = ratios.sparkSession.range(buckets).select((F.col("id") - (1 << 15)).cast("short").alias("bucket"))
    dense = every.join(ratios, "bucket", "left").agg(F.array_sort(F.collect_list(F.struct("bucket", F.coalesce("llr", F.lit(0.0)).alias("llr")))).alias("all"))
    return materialise(dense.select(F.transform("all", lambda x: x["llr"]).alias("ratios")), "ratios").scalar()


def mean_ratio(grams: Column, ratios: Column, least_one: Column) -> Column:
    """Mean of the n-grams' log ratios over `least_one`, how many there are, or 1 where there are none."""
    return F.aggregate(grams, F.lit(0.0), lambda s, g: s + F.get(ratios, g.cast("int") + (1 << 15))) / least_one


def quality_rules(docs: DataFrame, target_ids: DataFrame, corpus: DataFrame | None = None, threshold: float = THRESHOLD, orders: tuple[int, ...] = ORDERS, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Operator 5: one row per document with the base counts, base_failed, llr (mean log ratio) and kept.

    The two multinomials are counted over all of `corpus` (by default the documents themselves) and those of its rows
    whose id is in `target_ids`. Documents without n-grams have llr 0. A null text has no words: base_failed, not kept.
    Repeated rows and repeated or null ids each get their own row; other columns are dropped; an empty table gives an
    empty table. Scoring looks each n-gram up in one array, row by row: nothing is joined or shuffled, so neither a hot
    source nor a long text gathers anywhere.
    """
    count = sum((F.greatest(F.size("_words") - (n - 1), F.lit(0)) for n in orders), F.lit(0))
    base = surface(docs, id_column, text_column).withColumns({"_grams": grams(F.col("_words"), orders), "_count": F.greatest(count, F.lit(1))})
    # the words are a column of their own, or each n-gram would split the text anew
    counted = (docs if corpus is None else corpus).select(F.col(id_column), words_of(F.col(text_column)).alias("_words")).select(id_column, grams(F.col("_words"), orders).alias("_grams"))
    ratios = ratio_array(ratio_table(counted, target_ids, id_column=id_column))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    # the subquery is a column first, as it may not stand in a higher-order function; as every column below is used once,
    # the optimiser puts it back, so that no row carries the array
    mean = mean_ratio(F.col("_grams"), F.col("_ratios"), F.col("_count"))
    # a value that the optimiser may not compute twice keeps a later filter on the verdict above all this: pushed below, it
    # would split the text again for each n-gram
    once = F.when(F.monotonically_increasing_id() >= 0, F.round(mean, 9))
    rows = base.withColumn("_ratios", ratios).select(id_column, *names, once.alias("llr"))
    return rows.select(id_column, *names, failed.alias("base_failed"), (~failed & (F.col("llr") >= threshold)).alias("kept"), "llr")

"""Context assembly: retrieved chunks into one text within a budget."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import SPACE, token_estimate


def entries(results: DataFrame, budget: int = 3200, ratio: float = 3.5) -> DataFrame:
    """rank, chunk_id, entry, tokens, total (running), fits: the first entry that does not fit ends the context."""
    df = results.select("rank", "chunk_id", F.concat(F.lit("[Page "), F.col("page_number").cast("string"), F.lit("] "), F.col("text"), F.lit("\n\n")).alias("entry"))
    df = df.withColumn("tokens", token_estimate(F.col("entry"), ratio))
    order = Window.partitionBy().orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("total", F.sum("tokens").over(order)).withColumn("fits", F.col("total") <= budget)


def assemble(results: DataFrame, budget: int = 3200, ratio: float = 3.5) -> DataFrame:
    """One row: context, truncated, tokens.

    Entries go in while they fit. Of the first that does not, the part that the rest of the budget holds is added if
    more than ten tokens are left (cut between characters), and a note that the context was cut.
    """
    df = entries(results, budget, ratio)
    whole = df.groupBy().agg(
        F.array_sort(F.collect_list(F.when(F.col("fits"), F.struct("rank", "entry")))).alias("kept"),
        F.coalesce(F.max(F.when(F.col("fits"), F.col("total"))), F.lit(0)).alias("used"),
        F.min_by(F.when(~F.col("fits"), F.col("entry")), F.when(~F.col("fits"), F.col("rank"))).alias("next"),
    )
    left = F.lit(budget) - F.col("used")
    size = F.floor(left * F.lit(ratio)).cast("int")
    cut = F.expr("make_valid_utf8(cast(substring(encode(next, 'UTF-8'), 1, _size) as string))")
    part = F.when((left > 10) & (F.col("_size") < F.octet_length("next")), F.replace(cut, F.lit("�"), F.lit(""))).otherwise(F.lit(""))
    tail = F.when(F.col("next").isNull(), F.lit("")).otherwise(F.concat(part, F.lit("\n[Context truncated for length]")))
    text = F.concat(F.array_join(F.transform("kept", lambda e: e["entry"]), ""), tail)
    return whole.withColumn("_size", size).select(text.alias("context"), F.col("next").isNotNull().alias("truncated")).withColumn("tokens", token_estimate(F.col("context"), ratio))


def assemble_words(results: DataFrame, max_tokens: int = 2048, per_word: float = 1.3) -> DataFrame:
    """One row: context. Chunks that do not fit the word budget are skipped, later ones still tried."""
    budget = int(max_tokens / per_word)
    rows = F.array_sort(F.collect_list(F.struct("rank", "score", "text", F.size(F.split("text", SPACE)).alias("n"))))
    start = F.struct(F.lit(0).alias("used"), F.array().cast("array<string>").alias("parts"))

    def add(acc, r):
        line = F.concat(F.lit("["), r["rank"].cast("string"), F.lit("] (score: "), F.format_string("%.3f", r["score"]), F.lit(") "), r["text"])
        fits = acc["used"] + r["n"] <= budget
        return F.struct(F.when(fits, acc["used"] + r["n"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.array_append(acc["parts"], line)).otherwise(acc["parts"]).alias("parts"))

    return results.groupBy().agg(rows.alias("rows")).select(F.trim(F.array_join(F.aggregate("rows", start, add)["parts"], "\n\n")).alias("context"))

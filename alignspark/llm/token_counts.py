"""Token counts from the exact histogram of encoded lengths.

Documents are counted by encoded length; suffix sums over the lengths then
answer, for every context limit, how many documents reach it, how many tokens
they hold, what remains after truncation and what is cut, with quantiles from
the prefix sums.  Suffix sums are taken in two levels, within ranges of
``width`` lengths and over the ranges, so that no task holds all lengths.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import byte_bpe, common


def _lengths(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = byte_bpe.encoder(path)
        for batch in batches:
            counts: dict[int, int] = {}
            for text in batch.column(0).to_pylist():
                n = bpe.count(text)
                counts[n] = counts.get(n, 0) + 1
            yield pa.RecordBatch.from_pydict({"length": list(counts), "docs": list(counts.values())}, schema=pa.schema([("length", pa.int64()), ("docs", pa.int64())]))

    return run


def length_histogram(docs: DataFrame, tokenizer: str, text_col: str = "text") -> DataFrame:
    """length, docs: how many texts have that many tokens. Null counts as empty."""
    common.small_batches(docs.sparkSession)
    rows = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(_lengths(tokenizer), "length long, docs long").groupBy("length").agg(F.sum("docs").alias("docs"))


def suffix_sums(histogram: DataFrame, width: int = 4096) -> DataFrame:
    """For each length that occurs, taken as a context limit: counts, totals and quantile.

    docs_at, docs_ge (documents at least as long), tokens_ge (their tokens),
    total_tokens (of all), truncated_tokens (of all once cut to the limit),
    lost_tokens (what the cut takes off), quantile (share of documents no
    longer than the limit).  Limits between two lengths follow by ``answer``.
    """
    hist = common.written(histogram.withColumn("range", F.floor(F.col("length") / width)), "lengths")
    per = hist.groupBy("range").agg(F.sum("docs").alias("d"), F.sum(F.col("docs") * F.col("length")).alias("t"))
    after = Window.orderBy(F.col("range").desc()).rowsBetween(Window.unboundedPreceding, -1)
    totals = per.agg(F.sum("d").alias("all_docs"), F.sum("t").alias("total_tokens"))
    ranges = per.select("range", F.coalesce(F.sum("d").over(after), F.lit(0)).alias("d_after"), F.coalesce(F.sum("t").over(after), F.lit(0)).alias("t_after"))
    inside = Window.partitionBy("range").orderBy(F.col("length").desc())
    ge = hist.join(ranges, "range")
    ge = ge.withColumn("docs_ge", F.col("d_after") + F.sum("docs").over(inside)).withColumn("tokens_ge", F.col("t_after") + F.sum(F.col("docs") * F.col("length")).over(inside))
    first = totals.first()
    all_docs, total = (first[0] or 0), (first[1] or 0)
    lost = F.col("tokens_ge") - F.col("length") * F.col("docs_ge")
    return ge.select(
        F.col("length").alias("context_limit"),
        F.col("docs").alias("docs_at"),
        "docs_ge",
        "tokens_ge",
        F.lit(total).cast("long").alias("total_tokens"),
        (F.lit(total).cast("long") - lost).alias("truncated_tokens"),
        lost.alias("lost_tokens"),
        ((F.lit(all_docs) - F.col("docs_ge") + F.col("docs")) / F.lit(max(all_docs, 1))).alias("quantile"),
    )


def answer(sums: DataFrame, limit: int) -> dict[str, int]:
    """Totals for any context limit, from the smallest length that reaches it."""
    at = sums.where(F.col("context_limit") >= limit).orderBy("context_limit").first()
    total = sums.agg(F.max("total_tokens")).first()[0] or 0
    if at is None:
        return {"docs_ge": 0, "total_tokens": total, "truncated_tokens": total, "lost_tokens": 0}
    lost = at["tokens_ge"] - limit * at["docs_ge"]
    return {"docs_ge": at["docs_ge"], "total_tokens": total, "truncated_tokens": total - lost, "lost_tokens": lost}


def quantile(sums: DataFrame, q: float) -> int | None:
    """Smallest length that at least the share q of the documents does not exceed."""
    at = sums.where(F.col("quantile") >= q).orderBy("context_limit").first()
    return None if at is None else at["context_limit"]

"""Token counts as an exact histogram of document lengths.

One row per distinct encoded length; sums from either end answer totals, quantiles and truncated
totals for any context limit without another look at the texts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.scratch import written
from ledgerlake.llm.tokens import with_token_counts

BLOCK = 1024


def length_histogram(docs: DataFrame, text: str = "text", path: str | None = None, extra: int = 0) -> DataFrame:
    """Sums over documents by encoded length, one row per length that occurs.

    n_docs and n_tokens of this length; docs_at_most, docs_longer and tokens_longer around it; and
    truncated_tokens, the corpus when every document is cut to this length. A null or empty text has
    no tokens, besides `extra` for each document. Repeated rows count each. No documents, no rows.
    """
    counted = with_token_counts(docs.select(F.col(text).alias("text")), "text", "length", path, extra)
    return suffix_sums(counted.groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """The histogram of (length, n_docs). Sums run inside blocks of lengths and over the sums of blocks,
    so that no task needs more rows than a block has lengths, or there are blocks."""
    counts = written(
        counts.select("length", "n_docs", (F.col("length") * F.col("n_docs")).alias("n_tokens"), F.floor(F.col("length") / BLOCK).alias("block"))
    )
    later = Window.orderBy(F.col("block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    blocks = counts.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum("n_tokens").alias("t"))
    everything = Window.partitionBy()
    blocks = blocks.select(
        "block", F.coalesce(F.sum("d").over(later), F.lit(0)).alias("d_later"), F.coalesce(F.sum("t").over(later), F.lit(0)).alias("t_later"),
        F.sum("d").over(everything).alias("d_all"), F.sum("t").over(everything).alias("t_all"),
    )
    longer = Window.partitionBy("block").orderBy(F.col("length").desc()).rowsBetween(Window.unboundedPreceding, -1)
    docs_longer = F.coalesce(F.sum("n_docs").over(longer), F.lit(0)) + F.col("d_later")
    tokens_longer = F.coalesce(F.sum("n_tokens").over(longer), F.lit(0)) + F.col("t_later")
    return counts.join(blocks, "block").select(
        "length", "n_docs", "n_tokens", (F.col("d_all") - docs_longer).alias("docs_at_most"),
        docs_longer.alias("docs_longer"), tokens_longer.alias("tokens_longer"),
        (F.col("t_all") - tokens_longer + F.col("length") * docs_longer).alias("truncated_tokens"),
    )


def truncated_totals(histogram: DataFrame, limits: list[int]) -> DataFrame:
    """(context, truncated_tokens, docs_cut) for context limits of any size, from the histogram alone."""
    return (
        histogram.withColumn("context", F.explode(F.array(*[F.lit(int(x)).cast("bigint") for x in limits])))
        .groupBy("context")
        .agg(
            F.sum(F.least("length", "context") * F.col("n_docs")).alias("truncated_tokens"),
            F.sum(F.when(F.col("length") > F.col("context"), F.col("n_docs")).otherwise(0)).alias("docs_cut"),
        )
    )


def quantiles(histogram: DataFrame, shares: list[float]) -> DataFrame:
    """(share, length): the least length that at least this share of the documents doesn't exceed."""
    return (
        histogram.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
        .where(F.col("docs_at_most") >= F.col("share") * (F.col("docs_at_most") + F.col("docs_longer")))
        .groupBy("share")
        .agg(F.min("length").alias("length"))
    )

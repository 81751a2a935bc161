"""Order-dependent building blocks that never put one key, or the table, in one task.

A plain window over a hot key sorts that key in a single task. These helpers cut each
key's order into bounded buckets, work inside a bucket, and carry only one small row per
bucket across.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trust import floor_div
from ..session import cut_lineage


def previous_value(
    df: DataFrame, keys: list[str], seq: str, value: str, out: str, bucket_rows: int = 50_000
) -> DataFrame:
    """Lag of `value` in `seq` order per key. `seq` is an integer unique within the key.

    A bucket holds at most `bucket_rows` rows. Its first row takes the last value of the
    nearest earlier bucket, found over one row per bucket.
    """
    bucketed = df.withColumn("_bucket", floor_div(F.col(seq), bucket_rows))
    inside = Window.partitionBy(*keys, "_bucket").orderBy(seq)
    local = (
        bucketed.withColumn(out, F.lag(value).over(inside))
        .withColumn("_first", F.row_number().over(inside) == 1)
        .withColumn("_more", F.lead(F.lit(True), 1, False).over(inside))
    )
    # Taken from the windowed rows, so that both uses share one shuffle.
    tails = local.filter("NOT _more").select(*keys, "_bucket", F.col(value).alias("_tail"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    entry = tails.select(*keys, "_bucket", F.lag("_tail").over(across).alias("_entry"))
    return (
        local.join(entry, [*keys, "_bucket"])
        .withColumn(out, F.when(F.col("_first"), F.col("_entry")).otherwise(F.col(out)))
        .drop("_bucket", "_first", "_more", "_entry")
    )


def running_sum(
    df: DataFrame,
    keys: list[str],
    order: list[str],
    weight: Column | None = None,
    out: str = "position",
    partitions: int | None = None,
) -> DataFrame:
    """Inclusive running sum (a dense position by default) in `order` per key.

    A range sort spreads hot keys and ties over many partitions, since `order` ends in a
    unique column. The partition layout is checkpointed, because the carried offsets and the
    rows must come from the same layout even when an executor is lost.
    """
    weight = F.lit(1) if weight is None else weight
    parts = partitions or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    laid = cut_lineage(
        df.withColumn("_weight", weight.cast("bigint"))
        .repartitionByRange(parts, *keys, *order)
        .withColumn("_part", F.spark_partition_id())
    )
    inside = (
        Window.partitionBy("_part", *keys)
        .orderBy(*order)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    totals = laid.groupBy(*keys, "_part").agg(F.sum("_weight").alias("_total"))
    earlier = (
        Window.partitionBy(*keys)
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    offsets = totals.select(
        *keys, "_part", F.coalesce(F.sum("_total").over(earlier), F.lit(0)).alias("_offset")
    )
    return (
        laid.withColumn(out, F.sum("_weight").over(inside))
        .join(offsets, [*keys, "_part"])
        .withColumn(out, F.col(out) + F.col("_offset"))
        .drop("_part", "_offset", "_weight")
    )


def first_n(df: DataFrame, keys: list[str], order: list[Column], n: int, out: str = "rank") -> DataFrame:
    """Best `n` rows per key. Spark cuts each group to `n` rows before the shuffle."""
    ranked = df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order)))
    return ranked.filter(F.col(out) <= n)

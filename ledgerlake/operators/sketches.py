"""Stored daily sketches of distinct counts and quantiles, merged when asked.

Where a report over years would read every event again, it reads a few sketches a day. Sketches are
Spark's own aggregates, so they are built with partial aggregation and a hot group needs no
memory beyond its sketch. The exact forms are `reports.nearest_rank` and count distinct.

Bounds: a distinct count is off by at most three standard errors, 3 * 1.04 / sqrt(2 ** PRECISION), in
all but about 3 of 1000 cases; the rank of a quantile by less than RANK_ERROR in all but 1 of 100.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

PRECISION = 12
KLL_K = 800
RANK_ERROR = 0.01
DISTINCT_ERROR = 3 * 1.04 / math.sqrt(2**PRECISION)


def daily(rows: DataFrame, at: str, by: list[str], item: str, value: str) -> DataFrame:
    """(day, *by, n, items, spread): one row per day and group, with sketches of `item` and `value`.

    Null items and null or NaN values aren't counted by the sketches; `n` counts rows. Rows without
    a time have a null day. A group without any item or value has an empty sketch, and
    no quantiles.
    """
    number = F.col(value).cast("double")
    return rows.groupBy(F.to_date(at).alias("day"), *by).agg(
        F.count("*").alias("n"),
        F.hll_sketch_agg(F.col(item).cast("string"), F.lit(PRECISION)).alias("items"),
        F.kll_sketch_agg_double(F.when(~F.isnan(number), number), F.lit(KLL_K)).alias("spread"),
    )


def store(sketches: DataFrame, path: str) -> None:
    """Put whole days in place: written again they replace themselves, other days stay."""
    out = sketches.write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
    out.partitionBy("day").parquet(path)


def stored(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _merged_spread(spreads: Column) -> Column:
    # One sketch a day: the array has as many entries as there are days.
    return F.when(
        F.size(spreads) > 0,
        F.aggregate(F.slice(spreads, 2, F.size(spreads)), spreads[0], lambda a, b: F.kll_sketch_merge_double(a, b)),
    )


def merged(sketches: DataFrame, by: list[str], ps: dict[str, float]) -> DataFrame:
    """(*by, n, distinct_items, *ps) of all days of `sketches`, by groups that may be coarser than theirs."""
    # Days first: within a day and group the number of sketches is that of the finer groups.
    rows = sketches.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("items").alias("_items"), F.array_compact(F.collect_list("spread")).alias("_spreads")
    )
    rows = rows.withColumn("_spread", _merged_spread(F.col("_spreads")))
    # An empty sketch has no quantiles, and asking it for one is an error.
    some = F.when(F.kll_sketch_get_n_double("_spread") > 0, F.col("_spread"))
    quantiles = [F.kll_sketch_get_quantile_double(some, F.lit(p)).alias(name) for name, p in ps.items()]
    return rows.select(*by, "n", F.hll_sketch_estimate("_items").alias("distinct_items"), *quantiles)

"""Rolling admission control per submitter."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trust import floor_div
from ..schema import FLOOD_LIMIT, FLOOD_WINDOW_SECONDS


def flood_admission(
    df: DataFrame,
    actor: str,
    submitted: str,
    order_id: str,
    low: Column,
    limit: int = FLOOD_LIMIT,
    window_seconds: int = FLOOD_WINDOW_SECONDS,
) -> DataFrame:
    """Adds `prior` (earlier low-trust submissions in the trailing window, bounds included)
    and `held`. Rows at the same instant count in id order. `limit` 0 disables holding.

    A submitter may own a third of all rows, so the window is not taken over the submitter.
    Time is cut into spans of one window; each low row also visits the next span, the only
    other one it can influence, and the frame runs inside (submitter, span).
    """
    width = window_seconds * 1_000_000
    base = (
        df.withColumn("_us", F.unix_micros(F.col(submitted).cast("timestamp")))
        .withColumn("_low", low.cast("int"))
        .withColumn("_span", floor_div(F.col("_us"), width))
        .withColumn("_own", F.lit(True))
    )
    visitors = base.filter("_low = 1").select(
        F.col(actor), F.col(order_id), "_us", "_low", (F.col("_span") + 1).alias("_span"),
        F.lit(False).alias("_own"),
    )
    both = base.unionByName(visitors, allowMissingColumns=True)
    trailing = (
        Window.partitionBy(actor, "_span").orderBy("_us").rangeBetween(-width, Window.currentRow)
    )
    tied = (
        Window.partitionBy(actor, "_span", "_us")
        .orderBy(order_id)
        .rowsBetween(Window.currentRow, Window.unboundedFollowing)
    )
    counted = both.withColumn(
        "prior", F.sum("_low").over(trailing) - F.sum("_low").over(tied)
    ).filter("_own")
    held = (F.col("_low") == 1) & (F.col("prior") >= limit) if limit > 0 else F.lit(False)
    return counted.withColumn("held", held).drop("_us", "_low", "_span", "_own")

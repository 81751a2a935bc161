"""Tiering: access scores, significance, movement between tiers, user marks, tiered recall."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trust import (
    adjusted_importance,
    frequency_score,
    now_micros,
    salience,
    significance,
    tier_of,
    whole_days,
)
from ..session import cut_lineage
from .ordering import first_n


def access_counts(audit: DataFrame, now: datetime | int) -> DataFrame:
    """(memory_id, accesses, days_since) from 'searched' audit rows."""
    return (
        audit.filter("action = 'searched'")
        .groupBy("memory_id")
        .agg(F.count("*").alias("accesses"), F.max("timestamp").alias("_last"))
        .select("memory_id", "accesses", whole_days(F.col("_last"), now).alias("days_since"))
    )


def score(entries: DataFrame, accesses: DataFrame, now: datetime | int) -> DataFrame:
    """Adds frequency, salience, significance and tier.

    Needs id, created_at, kind, importance (1..10), contradictions, trust_score.
    """
    seen = accesses.withColumnRenamed("memory_id", "id")
    joined = entries.join(seen, "id", "left")
    count = F.coalesce("accesses", F.lit(0))
    return (
        joined.withColumn("frequency", frequency_score(count, F.coalesce("days_since", F.lit(0))))
        .withColumn("salience", salience(F.lit(1.0), whole_days(F.col("created_at"), now), F.col("kind")))
        .withColumn(
            "importance",
            adjusted_importance(F.col("importance"), F.col("contradictions"), F.col("trust_score")),
        )
        .withColumn(
            "significance",
            significance(
                F.col("importance"), F.col("frequency"), F.col("salience"),
                F.least(F.lit(1.0), F.col("contradictions") / 10.0),
            ),
        )
        .withColumn("tier", tier_of(F.col("significance")))
    )


def next_tier(
    tier: Column, score_: Column, days_in_tier: Column, idle_days: Column, expired: Column,
    pinned: Column, recalled: Column
) -> Column:
    """Promotion of recalled records first, then eviction; otherwise unchanged."""
    return (
        F.when(recalled & (tier == "L2") & (score_ >= 0.6), F.lit("L1"))
        .when(recalled & (tier == "L1") & (score_ >= 0.8), F.lit("L0"))
        .when((tier == "L1") & (score_ < 0.6) & (days_in_tier > 30), F.lit("L2"))
        .when((tier == "L2") & (score_ < 0.3) & (days_in_tier > 180) & (idle_days > 90), F.lit("L3"))
        .when((tier == "L0") & expired & ~pinned, F.lit("L1"))
        .otherwise(tier)
    )


def apply_marks(entries: DataFrame, marks: DataFrame, now: datetime | int) -> DataFrame:
    """Fold user marks (id, seq, mark, until) into important / pinned / archived columns.

    Marks: mark-important, unmark-important, pin, unpin, archive, delete, restore. The last
    mark of each pair decides.
    """

    def last(names: tuple[str, ...]) -> Column:
        mine = F.when(F.col("mark").isin(*names), F.col("seq"))
        return F.max_by(F.struct("mark", "until"), mine)

    folded = marks.groupBy("id").agg(
        last(("mark-important", "unmark-important")).alias("_imp"),
        last(("pin", "unpin")).alias("_pin"),
        last(("archive", "delete", "restore")).alias("_arc"),
    )
    def is_(group: str, *names: str) -> Column:
        return F.coalesce(F.col(f"{group}.mark").isin(*names), F.lit(False))

    alive = F.coalesce(F.unix_micros(F.col("_pin.until").cast("timestamp")) > now_micros(now), F.lit(True))
    return (
        entries.join(folded, "id", "left")
        .withColumn("important", is_("_imp", "mark-important"))
        .withColumn("pinned", is_("_pin", "pin") & alive)
        .withColumn("archived", is_("_arc", "archive", "delete"))
        .drop("_imp", "_pin", "_arc")
    )


def export_range(entries: DataFrame, start: datetime, end: datetime) -> DataFrame:
    return entries.filter((F.col("created_at") >= F.lit(start)) & (F.col("created_at") < F.lit(end)))


def hazard_route(flagged: Column, router_ok: Column) -> Column:
    """Routing before any index is touched: uncertain input waits for review."""
    return (
        F.when(~F.coalesce(router_ok, F.lit(False)), F.lit("held"))
        .when(flagged.isNull(), F.lit("held"))
        .when(flagged, F.lit("hazardous-candidate"))
        .otherwise(F.lit("production-candidate"))
    )


def tiered_recall(
    hits: DataFrame, limit: int, now: datetime | int, hot_enough: float = 0.9, warm_enough: float = 0.7,
    cold_days: int = 365,
) -> DataFrame:
    """Widen the search per query only while confidence is low.

    hits(query_id, id, tier, confidence, created_at). L0 answers alone when its best hit exceeds
    `hot_enough`; L0+L1 when the best exceeds `warm_enough`; else recent L2 joins. L3 never does.
    """
    best = cut_lineage(
        hits.groupBy("query_id").agg(
            F.max(F.when(F.col("tier") == "L0", F.col("confidence"))).alias("hot"),
            F.max(F.when(F.col("tier").isin("L0", "L1"), F.col("confidence"))).alias("warm"),
        )
    )
    recent = whole_days(F.col("created_at"), now) <= cold_days
    enough_hot = F.coalesce(F.col("hot") > hot_enough, F.lit(False))
    enough_warm = F.coalesce(F.col("warm") > warm_enough, F.lit(False))
    allowed = (
        (F.col("tier") == "L0")
        | ((F.col("tier") == "L1") & ~enough_hot)
        | ((F.col("tier") == "L2") & ~enough_hot & ~enough_warm & recent)
    )
    kept = hits.join(best, "query_id").filter(allowed).drop("hot", "warm")
    return first_n(kept, ["query_id"], [F.col("confidence").desc(), F.col("id")], limit)

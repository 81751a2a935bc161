"""Counts, distributions and health reports."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trust import decay, half_even, now_micros, whole_days
from ..session import cut_lineage
from .ordering import running_sum
from .state import cache_check


def counts(df: DataFrame, by: str | list[str], cube: bool = False) -> DataFrame:
    by = [by] if isinstance(by, str) else by
    grouped = df.cube(*by) if cube else df.groupBy(*by)
    return grouped.agg(F.count("*").alias("n"))


def trust_distribution(entries: DataFrame) -> DataFrame:
    t = F.col("trust_score").cast("double")
    return entries.agg(
        F.count("*").alias("total"),
        F.count_if(t >= 0.8).alias("high_trust"),
        F.count_if((t >= 0.5) & (t < 0.8)).alias("medium_trust"),
        F.count_if(t < 0.5).alias("low_trust"),
        F.round(F.avg(F.col("trust_score")), 3).cast("double").alias("avg_trust"),
    )


def is_stuck(now: datetime | int) -> Column:
    hour_ago = now_micros(now) - 3_600_000_000
    late = F.unix_micros(F.col("claimed_at").cast("timestamp")) < hour_ago
    return (F.col("status") == "failed") | ((F.col("status") == "processing") & F.coalesce(late, F.lit(False)))


def _metrics(*parts: DataFrame) -> DataFrame:
    """One-row frames of bigint columns as (metric, value) rows."""
    out = None
    for part in parts:
        pairs = [F.struct(F.lit(c).alias("metric"), F.col(c).cast("bigint").alias("value")) for c in part.columns]
        rows = part.select(F.explode(F.array(*pairs)).alias("p")).select("p.*")
        out = rows if out is None else out.unionByName(rows)
    return out


def health_summary(entries: DataFrame, inbox: DataFrame, queue: DataFrame, now: datetime | int) -> DataFrame:
    """(metric, value): active records, pending and held submissions, stuck conflict checks."""
    return _metrics(
        entries.agg(F.count_if(F.col("valid_until").isNull()).alias("active_memories")),
        inbox.agg(
            F.count_if(F.col("status") == "pending").alias("inbox_pending"),
            F.count_if(F.col("status") == "held").alias("inbox_held"),
        ),
        queue.agg(F.count_if(is_stuck(now)).alias("stuck_conflicts")),
    )


def integrity_report(
    entries: DataFrame,
    audit: DataFrame,
    events: DataFrame,
    queue: DataFrame,
    chain_rows: DataFrame,
    state_rows: DataFrame,
    now: datetime | int,
) -> DataFrame:
    """(metric, value) over chains (verify() results), cache, trust and queues."""
    live = entries.filter(F.col("valid_until").isNull())
    old = F.unix_micros("created_at") < now_micros(now) - 90 * 86_400_000_000
    t = F.col("trust_score").cast("double")
    known = entries.select(F.col("id").alias("target_memory_id"))
    audited = audit.select(F.col("memory_id").alias("id"))
    return _metrics(
        chain_rows.agg(
            F.min(F.col("chain_valid").cast("int")).alias("chain_valid"),
            F.sum("records_checked").alias("records_checked"),
        ),
        state_rows.agg(
            F.min(F.col("chain_valid").cast("int")).alias("state_chain_valid"),
            F.sum("records_checked").alias("events_checked"),
        ),
        cache_check(entries, events).agg(F.count("*").alias("cache_mismatches")),
        live.agg(
            F.count("*").alias("total"),
            F.count_if(t >= 0.8).alias("high_trust"),
            F.count_if((t >= 0.5) & (t < 0.8)).alias("medium_trust"),
            F.count_if(t < 0.5).alias("low_trust"),
            F.count_if((t >= 0.8) & old).alias("aging_high_trust"),
        ),
        queue.agg(F.count_if(is_stuck(now)).alias("stuck_conflicts")),
        events.join(known, "target_memory_id", "left_anti").agg(F.count("*").alias("orphaned_state_events")),
        live.join(audited, "id", "left_anti").agg(F.count("*").alias("memories_without_audit")),
    )


def decay_report(
    entries: DataFrame, now: datetime | int, days: int = 90, min_stored: float = 0.7, share: float = 0.8
) -> DataFrame:
    """Aged records that lost more than a fifth of their stored trust, worst first."""
    age = whole_days(F.col("created_at"), now)
    stored = F.col("trust_score").cast("double")
    old = F.unix_micros("created_at") < now_micros(now) - days * 86_400_000_000
    rows = (
        entries.filter(F.col("valid_until").isNull() & (stored >= min_stored) & old)
        .withColumn("age_days", age)
        .withColumn("_eff", decay(stored, F.col("age_days")))
        .filter(F.col("_eff") < stored * share)
    )
    return rows.select(
        "id", "memory_type", half_even(stored, 3).alias("stored_trust"),
        half_even(F.col("_eff"), 3).alias("effective_trust"), "age_days",
        F.substring("content", 1, 60).alias("content"),
    ).orderBy((F.col("stored_trust") - F.col("effective_trust")).desc(), "id")


def classifier_metrics(df: DataFrame, expected: Column, predicted: Column, latency: Column | None = None) -> DataFrame:
    """Confusion counts and ratios; with `latency` its mean and maximum too."""
    times = [] if latency is None else [half_even(F.avg(latency), 4).alias("latency_mean"), F.max(latency).alias("latency_max")]
    c = df.agg(
        F.count_if(expected & predicted).alias("true_positive"),
        F.count_if(~expected & ~predicted).alias("true_negative"),
        F.count_if(~expected & predicted).alias("false_positive"),
        F.count_if(expected & ~predicted).alias("false_negative"),
        *times,
    )
    tp, tn, fp, fn = (F.col(n) for n in c.columns[:4])

    def ratio(a: Column, b: Column) -> Column:
        return F.when(b > 0, half_even(a / b, 4)).otherwise(F.lit(0.0))

    return (
        c.withColumn("precision", ratio(tp, tp + fp))
        .withColumn("recall", ratio(tp, tp + fn))
        .withColumn("accuracy", ratio(tp + tn, tp + tn + fp + fn))
    )


def misjudged(df: DataFrame, id_col: str, expected: Column, predicted: Column) -> DataFrame:
    """(id, error) rows instead of id lists, so the size is not bound to one row."""
    return df.filter(expected != predicted).select(
        F.col(id_col).alias("id"),
        F.when(predicted, F.lit("false_positive")).otherwise(F.lit("false_negative")).alias("error"),
    )


def nearest_rank(df: DataFrame, value: str, by: list[str], ps: dict[str, float]) -> DataFrame:
    """Exact nearest-rank percentiles: the value at sorted index min(int(n * p), n - 1).

    Equal values are counted first; the cumulative count runs over a range sort, so neither a
    group nor the table has to fit one task.
    """
    if not by:
        one = nearest_rank(df.withColumn("_all", F.lit(1)), value, ["_all"], ps)
        return one.drop("_all")
    tally = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("cnt"))
    placed = running_sum(tally, by, [value], F.col("cnt"), out="upto")
    # Written, so that a few totals are broadcast and a hot group is not shuffled to join them.
    totals = cut_lineage(
        tally.groupBy(*by).agg(
            F.sum("cnt").alias("n"), (F.sum(F.col(value) * F.col("cnt")) / F.sum("cnt")).alias("mean")
        )
    )
    joined = placed.join(totals, by)
    picks = []
    for name, p in ps.items():
        index = F.least(F.floor(F.col("n") * p), F.col("n") - 1)
        inside = (index < F.col("upto")) & (index >= F.col("upto") - F.col("cnt"))
        picks.append(F.max(F.when(inside, F.col(value))).alias(name))
    return joined.groupBy(*by).agg(
        F.first("n").alias("n"), F.round(F.first("mean"), 6).alias("mean"), *picks
    )

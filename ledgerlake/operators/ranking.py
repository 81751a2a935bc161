"""Candidate pools and final ordering of search results, per query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.trust import half_even
from .ordering import first_n

POOL_CEILING = 50
TRUST_FLOOR_WEIGHT = 0.5
FLAGGED_WEIGHT = 0.3


def clamp_limit(n: int, ceiling: int | None = None) -> int:
    """At least 1; at most `ceiling`, where one is given."""
    return max(1, int(n) if ceiling is None else min(int(n), ceiling))


def pool_size(limit: int, mode: str, rerank: bool = False, provider_limit: int = 20, ceiling: int = POOL_CEILING) -> int:
    """Candidates to look at for a result of `limit`: never fewer than that."""
    limit = clamp_limit(limit)
    if mode == "fts":
        return max(limit, min(limit * 5, ceiling))
    if rerank:
        return max(limit, min(provider_limit, ceiling))
    return limit


def text_order() -> list[Column]:
    """Unflagged first, then relevance, aged trust, recency; id breaks what is left."""
    return [
        F.col("injection_flagged").asc(),
        F.col("rank").desc(),
        F.col("effective_trust").desc(),
        F.col("created_at").desc(),
        F.col("id").asc(),
    ]


def score_candidates(
    candidates: DataFrame, scores: DataFrame, keys: list[str], missing: Column | None = None
) -> DataFrame:
    """External relevance clamped to 0..1. `missing` (default 0) covers unscored candidates."""
    given = F.when(
        F.col("score").isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("score")))
    )
    fallback = F.lit(0.0) if missing is None else missing
    return (
        candidates.join(scores.select(*keys, "score"), keys, "left")
        .withColumn("relevance", F.coalesce(given, fallback))
        .drop("score")
    )


def safety_score(base: Column, effective: Column, flagged: Column) -> Column:
    """Relevance weighted by trust, cut hard when flagged."""
    weight = TRUST_FLOOR_WEIGHT + (1.0 - TRUST_FLOOR_WEIGHT) * effective
    weight = F.when(flagged, weight * FLAGGED_WEIGHT).otherwise(weight)
    return half_even(base * weight, 4)


def distance_relevance(distance: Column) -> Column:
    return half_even(1.0 - F.coalesce(distance, F.lit(0.5)), 4)


def safety_rerank(
    candidates: DataFrame, limit: int, per: list[str], position: str = "position"
) -> DataFrame:
    """Adds relevance_score and keeps the best `limit` per query, ties in prior order."""
    base = distance_relevance(F.col("distance"))
    if "relevance" in candidates.columns:
        base = F.coalesce(F.col("relevance"), base)
    scored = candidates.withColumn(
        "relevance_score", safety_score(base, F.col("effective_trust"), F.col("injection_flagged"))
    )
    order = [F.col("relevance_score").desc(), F.col(position).asc(), F.col("id").asc()]
    return first_n(scored, per, order, clamp_limit(limit), out="final_rank")

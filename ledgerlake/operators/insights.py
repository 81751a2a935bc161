"""Scheduled scans: clusters, stale procedures, weak signals, stuck conflicts."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.trust import now_micros
from ..schema import (
    CLUSTER_DISTANCE,
    CLUSTER_MIN_SIZE,
    CLUSTER_NEIGHBOURS,
    CLUSTER_TRUST_CAP,
)
from ..session import cut_lineage
from .defenses import meta
from .settling import greedy_select
from .simjoin import neighbours_within


def clusters(
    entries: DataFrame,
    threshold: float = CLUSTER_DISTANCE,
    min_size: int = CLUSTER_MIN_SIZE,
    neighbours: int = CLUSTER_NEIGHBOURS,
    trust_members: int = 10,
    listed: int = 20,
    seed_limit: int | None = None,
    **plan: int,
) -> DataFrame:
    """Greedy threshold clusters, newest seeds first: (seed_id, size, members, trust, content).

    A seed with enough neighbours forms a cluster and takes all its members as later seeds;
    a member may sit in several clusters. `seed_limit` keeps only the newest seeds, as a
    nightly run may want; the default looks at all.
    """
    current = entries.filter(F.col("valid_until").isNull())
    metadata = F.coalesce(F.col("metadata"), F.lit("{}"))
    unflagged = current.filter(~meta(metadata, "injection_flagged").eqNullSafe("true"))
    seeds = unflagged.filter(~meta(metadata, "insight_type").eqNullSafe("cluster")).select(
        "id", F.struct((-F.unix_micros("created_at")).alias("age"), F.col("id").alias("id")).alias("ord")
    )
    if seed_limit is not None:
        seeds = seeds.orderBy("ord").limit(seed_limit)
    near = cut_lineage(
        neighbours_within(
            unflagged.select("id", F.col("embedding").alias("vector")), neighbours, threshold, **plan
        )
    )
    cover = near.join(seeds, "id")
    qualified = cover.groupBy("id", "ord").agg((F.count("*") + 1).alias("size")).filter(
        F.col("size") >= min_size
    )
    taken = cover.join(qualified.select("id"), "id", "left_semi").select(
        "ord", F.col("neighbour_id").alias("thing")
    )
    settled = greedy_select(qualified, taken, qualified.select("ord", F.col("id").alias("thing")))
    chosen = settled.filter("accepted").select(F.col("id").alias("seed_id"), "size")
    members = (
        chosen.join(near.withColumnRenamed("id", "seed_id"), "seed_id")
        .select("seed_id", "size", F.col("neighbour_id").alias("id"), "rank")
        .unionByName(chosen.select("seed_id", "size", F.col("seed_id").alias("id"), F.lit(0).alias("rank")))
        .join(current.select("id", "trust_score", F.substring("content", 1, 50).alias("content")), "id")
    )
    ordered = F.array_sort(F.collect_list(F.struct("rank", "id", "trust_score", "content")))
    rows = members.groupBy("seed_id", "size").agg(ordered.alias("m"))
    return rows.select(
        "seed_id",
        "size",
        F.transform(F.slice("m", 1, listed), lambda x: x["id"]).alias("members"),
        F.least(
            F.lit(CLUSTER_TRUST_CAP),
            F.array_min(F.transform(F.slice("m", 1, trust_members), lambda x: x["trust_score"])),
        ).alias("trust_score"),
        F.concat(
            F.lit("Cluster: "),
            F.array_join(F.transform(F.slice("m", 1, 5), lambda x: x["content"]), " | "),
        ).alias("content"),
    )


def insight_records(found: DataFrame, actor: str, now: datetime) -> DataFrame:
    """Cluster insights as submissions, with lineage in the metadata."""
    return found.select(
        "content",
        F.lit("semantic").alias("memory_type"),
        "trust_score",
        F.lit(actor).alias("actor"),
        F.to_json(
            F.struct(
                F.lit("cluster").alias("insight_type"),
                F.col("members").alias("cluster_members"),
                F.col("members").alias("derived_from"),
                F.col("trust_score").alias("source_trust_min"),
                F.lit("insights").alias("daemon"),
                F.lit(now.isoformat()).alias("generated_at"),
            )
        ).alias("metadata"),
    )


def stale_procedures(entries: DataFrame, audit: DataFrame, now: datetime | int, days: int = 30) -> DataFrame:
    """Current procedures nobody searched lately and nobody flagged yet."""
    start = now_micros(now) - days * 86_400_000_000
    stamp = F.unix_micros(F.col("timestamp").cast("timestamp"))
    busy = audit.filter(
        ((F.col("action") == "searched") & (stamp > start)) | (F.col("action") == "stale_flagged")
    ).select(F.col("memory_id").alias("id"))
    return entries.filter(F.col("valid_until").isNull() & (F.col("memory_type") == "procedural")).join(
        busy, "id", "left_anti"
    )


def weak_groups(
    entries: DataFrame, group: str = "memory_type", below: float = 0.6, at_most: int = 2
) -> DataFrame:
    """Groups with only a few low-trust current records."""
    return (
        entries.filter(F.col("valid_until").isNull() & (F.col("trust_score") < below))
        .groupBy(group)
        .agg(F.count("*").alias("cnt"), F.avg(F.col("trust_score").cast("double")).alias("avg_trust"))
        .filter(F.col("cnt") <= at_most)
    )


def weak_signals(
    entries: DataFrame, group: str = "memory_type", below: float = 0.6, at_most: int = 2
) -> DataFrame:
    """The records of weak groups, each with its group's numbers. Flags again on every run."""
    low = entries.filter(F.col("valid_until").isNull() & (F.col("trust_score") < below))
    return low.join(cut_lineage(weak_groups(entries, group, below, at_most)), group)


def stuck_to_surface(queue: DataFrame, audit: DataFrame, now: datetime | int, hours: int = 24) -> DataFrame:
    """Failed conflict checks older than the cut-off, once per record."""
    start = now_micros(now) - hours * 3_600_000_000
    last = F.coalesce("finished_at", "claimed_at", "enqueued_at").cast("timestamp")
    told = audit.filter("action = 'contradiction_surfacing_needed'").select("memory_id")
    return queue.filter((F.col("status") == "failed") & (F.unix_micros(last) < start)).join(
        told, "memory_id", "left_anti"
    )


def scan_counts(
    entries: DataFrame, audit: DataFrame, queue: DataFrame, now: datetime | int, **cluster_args
) -> DataFrame:
    """(scan, found) of one scheduled run over all four scans."""
    scans = {
        "clusters": clusters(entries, **cluster_args),
        "stale_procedural": stale_procedures(entries, audit, now),
        "weak_signal": weak_groups(entries),
        "stuck_conflicts": stuck_to_surface(queue, audit, now),
    }
    out = None
    for name, found in scans.items():
        row = found.agg(F.count("*").alias("found")).select(F.lit(name).alias("scan"), "found")
        out = row if out is None else out.unionByName(row)
    return out

"""Retirement as chained events, and the views derived from them."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.crypto import canonical_state_event
from ..functions.text import is_blank
from ..functions.trust import floor_div
from .defenses import mask_redacted, read_defenses
from .ordering import running_sum


def requested_events(requests: DataFrame, entries: DataFrame) -> DataFrame:
    """Outcome per request (seq, event_type, target_memory_id, successor_memory_id, reason,
    actor): reject_reason, and the successor a redaction keeps.

    Requests take effect in seq order. The first accepted retirement of a record makes later
    ones fail, except redactions, which are always allowed on a known record.
    """
    known = entries.select(
        F.col("id").alias("target_memory_id"),
        F.col("valid_until").isNotNull().alias("_retired"),
        F.col("superseded_by").alias("_successor"),
        F.lit(True).alias("_known"),
    )
    staged = requests.join(known, "target_memory_id", "left").withColumn(
        "_basic",
        F.when(is_blank(F.col("reason")), F.lit("reason required"))
        .when(F.coalesce(F.col("actor"), F.lit("")) == "", F.lit("actor required"))
        .when(F.col("_known").isNull(), F.lit("record not found")),
    )
    first = (
        staged.filter(F.col("_basic").isNull() & ~F.coalesce("_retired", F.lit(False)))
        .groupBy("target_memory_id")
        .agg(
            F.min("seq").alias("_first"),
            F.min_by("successor_memory_id", "seq").alias("_first_successor"),
        )
    )
    late = F.col("_retired") | (F.col("seq") > F.col("_first"))
    kept = F.coalesce("_successor", F.when(F.col("seq") > F.col("_first"), F.col("_first_successor")))
    redact = F.col("event_type") == "redacted"
    return (
        staged.join(first, "target_memory_id", "left")
        .withColumn(
            "reject_reason",
            F.coalesce("_basic", F.when(late & ~redact, F.lit("already retired"))),
        )
        .withColumn(
            "successor_memory_id",
            F.when(redact, F.coalesce("successor_memory_id", kept)).otherwise(F.col("successor_memory_id")),
        )
        .drop("_retired", "_successor", "_known", "_basic", "_first", "_first_successor")
    )


def event_canonical(events: DataFrame) -> DataFrame:
    return events.withColumn(
        "canonical",
        canonical_state_event(
            F.col("event_type"), F.col("target_memory_id"), F.col("successor_memory_id"),
            F.col("reason"), F.col("valid_until"), F.col("key_id"),
        ),
    )


def fold_events(events: DataFrame) -> DataFrame:
    """(id, valid_until, superseded_by): first retirement time, last successor."""
    return events.groupBy(F.col("target_memory_id").alias("id")).agg(
        F.min_by("valid_until", "chain_seq").alias("valid_until"),
        F.max_by("successor_memory_id", "chain_seq").alias("superseded_by"),
    )


def current_view(entries: DataFrame, events: DataFrame) -> DataFrame:
    """Entries with retirement columns derived from the event log alone."""
    return entries.drop("valid_until", "superseded_by").join(fold_events(events), "id", "left")


def latest_events(events: DataFrame) -> DataFrame:
    """Last event per record."""
    rest = [c for c in events.columns if c != "target_memory_id"]
    return (
        events.groupBy("target_memory_id")
        .agg(F.max_by(F.struct(*rest), "chain_seq").alias("e"))
        .select("target_memory_id", "e.*")
    )


def cache_check(entries: DataFrame, events: DataFrame) -> DataFrame:
    """(id, mismatch) where retirement columns and the event log disagree."""
    last = events.groupBy(F.col("target_memory_id").alias("id")).agg(
        F.max_by("successor_memory_id", "chain_seq").alias("event_successor"),
        F.lit(True).alias("in_log"),
    )
    retired = entries.filter(
        F.col("valid_until").isNotNull() | F.col("superseded_by").isNotNull()
    ).select("id", "superseded_by", F.lit(True).alias("in_columns"))
    return (
        retired.join(last, "id", "full_outer")
        .withColumn(
            "mismatch",
            F.when(F.col("in_log").isNull(), F.lit("retired in columns, no event"))
            .when(F.col("in_columns").isNull(), F.lit("event exists, columns not set"))
            .when(~F.col("superseded_by").eqNullSafe(F.col("event_successor")), F.lit("successor differs")),
        )
        .filter(F.col("mismatch").isNotNull())
        .select("id", "mismatch")
    )


def audit_pages(audit: DataFrame, page_rows: int = 1_000) -> DataFrame:
    """(memory_id, page, events): audit trails in (timestamp, id) order, cut into pages.

    A record may own very many events, so its trail is numbered over a range sort and nested
    per page instead of per record. A short trail is one page.
    """
    placed = running_sum(audit, ["memory_id"], ["timestamp", "id"])
    event = F.struct("position", "timestamp", "action", "actor", "details")
    return (
        placed.groupBy("memory_id", floor_div(F.col("position") - 1, page_rows).alias("page"))
        .agg(F.array_sort(F.collect_list(event)).alias("events"))
    )


def audit_trail(
    entries: DataFrame,
    audit: DataFrame,
    state_events: DataFrame,
    checked: DataFrame,
    now: datetime | int,
    page_rows: int = 1_000,
) -> tuple[DataFrame, DataFrame]:
    """Records behind the read defences, with redaction mask and integrity verdict (id, record_ok), and
    their trail pages. A flagged text is wrapped here as in a search; the mask wins over the wrap."""
    masked = mask_redacted(read_defenses(entries, now), state_events).join(checked.select("id", "record_ok"), "id", "left")
    return masked.withColumn("valid", F.col("valid_until").isNull()), audit_pages(audit, page_rows)


def revise(entries: DataFrame, revisions: DataFrame, now: datetime) -> tuple[DataFrame, DataFrame]:
    """Successor submissions and supersede requests for revisions (seq, target, content, reason,
    actor, successor). Only current records can be revised; the first revision of one wins."""
    live = entries.filter(F.col("valid_until").isNull()).select(
        F.col("id").alias("target"), "memory_type"
    )
    firsts = revisions.groupBy("target").agg(F.min("seq").alias("seq"))
    valid = revisions.join(firsts, ["target", "seq"], "left_semi").join(live, "target")
    successors = valid.select(
        F.col("successor").alias("id"), "content", "memory_type", F.lit(0.9).alias("trust_score"), "actor",
        F.to_json(F.struct(F.col("target").cast("string").alias("revises"), "reason")).alias("metadata"),
        F.col("target").alias("amended_from"),
    )
    requests = valid.select(
        "seq", F.lit("superseded").alias("event_type"), F.col("target").alias("target_memory_id"),
        F.col("successor").alias("successor_memory_id"), "reason", "actor", F.lit(now).alias("valid_until"),
    )
    return successors, requests

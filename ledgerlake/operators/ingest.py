"""Write path: admission rules, screening, classification and the governed record."""

from __future__ import annotations

from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.crypto import canonical_json, canonical_record, json_string
from ..functions.trust import clamp, floor_div, half_even, now_micros, trust_error
from ..schema import (
    AGENT_CEILING,
    CONTENT_CLASSES,
    FLAGGED_CEILING,
    MEMORY_TYPES,
    SERVER_OWNED_KEYS,
)
from .defenses import meta
from .gates import Rule, write_gate
from .ordering import first_n


def scrub_metadata(metadata: Column, drop: tuple[str, ...] = SERVER_OWNED_KEYS) -> Column:
    """Metadata text without the keys untrusted callers may not set."""
    as_map = F.try_parse_json(metadata).cast("map<string,variant>")
    return F.to_json(F.map_filter(as_map, lambda k, v: ~k.isin(*drop)))


def resolved_class(declared: Column, metadata: Column) -> Column:
    return F.coalesce(declared, meta(metadata, "content_class"), F.lit("general"))


def clamped_trust(declared: Column, ceiling: float = AGENT_CEILING) -> dict[str, Column]:
    value = declared.cast("double")
    over = F.coalesce(value > ceiling, F.lit(False))
    return {"trust": F.when(over, F.lit(ceiling)).otherwise(value), "was_clamped": over}


def split_session(session: Column) -> dict[str, Column]:
    """Canonical UUID, or NULL with the original kept as a label."""
    bare = F.regexp_replace(F.lower(session), r"^urn:uuid:|[{}-]", "")
    is_uuid = bare.rlike("^[0-9a-f]{32}$")
    dashed = F.regexp_replace(bare, "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")
    return {
        "session_id": F.when(is_uuid, dashed),
        "session_label": F.when(session.isNotNull() & ~is_uuid, session),
    }


def write_error(
    content: Column, memory_type: Column, actor: Column, trust: Column, dims: Column, index_dims: int
) -> Column:
    """NULL when the write is acceptable, else the first reason in checking order."""
    return (
        F.when(tx.is_blank(content), F.lit("content must be non-empty"))
        .when(~F.coalesce(memory_type.isin(*MEMORY_TYPES), F.lit(False)), F.lit("unknown memory_type"))
        .when(F.coalesce(actor, F.lit("")) == "", F.lit("actor is required"))
        .when(trust_error(trust).isNotNull(), trust_error(trust))
        .when(~F.coalesce(dims == index_dims, F.lit(False)), F.lit("wrong embedding dimensions"))
    )


def admit(df: DataFrame, ceiling: float = AGENT_CEILING) -> DataFrame:
    """Boundary rules for agent submissions: class, ceiling, server-owned keys.

    Needs content, memory_type, trust_score, actor, content_class, metadata.
    """
    clamped = clamped_trust(F.col("trust_score"), ceiling)
    declared = resolved_class(F.col("content_class"), F.col("metadata"))
    return (
        df.withColumn("class_ok", declared.isin(*CONTENT_CLASSES))
        .withColumn("content_class", tx.inferred_class(F.col("content"), declared, F.col("actor")))
        .withColumn("metadata", F.coalesce(scrub_metadata(F.col("metadata")), F.lit("{}")))
        .withColumn(
            "metadata",
            F.when(
                clamped["was_clamped"],
                merge_metadata(
                    F.col("metadata"),
                    {
                        "declared_trust": F.col("trust_score").cast("double").cast("string"),
                        "trust_clamped_to": F.lit(str(ceiling)),
                    },
                ),
            ).otherwise(F.col("metadata")),
        )
        .withColumn("trust_score", clamped["trust"])
    )


def merge_metadata(metadata: Column, fields: Mapping[str, Column]) -> Column:
    """Add top-level JSON fields (JSON text; NULL values are left out). Later fields win."""
    pairs = [
        F.when(value.isNotNull(), F.concat(json_string(F.lit(name)), F.lit(":"), value))
        for name, value in fields.items()
    ]
    extra = F.concat_ws(",", *pairs)
    kept = F.coalesce(scrub_metadata(metadata, tuple(fields)), F.lit("{}"))
    body = F.regexp_replace(kept, r"^\{|\}$", "")
    both = F.concat_ws(",", F.when(body != "", body), F.when(extra != "", extra))
    return F.concat(F.lit("{"), both, F.lit("}"))


def classify(df: DataFrame, nearest: DataFrame | None = None, **at: float) -> DataFrame:
    """Heuristic verdict per submission(id, content, caller_type, caller_trust).

    `nearest` (id, duplicate_id, distance) carries the closest current record, if any.
    """
    content, kind, trust = F.col("content"), F.col("caller_type"), F.col("caller_trust")
    if nearest is not None:
        df = df.join(nearest, "id", "left")
    else:
        df = df.withColumn("duplicate_id", F.lit(None).cast(df.schema["id"].dataType)).withColumn("distance", F.lit(None).cast("double"))
    staged = df.withColumn("durability", tx.durability(content, kind)).withColumn(
        "_importance", tx.importance(content, kind, trust.cast("double"))
    )
    routed = tx.route(F.col("distance"), F.col("durability"), F.col("_importance"), **at)
    return (
        staged.withColumn("status", routed["status"])
        .withColumn("importance", half_even(F.col("_importance"), 2))
        .withColumn("urgency", tx.urgency(F.col("durability"), F.col("_importance")))
        .withColumn("encoding", tx.encoding(content))
        .withColumn("suggested_type", tx.corrected_type(content, kind))
        .withColumn(
            "suggested_trust",
            half_even(tx.calibrated_trust(trust.cast("double"), F.col("durability")), 2),
        )
        .withColumn("near_duplicate_of", F.when(routed["has_duplicate"], F.col("duplicate_id")))
        .withColumn("duplicate_distance", half_even(F.col("distance"), 4))
        .withColumn("merge_strategy", routed["merge_strategy"])
        .withColumn("requires_review", routed["requires_review"])
        .withColumn(
            "review_reason",
            F.when(
                routed["requires_review"],
                F.format_string(
                    "near-duplicate of %s (distance=%.3f)", F.col("duplicate_id").cast("string"), F.col("distance")
                ),
            ),
        )
        .withColumn("rejection_reason", routed["rejection_reason"])
        .drop("_importance", "duplicate_id", "distance")
    )


def top_keywords(df: DataFrame, n: int = 20) -> DataFrame:
    """(id, keywords): most frequent first, earlier first occurrence wins ties."""
    occurrences = df.select("id", F.posexplode(tx.keyword_tokens(F.col("content"))).alias("pos", "word"))
    counted = occurrences.groupBy("id", "word").agg(
        F.count("*").alias("n"), F.min("pos").alias("first")
    )
    best = first_n(counted, ["id"], [F.col("n").desc(), F.col("first").asc()], n)
    return best.groupBy("id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "word"))), lambda x: x["word"]).alias(
            "keywords"
        )
    )


def second_pass(df: DataFrame, verdicts: DataFrame, trust_skip: float = 0.8) -> DataFrame:
    """Model verdicts (id, model_flagged) for regex-clean, low-trust rows; absent means clean."""
    eligible = ~F.col("injection_flagged") & (F.col("trust_score") < trust_skip)
    hit = eligible & F.coalesce(F.col("model_flagged"), F.lit(False))
    return (
        df.join(verdicts.select("id", "model_flagged"), "id", "left")
        .withColumn("llm_injection_flagged", hit)
        .withColumn("injection_flagged", F.col("injection_flagged") | F.col("llm_injection_flagged"))
        .withColumn(
            "trust_score",
            F.when(F.col("llm_injection_flagged"), F.least(F.col("trust_score"), F.lit(FLAGGED_CEILING))).otherwise(
                F.col("trust_score")
            ),
        )
        .drop("model_flagged")
    )


def hold_flagged(df: DataFrame) -> DataFrame:
    """Would-be writes with an injection flag are held, naming the layer that caught them."""
    stop = F.col("status").isin("approved", "merged") & F.col("any_flagged")
    return (
        df.withColumn(
            "review_reason",
            F.when(stop, F.when(F.col("regex_flagged"), F.lit("regex_injection")).otherwise(F.lit("llm_classifier")))
            .otherwise(F.col("review_reason")),
        )
        .withColumn("requires_review", F.col("requires_review") | stop)
        .withColumn("status", F.when(stop, F.lit("held")).otherwise(F.col("status")))
    )


def screened(
    df: DataFrame,
    rules: list[Rule],
    index_dims: int,
    embed: Callable[[DataFrame], DataFrame] = lambda rows: rows,
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """Screened, gated and embedded rows with a reject_reason; rows are rejected, never dropped.

    Needs id, content, memory_type, trust_score, actor, session_id, metadata, content_class. Without
    `embed` the rows carry their embedding already.
    """
    clean = tx.sanitise(F.col("content"), F.col("_trust"), F.col("content_class"), flagged=F.col("injection_flagged"))
    session = split_session(F.col("session_id"))
    staged = (
        df.withColumn("_trust", clamp(F.col("trust_score")))
        .withColumn("_bad_trust", trust_error(F.col("trust_score")))
        # A generator is not merged into what reads it, so a text is screened once and not for each use of its flag.
        .withColumn("injection_flagged", F.explode(F.array(tx.injection_flag(F.col("content")))))
        .withColumn("trust_override_reason", clean["override_reason"])
        .withColumn("content", clean["content"])
        .withColumn(
            "trust_score",
            tx.flagged_trust(
                F.col("_trust"), F.col("injection_flagged"), F.col("trust_override_reason")
            ),
        )
        .withColumn("session_label", session["session_label"])
        .withColumn("session_id", session["session_id"])
    )
    gate = write_gate(
        F.col("memory_type"), F.col("content_class"), F.col("trust_score"), F.col("actor"), rules
    )
    staged = staged.withColumn("_deny", gate["deny_reason"]).withColumn("trust_score", gate["trust_score"])
    if verdicts is not None:
        staged = second_pass(staged, verdicts)
    else:
        staged = staged.withColumn("llm_injection_flagged", F.lit(False))
    ready = embed(staged)
    problem = write_error(
        F.col("content"), F.col("memory_type"), F.col("actor"), F.col("_trust"),
        F.col("embedding_dimensions"), index_dims,
    )
    # `admit` judged the class that was declared, before it was inferred anew.
    known = F.col("class_ok") if "class_ok" in df.columns else F.coalesce(F.col("content_class").isin(*CONTENT_CLASSES), F.lit(True))
    unknown = F.when(~known, F.lit("unknown content_class"))
    return ready.withColumn("reject_reason", F.coalesce(unknown, F.col("_bad_trust"), problem, F.col("_deny"))).drop("_trust", "_bad_trust", "_deny")


def sealed(df: DataFrame, key_id: str = "k1") -> DataFrame:
    """Screened rows with their final metadata, content hash and canonical text."""
    yes = F.lit("true")
    fields = {
        "content_class": json_string(F.col("content_class")),
        "session_label": json_string(F.col("session_label")),
        "injection_flagged": F.when(F.col("injection_flagged"), yes),
        "llm_injection_flagged": F.when(F.col("llm_injection_flagged"), yes),
        "trust_override_reason": json_string(F.col("trust_override_reason")),
    }
    return (
        df.withColumn("metadata", canonical_json(merge_metadata(F.col("metadata"), fields)))
        .withColumn("key_id", F.lit(key_id))
        .withColumn("content_hash", tx.content_hash(F.col("content")))
        .withColumn(
            "canonical",
            canonical_record(
                F.col("content"), F.col("embedding_model"), F.col("embedding_dimensions"),
                F.col("trust_score"), F.col("memory_type"), F.col("key_id"), F.col("metadata"),
            ),
        )
        .drop("session_label")
    )


def govern(
    df: DataFrame,
    rules: list[Rule],
    index_dims: int,
    embed: Callable[[DataFrame], DataFrame],
    key_id: str = "k1",
    verdicts: DataFrame | None = None,
) -> DataFrame:
    """Screened, gated and embedded records with their canonical text and a reject_reason."""
    return sealed(screened(df, rules, index_dims, embed, verdicts), key_id)


def created_events(records: DataFrame, now: datetime) -> DataFrame:
    """Audit rows of accepted writes."""
    return records.filter("reject_reason IS NULL").select(
        F.col("id").alias("memory_id"),
        F.lit("created").alias("action"),
        "actor",
        F.lit(now).alias("timestamp"),
        F.to_json(F.struct("trust_score", "injection_flagged", "content_class")).alias("details"),
    )


def review_actions(inbox: DataFrame, decisions: DataFrame, now: datetime) -> DataFrame:
    """Apply approve / reject / retry decisions (id, action, reason) to held submissions."""
    held = (F.col("status") == "held") & F.col("action").isNotNull()
    target = (
        F.when(F.col("action") == "approve", F.lit("approved"))
        .when(F.col("action") == "reject", F.lit("rejected"))
        .when(F.col("action") == "retry", F.lit("pending"))
    )
    done = held & F.col("action").isin("approve", "reject")
    retried = held & (F.col("action") == "retry")
    return (
        inbox.join(decisions.select("id", "action", "reason"), "id", "left")
        .withColumn("rejection_reason", F.when(held & (F.col("action") == "reject"), F.col("reason")))
        .withColumn("processed_at", F.when(done, F.lit(now)))
        .withColumn("retry_count", F.when(retried, F.lit(0)).otherwise(F.col("retry_count")))
        .withColumn("status", F.coalesce(F.when(held, target), F.col("status")))
        .drop("action", "reason")
    )


def held_list(inbox: DataFrame, limit: int) -> DataFrame:
    """Held submissions for review, oldest first, with a content preview."""
    return (
        inbox.filter("status = 'held'")
        .withColumn("content", F.substring("content", 1, 120))
        .orderBy("submitted_at", "id")
        .limit(limit)
    )


def after_failure(status: Column, retries: Column, final: str, attempts: int = 3) -> dict[str, Column]:
    """Retry policy: back to pending until the attempts are used up."""
    used = retries + 1
    return {
        "status": F.when(used >= attempts, F.lit(final)).otherwise(F.lit("pending")),
        "retry_count": used,
    }


def reclaimable(status: Column, claimed_at: Column, now: datetime | int, hours: int = 1) -> Column:
    late = F.unix_micros(claimed_at.cast("timestamp")) < now_micros(now) - hours * 3_600_000_000
    return (status == "pending") | ((status == "processing") & F.coalesce(late, F.lit(False)))


def session_summaries(
    turns: DataFrame, session: str, turn: str, line: Column, page_turns: int | None = None
) -> DataFrame:
    """One episodic record per session: its turn lines in order.

    A session is one record, so it has to fit one row. With `page_turns` it becomes a record for
    every so many turns, numbered from 0 in `page`.
    """
    paged = turns.select(
        F.col(session).alias("session"),
        (floor_div(F.col(turn), page_turns) if page_turns else F.lit(0).cast("bigint")).alias("page"),
        F.col(turn).alias("turn"),
        line.alias("line"),
    )
    return paged.groupBy("session", "page").agg(
        F.count("*").alias("n_turns"),
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n"
        ).alias("content"),
    ).withColumn("memory_type", F.lit("episodic")).withColumn(
        "metadata", F.lit('{"is_session_summary":true}')
    )


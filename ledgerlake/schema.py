"""Schemas, enums and fixed values shared by every operator."""

from __future__ import annotations

from pyspark.sql import types as T

# --- Fixed values: the enums and numbers below define result semantics. ---
MEMORY_TYPES = ("preference", "identity", "episodic", "semantic", "procedural", "transient")
CONTENT_CLASSES = ("general", "security-doc", "code-sample", "external-untrusted")

READ_RULES = (
    "exclude_memory_type",
    "min_trust_floor",
    "exclude_tag",
    "exclude_content_class",
    "max_results",
)
WRITE_RULES = ("deny_write_memory_type", "max_trust_for_content_class")

SERVER_OWNED_KEYS = (
    "injection_flagged",
    "llm_injection_flagged",
    "trust_override_reason",
    "insight_type",
    "derived_from",
    "source_trust_min",
    "cluster_members",
    "is_session_summary",
    "imported_from",
    "declared_trust",
    "trust_clamped_to",
    "daemon",
    "generated_at",
)

MIN_TRUST, MAX_TRUST = 0.3, 1.0
FLAGGED_CEILING = 0.3
AGENT_CEILING = 0.6
IMPORT_CEILING = 0.3
PROCEDURE_FLOOR = 0.7
CONFIRMED_TRUST = 0.9

DEDUP_REJECT, DEDUP_MERGE, DEDUP_REVIEW = 0.10, 0.15, 0.22
CLUSTER_DISTANCE, CLUSTER_MIN_SIZE, CLUSTER_NEIGHBOURS = 0.25, 3, 50
CLUSTER_TRUST_CAP = 0.5
CONFLICT_NEIGHBOURS = 5
SIMILARITY_ABOVE, TRUST_DELTA = 0.7, 0.4
FLOOD_LIMIT, FLOOD_WINDOW_SECONDS, FLOOD_TRUST = 20, 300, 0.6
PRECEDENT_STEP, PRECEDENT_CEILING, PRECEDENT_FLOOR, PRECEDENT_BASE = 0.1, 1.0, 0.3, 0.5
UNKNOWN_SOURCE = "unknown-source"
ARCHIVE_SCHEMA_VERSION = "1.0"
REDACTED_TEXT = "[REDACTED]"

ENTRY = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("content_hash", T.StringType()),
        T.StructField("embedding", T.ArrayType(T.FloatType())),
        T.StructField("embedding_model", T.StringType()),
        T.StructField("embedding_dimensions", T.IntegerType()),
        T.StructField("embedded_at", T.TimestampType()),
        T.StructField("metadata", T.StringType()),
        T.StructField("trust_score", T.DecimalType(3, 2)),
        T.StructField("memory_type", T.StringType()),
        T.StructField("prev_hash", T.StringType()),
        T.StructField("record_hash", T.StringType()),
        T.StructField("valid_from", T.TimestampType()),
        T.StructField("valid_until", T.TimestampType()),
        T.StructField("superseded_by", T.StringType()),
        T.StructField("amended_from", T.StringType()),
        T.StructField("created_at", T.TimestampType()),
        T.StructField("created_by", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("source_agent", T.StringType()),
        T.StructField("key_id", T.StringType()),
        T.StructField("chain_seq", T.LongType()),
        T.StructField("chain_id", T.StringType()),
    ]
)

INBOX = T.StructType(
    [
        T.StructField("id", T.StringType()),
        T.StructField("content", T.StringType()),
        T.StructField("source_agent", T.StringType()),
        T.StructField("session_id", T.StringType()),
        T.StructField("submitted_at", T.TimestampType()),
        T.StructField("caller_trust", T.DoubleType()),
        T.StructField("caller_type", T.StringType()),
        T.StructField("content_class", T.StringType()),
        T.StructField("source_metadata", T.StringType()),
    ]
)

ARCHIVE_RECORD = (
    "schema_version string, id string, content string, memory_type string, trust_score double,"
    " content_hash string, embedding_model string, embedding_dimensions int, embedded_at string,"
    " metadata string, record_hash string, prev_hash string, key_id string, created_at string,"
    " created_by string, source_agent string, session_id string, valid_from string,"
    " valid_until string, superseded_by string, amended_from string, redacted boolean,"
    " chain_id string, chain_seq bigint, _corrupt string"
)

"""The test tables seen as the data model: records, audit log, submissions, queues."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

NOW = 1704067200  # evaluation time of every record query: 2024-01-01 UTC
EVENTS_NOW = 1706659200  # evaluation time of every event query: 2024-01-31 UTC
KEYRING = {"k1": "first test key", "k2": "second test key"}

# Runs unchanged in both engines.
MEMORY_SQL = """
SELECT doc_id AS id, text AS content, source AS source_agent, lang AS project,
 CASE doc_id % 6 WHEN 0 THEN 'preference' WHEN 1 THEN 'identity' WHEN 2 THEN 'episodic'
                 WHEN 3 THEN 'semantic' WHEN 4 THEN 'procedural' ELSE 'transient' END AS memory_type,
 CASE doc_id % 10 WHEN 0 THEN 'external-untrusted' WHEN 1 THEN 'security-doc'
                  WHEN 2 THEN 'code-sample' ELSE 'general' END AS content_class,
 30 + (doc_id * 37) % 71 AS trust_hundredths,
 CAST(30 + (doc_id * 37) % 71 AS DOUBLE) / CAST(100 AS DOUBLE) AS trust_score,
 1704067200 - (doc_id % 400) * 86400 - (doc_id * 7919) % 86400 AS created_epoch,
 CASE WHEN doc_id % 13 = 0 THEN 1704067200 - (doc_id % 200) * 86400 END AS valid_until_epoch,
 CASE WHEN doc_id % 26 = 0 THEN doc_id + 1 END AS superseded_by,
 concat('{"content_class":"',
   CASE doc_id % 10 WHEN 0 THEN 'external-untrusted' WHEN 1 THEN 'security-doc'
                    WHEN 2 THEN 'code-sample' ELSE 'general' END, '"',
   CASE WHEN doc_id % 17 = 0 THEN ',"injection_flagged":true' ELSE '' END,
   CASE WHEN doc_id % 23 = 0 THEN ',"insight_type":"cluster"' ELSE '' END,
   ',"project":"', lang, '"',
   CASE WHEN doc_id % 23 = 0 THEN ',"source_trust_min":0.5' ELSE '' END,
   ',"tags":["t', CAST(doc_id % 4 AS STRING), '"]',
   CASE WHEN doc_id % 34 = 17 THEN ',"trust_override_reason":"reviewed"' ELSE '' END, '}') AS metadata,
 concat('k', CAST(1 + doc_id % 2 AS STRING)) AS key_id,
 doc_id + 1 AS chain_seq
FROM documents
"""
M = f"memory AS ({MEMORY_SQL})"
EFF = (
    "CASE WHEN trust_score >= 0.9 THEN trust_score ELSE greatest(0.3, trust_score *"
    f" pow(0.99, greatest(0, floor(({NOW} - created_epoch) / 86400.0)))) END"
)

# Audit log over events: user is the actor, $.k the record, the event type the action.
AUDIT_SQL = """
SELECT event_id AS id, ts AS timestamp, CAST(json_extract_string(props, '$.k') AS BIGINT) AS memory_id,
 CASE event_type WHEN 'view' THEN 'searched' WHEN 'error' THEN 'conflict_flagged'
                 WHEN 'click' THEN 'created' ELSE event_type END AS action,
 CAST(user_id AS VARCHAR) AS actor, props AS details
FROM events
"""
A = f"audit AS ({AUDIT_SQL})"


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def memory(spark: SparkSession, sf: str) -> DataFrame:
    """Documents as governed records, with real timestamps."""
    return memory_of(table(spark, sf, "documents"))


def memory_of(documents: DataFrame) -> DataFrame:
    documents.createOrReplaceTempView("documents")
    return (
        documents.sparkSession.sql(MEMORY_SQL)
        .withColumn("created_at", F.timestamp_seconds("created_epoch"))
        .withColumn("valid_until", F.timestamp_seconds("valid_until_epoch"))
    )


def vectors(spark: SparkSession, sf: str) -> DataFrame:
    """Records that have a vector: memory joined to embeddings on the id."""
    emb = table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "embedding", "label")
    return memory(spark, sf).join(emb, "id")


def events(spark: SparkSession, sf: str) -> DataFrame:
    return table(spark, sf, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def audit(spark: SparkSession, sf: str) -> DataFrame:
    action = F.col("event_type")
    return events(spark, sf).select(
        F.col("event_id").alias("id"),
        F.col("ts").alias("timestamp"),
        F.get_json_object("props", "$.k").cast("bigint").alias("memory_id"),
        F.when(action == "view", F.lit("searched"))
        .when(action == "error", F.lit("conflict_flagged"))
        .when(action == "click", F.lit("created"))
        .otherwise(action)
        .alias("action"),
        F.col("user_id").cast("string").alias("actor"),
        F.col("props").alias("details"),
    )

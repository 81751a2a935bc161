"""Portable archives, cold storage and retention."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping
from datetime import datetime

from pyspark.sql import Column, DataFrame, DataFrameReader, Observation, SparkSession
from pyspark.sql import functions as F

from ..functions.crypto import canonical_json, canonical_record, chained_hash, iso_utc
from ..functions.text import content_hash
from ..functions.trust import now_micros
from ..operators.chain import append
from ..operators.defenses import latest_redaction, meta
from ..operators.gates import Rule
from ..operators.ingest import govern, merge_metadata, scrub_metadata
from ..operators.ordering import running_sum
from ..operators.state import audit_pages
from ..session import cut_lineage
from ..schema import ARCHIVE_RECORD, ARCHIVE_SCHEMA_VERSION, IMPORT_CEILING, REDACTED_TEXT

_TIMES = ("embedded_at", "created_at", "valid_from", "valid_until")
_FIELDS = (
    "id", "content", "memory_type", "trust_score", "content_hash", "embedding_model",
    "embedding_dimensions", "embedded_at", "metadata", "record_hash", "prev_hash", "key_id",
    "created_at", "created_by", "source_agent", "session_id", "valid_from", "valid_until",
    "superseded_by", "amended_from", "chain_id", "chain_seq",
)


def export_records(
    entries: DataFrame,
    state_events: DataFrame,
    memory_type: str | None = None,
    min_trust: float | None = None,
    include_redacted: bool = False,
) -> DataFrame:
    """Current records without vectors; redacted ones are left out, or masked and kept.

    A redaction retires its record, so masked rows are selected besides the current ones.
    """
    marks = latest_redaction(state_events).withColumnRenamed("target_memory_id", "id")
    rows = entries.select(*[c for c in _FIELDS if c in entries.columns])
    if memory_type is not None:
        rows = rows.filter(F.col("memory_type") == memory_type)
    if min_trust is not None:
        rows = rows.filter(F.col("trust_score") >= min_trust)
    joined = rows.join(marks, "id", "left").withColumn("redacted", F.col("redaction").isNotNull())
    if include_redacted:
        joined = joined.filter(F.col("valid_until").isNull() | F.col("redacted"))
    else:
        joined = joined.filter(F.col("valid_until").isNull() & ~F.col("redacted"))
    return joined.withColumn(
        "content", F.when(F.col("redacted"), F.lit(REDACTED_TEXT)).otherwise(F.col("content"))
    )


def record_lines(records: DataFrame) -> DataFrame:
    """One JSON line per record; metadata nested, times in ISO form, nulls kept."""
    cols = [c for c in records.columns if c != "redaction"]
    fields = []
    for name in cols:
        col = F.col(name)
        if name in _TIMES:
            col = iso_utc(col)
        elif name == "metadata":
            col = F.coalesce(F.try_parse_json(col), F.parse_json(F.lit("{}")))
        elif name in ("id", "superseded_by", "amended_from", "chain_id"):
            col = col.cast("string")
        elif name == "trust_score":
            col = col.cast("double")
        fields.append(col.alias(name))
    if "redaction" in records.columns:
        fields.append(
            F.when(
                F.col("redaction").isNotNull(),
                F.struct(
                    F.col("redaction.reason").alias("reason"),
                    F.col("redaction.actor").alias("actor"),
                    iso_utc(F.col("redaction.created_at")).alias("redacted_at"),
                ),
            ).alias("redaction")
        )
    return records.select(F.to_json(F.struct(*fields), {"ignoreNullFields": "false"}).alias("value"))


def manifest(spark: SparkSession, chain_rows: DataFrame, now: datetime, **filters) -> DataFrame:
    """One line: version, time, a real chain verdict and the filters used."""
    given = F.to_json(
        F.struct(*[F.lit(v).alias(k) for k, v in sorted(filters.items())] or [F.lit(None).alias("none")]),
        {"ignoreNullFields": "false"},
    )
    return chain_rows.agg(F.coalesce(F.min("chain_valid"), F.lit(True)).alias("ok")).select(
        F.to_json(
            F.struct(
                F.lit(ARCHIVE_SCHEMA_VERSION).alias("schema_version"),
                F.lit(now.isoformat()).alias("exported_at"),
                F.col("ok").alias("chain_valid"),
                F.parse_json(given).alias("filters"),
            )
        ).alias("value")
    )


def write_archive(
    path: str,
    records: DataFrame,
    chain_rows: DataFrame,
    now: datetime,
    audit: DataFrame | None = None,
    **filters,
) -> None:
    """manifest/, records/ and, when given, audit/ with trails paged per record."""
    manifest(records.sparkSession, chain_rows, now, **filters).coalesce(1).write.text(f"{path}/manifest")
    record_lines(records).write.text(f"{path}/records")
    if audit is not None:
        mine = audit.join(records.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
        audit_pages(mine).write.json(f"{path}/audit")


def check_manifest(spark: SparkSession, path: str) -> dict:
    lines = spark.read.text(f"{path}/manifest").limit(2).collect()
    if len(lines) != 1:
        raise ValueError("archive needs exactly one manifest line")


    found = json.loads(lines[0]["value"])
    if found.get("schema_version") != ARCHIVE_SCHEMA_VERSION:
        raise ValueError(f"unsupported schema_version {found.get('schema_version')!r}")
    return found


def _parsed(lines: DataFrameReader, path: str, more: str = "") -> DataFrame:
    """Records of JSON lines, each with a number of its own in `_row`, written once: every later step sees the same."""
    rows = (
        lines.schema(ARCHIVE_RECORD + more)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .json(path)
    )
    return cut_lineage(rows.withColumn("_row", F.monotonically_increasing_id()))


def read_archive(spark: SparkSession, path: str) -> DataFrame:
    """Archive records; malformed lines keep their text in `_corrupt`. The manifest is checked."""
    check_manifest(spark, path)
    return _parsed(spark.read, f"{path}/records")


def write_stream(
    path: str,
    records: DataFrame,
    chain_rows: DataFrame,
    now: datetime,
    audit: DataFrame | None = None,
    **filters,
) -> None:
    """The archive as one stream of lines: the manifest first, then a line per record with its trail inside.

    The parts of the folder make the stream in the order of their names. A record's trail is one
    line, so it has to fit one row; `write_archive` pages it instead.
    """
    first = manifest(records.sparkSession, chain_rows, now, **filters).coalesce(1)
    rows = records
    if audit is not None:
        mine = audit.join(records.select(F.col("id").alias("memory_id")), "memory_id", "left_semi")
        event = F.struct("timestamp", "id", "action", "actor", "details")
        trails = mine.groupBy("memory_id").agg(F.array_sort(F.collect_list(event)).alias("audit_trail"))
        trails = trails.withColumn(
            "audit_trail",
            F.transform("audit_trail", lambda e: F.struct(iso_utc(e["timestamp"]).alias("timestamp"), e["action"].alias("action"), e["actor"].alias("actor"), e["details"].alias("details"))),
        )
        rows = rows.join(trails, rows["id"] == trails["memory_id"], "left").drop("memory_id")
        empty = F.array().cast(trails.schema["audit_trail"].dataType)
        rows = rows.withColumn("audit_trail", F.coalesce("audit_trail", empty))
    first.unionAll(record_lines(rows)).write.text(path)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """Records of an archive in one stream, a file or a folder of parts. Exactly one line is the manifest.

    A line without content that isn't redacted is no record: it stays, with the reason in `_corrupt`.
    """
    found = spark.read.text(path).withColumn("version", F.get_json_object("value", "$.schema_version"))
    heads = found.filter("version IS NOT NULL AND get_json_object(value, '$.exported_at') IS NOT NULL").limit(2).collect()
    if len(heads) != 1:
        raise ValueError("archive needs exactly one manifest line")
    if json.loads(heads[0]["value"])["schema_version"] != ARCHIVE_SCHEMA_VERSION:
        raise ValueError(f"unsupported schema_version {heads[0]['version']!r}")
    rows = _parsed(spark.read, path, ", exported_at string").filter("schema_version IS NULL OR exported_at IS NULL").drop("exported_at")
    bare = F.col("content").isNull() & ~F.coalesce("redacted", F.lit(False))
    return rows.withColumn("_corrupt", F.coalesce("_corrupt", F.when(bare, F.lit("record without content"))))


def own_signature(keyring: Mapping[str, str], key_id: str) -> Column:
    """Did this store's key sign the record? Needs metadata in canonical form."""
    canonical = canonical_record(
        F.coalesce("content", F.lit("")),
        F.coalesce("embedding_model", F.lit("")),
        F.coalesce("embedding_dimensions", F.lit(0)),
        F.coalesce("trust_score", F.lit(0.5)),
        F.coalesce("memory_type", F.lit("episodic")),
        F.col("key_id"),
        F.coalesce("_meta", F.lit("{}")),
    )
    own = {key_id: keyring[key_id]}
    expected = chained_hash(own, F.col("key_id"), canonical, F.col("prev_hash"))
    return F.coalesce(expected == F.col("record_hash"), F.lit(False))


def route_import(
    records: DataFrame,
    keyring: Mapping[str, str],
    key_id: str,
    stored: DataFrame | None = None,
    ceiling: float = IMPORT_CEILING,
) -> DataFrame:
    """Adds outcome, hmac_verified, trust_score and scrubbed metadata.

    Order of outcomes: error, redacted, tampered, duplicate, imported. Among copies inside the
    archive the lowest (chain_seq, chain_id, line) is imported; copies are settled by map-side
    minima and the line's own number, never gathered. Every line of the archive is one row of the
    result, which is also all that a dry run needs; `import_records` goes on from here.
    """
    if "_row" not in records.columns:
        records = cut_lineage(records.withColumn("_row", F.monotonically_increasing_id()))
    blank = F.coalesce("content_hash", F.lit("")) == ""
    trust = F.coalesce("trust_score", F.lit(0.5))
    staged = (
        records.withColumn("_meta", canonical_json(F.col("metadata")))
        .withColumn("hmac_verified", own_signature(keyring, key_id))
        .withColumn(
            "_early",
            F.when(F.col("_corrupt").isNotNull(), F.lit("error"))
            .when(F.coalesce("redacted", F.lit(False)) | (F.col("content") == REDACTED_TEXT), F.lit("skipped_redacted"))
            .when(~blank & (content_hash(F.coalesce("content", F.lit(""))) != F.col("content_hash")), F.lit("skipped_tampered")),
        )
    )
    fresh = staged.filter(F.col("_early").isNull() & F.col("content_hash").isNotNull())
    order = F.struct(F.col("chain_seq").isNull().alias("last"), F.col("chain_seq"), F.col("chain_id"), F.col("_row"))
    winners = fresh.groupBy("content_hash").agg(F.min(order)["_row"].alias("_row"))
    if stored is not None:
        winners = winners.join(stored.select("content_hash").distinct(), "content_hash", "left_anti")
    marked = staged.join(
        winners.select("_row", F.lit(True).alias("_winner")), "_row", "left"
    )
    outcome = F.coalesce(
        F.col("_early"),
        F.when(F.col("_winner") | F.col("content_hash").isNull(), F.lit("imported")).otherwise(F.lit("skipped_duplicate")),
    )
    flagged = F.col("hmac_verified") & (
        (meta(F.col("_meta"), "injection_flagged") == "true")
        | (meta(F.col("_meta"), "llm_injection_flagged") == "true")
    )
    llm = F.col("hmac_verified") & (meta(F.col("_meta"), "llm_injection_flagged") == "true")
    origin = F.to_json(
        F.struct(
            F.col("id").alias("original_id"),
            F.col("created_at").alias("original_created_at"),
            F.col("created_by").alias("original_created_by"),
            F.col("source_agent").alias("original_source_agent"),
            F.lit("archive-import").alias("import_actor"),
            F.col("hmac_verified"),
        ),
        {"ignoreNullFields": "false"},
    )
    return (
        marked.withColumn("outcome", outcome)
        .withColumn(
            "trust_score",
            F.when(F.col("hmac_verified"), trust).otherwise(F.least(trust, F.lit(ceiling))),
        )
        .withColumn(
            "metadata",
            merge_metadata(
                F.coalesce(scrub_metadata(F.col("_meta")), F.lit("{}")),
                {
                    "injection_flagged": F.when(flagged, F.lit("true")),
                    "llm_injection_flagged": F.when(llm, F.lit("true")),
                    "imported_from": origin,
                },
            ),
        )
        .drop("_meta", "_early", "_winner", "_row")
    )


def outcome_counts(routed: DataFrame) -> DataFrame:
    return routed.groupBy("outcome").agg(F.count("*").alias("n"))


def import_records(
    routed: DataFrame,
    rules: list[Rule],
    index_dims: int,
    embed: Callable[[DataFrame], DataFrame],
    keyring: Mapping[str, str],
    key_id: str,
    heads: DataFrame | None = None,
) -> DataFrame:
    """The imported rows of `route_import` as governed records, at the end of the chain of their source.

    `heads` (chain_id, head_seq, head_hash) are the chains so far. Rows that the gate rejects keep
    their reason and get no place in a chain.
    """
    rows = routed.filter("outcome = 'imported'").select(
        "id", "content", "memory_type", "trust_score", F.lit("archive-import").alias("actor"), "session_id", "metadata",
        meta(F.col("metadata"), "content_class").alias("content_class"), "source_agent", "created_at",
    )
    governed = cut_lineage(govern(rows, rules, index_dims, embed, key_id))
    good = governed.filter("reject_reason IS NULL").withColumn("chain_id", F.coalesce("source_agent", F.lit("archive-import")))
    placed = running_sum(good, ["chain_id"], ["created_at", "id"], out="chain_seq")
    if heads is not None:
        placed = (
            placed.join(heads.select("chain_id", "head_seq"), "chain_id", "left")
            .withColumn("chain_seq", F.col("chain_seq") + F.coalesce("head_seq", F.lit(0)))
            .drop("head_seq")
        )
    linked = append(placed, keyring, heads=heads)
    return linked.unionByName(governed.filter("reject_reason IS NOT NULL"), allowMissingColumns=True)


# --- retention ---


def archivable(
    entries: DataFrame, archived: DataFrame, now: datetime | int, days: int = 90, limit: int | None = None
) -> DataFrame:
    """Retired long ago and not archived yet; the vector is dropped. `limit` bounds one run."""
    cut = now_micros(now) - days * 86_400_000_000
    old = entries.filter(F.unix_micros("valid_until") < cut).join(
        archived.select("id"), "id", "left_anti"
    )
    if "embedding" in old.columns:
        old = old.drop("embedding")
    return old.orderBy("valid_until", "id").limit(limit) if limit else old


def _table(spark: SparkSession, path: str) -> DataFrame | None:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return spark.read.parquet(path) if where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where) else None


def write_cold(rows: DataFrame, path: str) -> dict[str, int]:
    """Move rows into the monthly archive, where they are absent; the number of rows written, by month.

    A month that gets rows is written anew, old and new ones together, and takes the place of the old
    one; others aren't touched. So the same rows written twice, or again after a run that was cut
    short, leave one copy. The counts are observed while the rows are written.
    """
    spark = rows.sparkSession
    fresh = rows.withColumn("month", F.date_format("valid_until", "yyyy-MM"))
    # Written first: the table that is read for the new months is the one that is overwritten.
    fresh = cut_lineage(fresh.dropDuplicates(["id"]))
    known = _table(spark, path)
    if known is not None:
        fresh = cut_lineage(fresh.join(known.select("id"), "id", "left_anti"))
    months = [r.month for r in fresh.select("month").distinct().collect()]
    if not months:
        return {}
    out = fresh.withColumn("_new", F.lit(1))
    if known is not None:
        old = known.filter(F.col("month").isin(*months)).withColumn("_new", F.lit(0))
        out = cut_lineage(old.unionByName(out, allowMissingColumns=True))
    seen = Observation()
    counts = [F.sum(F.when(F.col("month") == m, F.col("_new"))).alias(m) for m in months]
    out.observe(seen, *counts).drop("_new").repartition("month").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
    return {m: int(n) for m, n in seen.get.items() if n}


def expire_inbox(inbox: DataFrame, path: str, now: datetime | int, days: int = 30) -> dict[str, int]:
    """Write the submissions that stay to `path`, by day of submission, and count what stays and goes.

    Days are replaced one by one and those of which nothing stays are removed, so a second run over
    the same inbox leaves the same table. `inbox` isn't read from `path` itself.
    """
    spark = inbox.sparkSession
    judged = inbox.withColumn("day", F.date_format("submitted_at", "yyyy-MM-dd")).withColumn("_stays", _stays(now, days))
    over = judged.groupBy("day").agg(F.max(F.col("_stays").cast("int")).alias("any")).filter("any = 0").select("day").collect()
    seen = Observation()
    counted = judged.observe(seen, F.count_if("_stays").alias("kept"), F.count_if(~F.col("_stays")).alias("expired"))
    counted.filter("_stays").drop("_stays").repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(path)
    for row in over:
        folder = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/day={row.day}")
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
    return {k: int(v) for k, v in seen.get.items()}


def _stays(now: datetime | int, days: int) -> Column:
    cut = now_micros(now) - days * 86_400_000_000
    settled = F.col("status").isin("approved", "merged", "rejected")
    return ~F.coalesce(settled & (F.unix_micros("processed_at") < cut), F.lit(False))


def retained_inbox(inbox: DataFrame, now: datetime | int, days: int = 30) -> DataFrame:
    """Submissions to keep: everything but settled ones past their time."""
    return inbox.filter(_stays(now, days))

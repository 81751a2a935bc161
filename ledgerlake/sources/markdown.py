"""Markdown corpora: scan, chunk, label, load once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as tx
from ..functions.crypto import uuid5

URL_NAMESPACE = "6ba7b8119dad11d180b400c04fd430c8"
MIN_CHARS, MAX_CHARS = 80, 1200
_LINE = "[^\\n\\r\\x0b\\x0c\\x1c-\\x1e\\x85\\u2028\\u2029]*"


def scan(
    spark: SparkSession, root: str, exclude: tuple[str, ...] = (), max_files: int | None = None
) -> DataFrame:
    """(path, text) of *.md files below `root`, without paths containing an exclusion."""
    files = (
        spark.read.text(root, wholetext=True, recursiveFileLookup=True, pathGlobFilter="*.md")
        .select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    )
    for needle in exclude:
        files = files.filter(~F.lower("path").contains(needle.lower()))
    return files.orderBy("path").limit(max_files) if max_files else files


def stem_of(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*?)(?:\.[^./]*)?$", 1)


def section_chunks(
    docs: DataFrame, text: str = "text", stem: Column | None = None, min_chars: int = MIN_CHARS
) -> DataFrame:
    """One row per `## ` section, preamble included; a file without sections is one chunk.

    Adds pos, title, body; short chunks are left out.
    """
    stem = stem_of(F.col("path")) if stem is None else stem
    bare = F.regexp_replace(F.col(text), r"(?s)\A---\n.*?\n---\n", "")
    parts = docs.withColumn("_stem", stem).withColumn("_parts", F.split(bare, r"(?mUd)^##\s+"))
    rows = parts.select("*", F.posexplode("_parts").alias("pos", "_part"))
    lone = (F.size("_parts") == 1) | (F.col("pos") == 0)
    head = tx.strip(F.regexp_extract("_part", f"^({_LINE})", 1))
    body = tx.strip(F.col("_part"))
    return (
        rows.withColumn(
            "title",
            F.when(lone, F.col("_stem")).otherwise(F.concat_ws(" › ", F.col("_stem"), head)),
        )
        .withColumn("_body", body)
        .filter(F.length("_body") >= min_chars)
        .withColumn("body", F.when(lone, F.col("_body")).otherwise(F.concat(F.lit("## "), F.col("_body"))))
        .drop("_stem", "_parts", "_part", "_body")
    )


def paragraph_chunks(
    docs: DataFrame, text: str = "text", min_chars: int = MIN_CHARS, max_chars: int = MAX_CHARS
) -> DataFrame:
    """One row per paragraph; a long one is packed greedily from whole sentences.

    Adds pos, chunk. The packing is a native fold over the sentences of one paragraph.
    """
    bare = F.regexp_replace(F.col(text), r"(?s)\A---\n.*?\n---\n", "")
    even = F.regexp_replace(bare, r"\n{3,}", "\n\n")
    paragraphs = F.filter(
        F.transform(F.split(even, "\n\n"), tx.strip), lambda p: F.length(p) >= min_chars
    )

    def pack(paragraph: Column) -> Column:
        start = F.struct(
            F.array().cast("array<string>").alias("done"), F.lit("").alias("open")
        )

        def take(acc: Column, s: Column) -> Column:
            full = (F.length(acc["open"]) + F.length(s) + 1 > max_chars) & (acc["open"] != "")
            joined = F.when(acc["open"] == "", s).otherwise(
                tx.strip(F.concat_ws(" ", acc["open"], s))
            )
            return F.struct(
                F.when(full, F.array_append(acc["done"], tx.strip(acc["open"])))
                .otherwise(acc["done"]).alias("done"),
                F.when(full, s).otherwise(joined).alias("open"),
            )

        return F.aggregate(
            F.split(paragraph, r"(?U)(?<=[.!?])\s+"),
            start,
            take,
            lambda acc: F.when(acc["open"] == "", acc["done"]).otherwise(
                F.array_append(acc["done"], tx.strip(acc["open"]))
            ),
        )

    chunks = F.flatten(
        F.transform(
            paragraphs, lambda p: F.when(F.length(p) > max_chars, pack(p)).otherwise(F.array(p))
        )
    )
    return docs.select("*", F.posexplode(chunks).alias("pos", "chunk"))


def chunk_content(title: Column, body: Column) -> Column:
    return F.concat(F.lit("["), title, F.lit("]\n"), body)


def group_id(path: Column, prefix: str = "corpus-import:") -> Column:
    """Stable id shared by the chunks of one file."""
    return uuid5(URL_NAMESPACE, F.concat(F.lit(prefix), path))


def first_copies(
    chunks: DataFrame, order: list[str], content: str = "content", stored: DataFrame | None = None
) -> DataFrame:
    """Drop texts already stored, and all but the first copy in `order`, a unique key.

    Only hashes and keys are aggregated, with map-side minima, and the winners are fetched by
    their unique key: a text copied very many times is never gathered in one place.
    """
    hashed = chunks.withColumn("content_hash", tx.content_hash(F.col(content)))
    first = hashed.groupBy("content_hash").agg(F.min(F.struct(*order)).alias("k"))
    if stored is not None:
        first = first.join(stored.select("content_hash"), "content_hash", "left_anti")
    return hashed.join(first.select("k.*"), order, "left_semi")


def load_report(
    chunks: DataFrame, loaded: DataFrame, by: str = "memory_type", flagged: Column | None = None
) -> DataFrame:
    """Per type: chunks seen, loaded, dropped as copies, and flagged among the loaded."""
    seen = chunks.groupBy(by).agg(F.count("*").alias("chunks"))
    flag = F.lit(False) if flagged is None else flagged
    kept = loaded.groupBy(by).agg(F.count("*").alias("loaded"), F.count_if(flag).alias("flagged"))
    return seen.join(kept, by, "left").select(
        by,
        "chunks",
        F.coalesce("loaded", F.lit(0)).alias("loaded"),
        (F.col("chunks") - F.coalesce("loaded", F.lit(0))).alias("deduped"),
        F.coalesce("flagged", F.lit(0)).alias("flagged"),
    )

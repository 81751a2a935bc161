"""The corpus pipeline: cleaning, near duplicates, secrets, mixing, packing, each over all that the stage before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ledgerlake.llm import cleaning, mixing, packing, queries, secrets, shingles, tokens
from ledgerlake.llm.scratch import written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass, with their failing lines removed and `n_chars` counted anew. Null texts are rejected."""
    rows = docs.select("text", F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "text"]).alias("row"))
    # A generator drops the rejected rows: a filter on `kept` would make Spark judge every line twice.
    verdict = F.struct("kept", "cleaned_text", "row")
    kept = cleaning.clean_lines(rows).select(F.explode(F.filter(F.array(verdict), lambda d: d["kept"])).alias("d")).select("d.cleaned_text", "d.row")
    text = F.col("cleaned_text")
    own = {"text": text, "n_chars": F.length(text).cast(docs.schema["n_chars"].dataType)}
    return kept.select(*[own[c].alias(c) if c in own else F.col(f"row.`{c}`").alias(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five-word shingles, Jaccard similarity of 0.8 or more), that with the least id.

    Candidates come from SimHash fingerprints in vantage-point trees, and from min-hash bands where fingerprints lie further apart.
    """
    return shingles.deduplicated(docs)


def secret_scan(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with a mark in place of every secret and `n_chars` counted anew.

    Null texts stay null, repeated rows stay, an empty table stays empty; other columns aren't touched.
    """
    clean = secrets.redacted(docs, secrets.learn(docs))
    return clean.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents of the mix, once for each epoch that takes them.

    A null text counts as empty; documents of no named domain, or with a null language or source, are
    leaves of their own; repeated rows are documents of their own; no rows, no rows.
    """
    mixed = mixing.mix(
        mixing.counted(docs), queries.domain_of(F.col("source")), queries.DOMAINS, queries.LANGUAGES, queries.SOURCES, share=queries.MIX_SHARE
    )
    return mixed.select("row.*")


def best_fit_packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands; a row of `docs` that occurs twice is packed twice."""
    return packing.pack(tokens.pieces(docs, "doc_id", "text", queries.CONTEXT), queries.CONTEXT)


STAGES = [
    ("quality_rules", quality_rules), ("near_duplicates", near_duplicates), ("secret_scan", secret_scan),
    ("source_mix", source_mix), ("best_fit_packing", best_fit_packing),
]

#: Min-hashes, inferred grammars and token ids have no SQL; the tests hold the stages against plain Python.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage, over `documents`."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)

"""Labelled evaluation corpora."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_SCHEMA = (
    "schema_version string, description string,"
    " cases array<struct<id: string, label: boolean, category: string, text: string>>"
)


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """(schema_version, id, label, category, text), one row per case."""
    return (
        spark.read.schema(_SCHEMA)
        .option("multiLine", True)
        .json(path)
        .select("schema_version", F.explode("cases").alias("c"))
        .select("schema_version", "c.*")
    )

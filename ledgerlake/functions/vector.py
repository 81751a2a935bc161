"""Vector scalars as native array expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Dimensions of the known embedding models.
MODEL_DIMENSIONS = {
    "openai/text-embedding-3-small": 1024,
    "ollama/nomic-embed-text": 768,
    "ollama/snowflake-arctic-embed2": 1024,
    "ollama/qwen3-embedding": 1024,
    "ollama/bge-m3": 1024,
}


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda acc, x: acc + x)


def dot(a: Column, b: Column) -> Column:
    return _sum(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def cosine_distance(a: Column, b: Column) -> Column:
    return 1.0 - dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2_delta(old: Column, new: Column) -> Column:
    """Euclidean change between two versions; NULL when the dimensions differ."""
    squares = F.zip_with(
        old, new, lambda x, y: F.pow(y.cast("double") - x.cast("double"), F.lit(2.0))
    )
    return F.when(F.size(old) == F.size(new), F.sqrt(_sum(squares)))


def dimensions_valid(dims: Column, model: Column) -> Column:
    expected = F.lit(None).cast("int")
    for name, size in MODEL_DIMENSIONS.items():
        expected = F.when(model == name, F.lit(size)).otherwise(expected)
    return F.when(expected.isNotNull(), dims == expected).otherwise(dims.between(64, 4096))

"""Connected components of links, by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.scratch import drop, written


def components(links: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) of every node that a link names; root is the smallest node that can be reached.

    Each round hooks every node, and its larger neighbours, to its smallest neighbour. It is a minimum
    per node (summed before the shuffle) and a join of links with those minima, so a node with very
    many links is no group in memory. Rounds end when no link changes; they grow with the logarithm
    of the longest chain. Links with a null end and loops are left out.
    """
    edges = written(
        links.select(F.greatest(a, b).alias("v"), F.least(a, b).alias("u")).where(f"{a} is not null and {b} is not null and v > u").distinct()
    )
    while True:
        # Large star: larger neighbours of a node go to the least of the node and its neighbours.
        both = edges.select(F.col("u").alias("n"), F.col("v").alias("o")).unionByName(edges.select(F.col("v").alias("n"), F.col("u").alias("o")))
        least = both.groupBy("n").agg(F.least(F.min("o"), F.col("n")).alias("m"))
        large = written(both.where("o > n").join(least, "n").select(F.col("o").alias("v"), F.col("m").alias("u")).distinct())
        # Small star: a node's smaller neighbours, and the node, go to the least of them.
        least = large.groupBy("v").agg(F.min("u").alias("m"))
        hooked = large.join(least, "v")
        small = written(
            hooked.where("u > m").select(F.col("u").alias("v"), F.col("m").alias("u")).unionByName(least.select("v", F.col("m").alias("u"))).distinct()
        )
        drop(large)
        same = _sign(small) == _sign(edges)
        drop(edges)
        edges = small
        if same:
            roots = edges.select(F.col("v").alias("node"), F.col("u").alias("root"))
            return roots.unionByName(edges.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _sign(edges: DataFrame) -> tuple:
    """A number of edges and sums of two hashes of them; equal for equal sets."""
    row = edges.agg(
        F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)")), F.sum(F.xxhash64("u", "v", F.lit(1)).cast("decimal(38,0)"))
    ).first()
    return tuple(row)

"""Clusters around integer centroids, with a table of pivot distances (LAESA).

Every vector's distance to a few fixed pivots is stored once, beside the vector. In each round the
distance of a centroid to the pivots is known too, and by the triangle inequality the largest
difference of the two is a lower bound of the distance of vector and centroid. Only centroids whose
bound doesn't exceed the best exact distance so far are measured, in integers. What leaves a task
is one row of counts and sums per cluster.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlake.llm.scratch import without, written

CLUSTERS, ROUNDS, SCALE, WIDTH = 8, 10, 1024, 64
#: Pivots, and how many vectors (those of least hash) they are chosen from.
PIVOTS, PIVOT_CANDIDATES = 12, 256
#: Components below this keep all sums of squares within 63 bits; others are counted in Python integers.
SMALL = 1 << 26
#: Bounds are doubles; they are relaxed by more than their rounding.
SLACK = 1e-9
BUCKETS = 64
SUMS = "cluster int, n bigint, sums array<string>, inertia string"


def usable(vector: str, width: int):
    """The vector has this many components, none null or non-finite."""
    return F.coalesce(
        (F.size(vector) == width) & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf"))),
        F.lit(False),
    )


def whole(vectors: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x), as 64-bit integers, or as Python integers where some are large."""
    floors = np.floor(vectors.astype(np.float64) * scale)
    if not floors.size or np.abs(floors).max() < SMALL:
        return floors.astype(np.int64)
    return np.array([[int(x) for x in row] for row in floors.tolist()], dtype=object)


def squares(differences: np.ndarray) -> np.ndarray:
    return (differences * differences).sum(axis=1)


def roots(numbers) -> np.ndarray:
    return np.sqrt(np.asarray(numbers, dtype=np.float64))


def nearest(points: np.ndarray, pivot_distances: np.ndarray, centroids: np.ndarray, centroid_pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Number of the nearest centroid (ties: the smaller), its exact squared distance, and how many were measured."""
    bounds = np.abs(pivot_distances[:, None, :] - centroid_pivots[None, :, :]).max(axis=2)
    bounds -= SLACK * (1 + pivot_distances.max(axis=1, keepdims=True) + centroid_pivots.max(axis=1)[None, :])
    best = bounds.argmin(axis=1)
    distance = squares(points - centroids[best])
    measured = len(points)
    for k in range(len(centroids)):
        left = np.flatnonzero((best != k) & (bounds[:, k] <= roots(distance)))
        own = squares(points[left] - centroids[k])
        measured += len(left)
        closer = (own < distance[left]) | ((own == distance[left]) & (k < best[left]))
        best[left[closer]], distance[left[closer]] = k, own[closer]
    return best, distance, measured


def spread_pivots(candidates: np.ndarray, count: int) -> np.ndarray:
    """Up to `count` different candidates: the first, then always that furthest from those chosen."""
    chosen = candidates[:1]
    far = roots(squares(candidates - candidates[0])) if len(candidates) else np.zeros(0)
    while len(chosen) < min(count, len(candidates)) and far.max() > 0:
        chosen = np.concatenate([chosen, candidates[[int(far.argmax())]]])
        far = np.minimum(far, roots(squares(candidates - chosen[-1])))
    return chosen


def cluster(df: DataFrame, key: str = "vec_id", vector: str = "embedding", clusters: int = CLUSTERS, rounds: int = ROUNDS,
            scale: int = SCALE, width: int = WIDTH, seed: str = "3:") -> DataFrame:
    """The usable rows with `cluster`, `distance`, `cluster_inertia`, `inertia`, `centroid` and `measured`.

    Vectors are floor(scale * x). The first centroids are the vectors whose sha256 of `seed` and key is
    smallest; a null key comes last, and equal hashes are ordered by their vectors. Each round assigns
    every vector to its nearest centroid (squared Euclidean distance, ties to the smaller number) and
    replaces each centroid that has vectors by the componentwise floor of their mean; vectors are
    assigned once more at the end. `centroid` is text, decimal integers joined by commas; `measured`
    is the share of exact distances of the last assignment, in its task's batch.

    Vectors that are null, of another width or that hold null or non-finite components are left out.
    Repeated rows count each time. No usable rows, no rows; fewer rows than clusters, fewer clusters.
    A distance or inertia that doesn't fit a long is null; all comparisons stay exact. The columns
    take the place of columns of those names. The driver holds centroids, pivots and their candidates.
    """
    own = ("cluster", "distance", "cluster_inertia", "inertia", "centroid", "measured")
    rows = without(df, *own).where(usable(vector, width))
    order = [F.sha2(F.concat(F.lit(seed), F.col(f"`{key}`").cast("string")), 256).asc_nulls_last(), F.col(f"`{vector}`")]
    first = [r[0] for r in rows.orderBy(*order).select(f"`{vector}`").head(max(clusters, PIVOT_CANDIDATES))]
    candidates = whole(np.array(first, np.float64).reshape(len(first), width), scale)
    centroids, pivots = candidates[:clusters], spread_pivots(candidates, PIVOTS)
    stored = written(_with_pivots(rows, vector, pivots, scale))
    sums = _sums(stored, centroids, pivots, scale)
    for _ in range(rounds):
        for r in sums:
            if r.n:
                moved = np.array([int(s) // r.n for s in r.sums], dtype=object)
                small = centroids.dtype != object and max(abs(x) for x in moved) < SMALL
                centroids = centroids.copy() if small else centroids.astype(object)
                centroids[r.cluster] = moved
        sums = _sums(stored, centroids, pivots, scale)
    found = _assigned(stored, centroids, pivots, scale, {r.cluster: int(r.inertia) for r in sums})
    return found.select(*[F.col(f"row.`{c}`") for c in rows.columns], *own)


def _with_pivots(rows: DataFrame, vector: str, pivots: np.ndarray, scale: int) -> DataFrame:
    """(row, vector, pivots): the rows whole, and the distances to all pivots."""
    whole_rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in rows.columns]).alias("row"), F.col(f"`{vector}`").cast("array<double>").alias("vector"))

    def measure(batches):
        for batch in batches:
            points = whole(_matrix(batch.column(1)), scale)
            distances = np.array([roots(squares(points - p)) for p in pivots]).T
            yield pa.RecordBatch.from_arrays([*batch.columns, _lists(distances, pa.float64())], names=["row", "vector", "pivots"])

    return whole_rows.mapInArrow(measure, T.StructType([*whole_rows.schema, T.StructField("pivots", T.ArrayType(T.DoubleType()))]))


def _sums(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray, scale: int) -> list:
    """(cluster, n, sums, inertia) of each cluster with vectors; exact numbers as text."""

    def partial(batches):
        counts, sums, inertia = [0] * len(centroids), [[0] * centroids.shape[1] for _ in centroids], [0] * len(centroids)
        to_pivots = _to_pivots(centroids, pivots)
        for batch in batches:
            points = whole(_matrix(batch.column(0)), scale)
            best, distance, _ = nearest(points, _matrix(batch.column(1)), centroids, to_pivots)
            for k in np.unique(best).tolist():
                own = best == k
                counts[k] += int(own.sum())
                sums[k] = [a + int(b) for a, b in zip(sums[k], points[own].sum(axis=0))]
                inertia[k] += sum(distance[own].tolist())
        used = [k for k, n in enumerate(counts) if n]
        yield pa.RecordBatch.from_arrays(
            [pa.array([TaskContext.get().partitionId() % BUCKETS] * len(used), pa.int32()), pa.array(used, pa.int32()),
             pa.array([counts[k] for k in used], pa.int64()), pa.array([[str(x) for x in sums[k]] for k in used], pa.list_(pa.string())),
             pa.array([str(inertia[k]) for k in used], pa.string())],
            names=["bucket", "cluster", "n", "sums", "inertia"],
        )

    def added(rows: pd.DataFrame) -> pd.DataFrame:
        sums = [str(sum(map(int, column))) for column in zip(*rows["sums"])]
        total = {"cluster": [rows["cluster"].iloc[0]], "n": [rows["n"].sum()], "sums": [sums], "inertia": [str(sum(map(int, rows["inertia"])))]}
        return pd.DataFrame(total)

    parts = stored.select("vector", "pivots").mapInArrow(partial, f"bucket int, {SUMS}")
    return parts.groupBy("cluster", "bucket").applyInPandas(added, SUMS).groupBy("cluster").applyInPandas(added, SUMS).collect()


def _assigned(stored: DataFrame, centroids: np.ndarray, pivots: np.ndarray, scale: int, inertia: dict[int, int]) -> DataFrame:
    texts, total = [",".join(str(int(x)) for x in c) for c in centroids], sum(inertia.values())

    def assign(batches):
        to_pivots = _to_pivots(centroids, pivots)
        for batch in batches:
            points = whole(_matrix(batch.column(1)), scale)
            if not len(points):
                continue
            best, distance, measured = nearest(points, _matrix(batch.column(2)), centroids, to_pivots)
            numbers = best.tolist()
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(numbers, pa.int32()), pa.array([_long(x) for x in distance.tolist()], pa.int64()),
                 pa.array([_long(inertia[k]) for k in numbers], pa.int64()), pa.array([_long(total)] * len(numbers), pa.int64()),
                 pa.array([texts[k] for k in numbers], pa.string()),
                 pa.array([measured / len(points) / len(centroids)] * len(numbers), pa.float64())],
                names=["row", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "measured"],
            )

    kinds = {"cluster": T.IntegerType(), "distance": T.LongType(), "cluster_inertia": T.LongType(), "inertia": T.LongType(), "centroid": T.StringType(), "measured": T.DoubleType()}
    return stored.mapInArrow(assign, T.StructType([stored.schema["row"], *[T.StructField(n, k) for n, k in kinds.items()]]))


def _to_pivots(centroids: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.array([roots(squares(pivots - c)) for c in centroids])


def _matrix(column: pa.Array) -> np.ndarray:
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 1)


def _lists(rows: np.ndarray, kind: pa.DataType) -> pa.Array:
    width = rows.shape[1] if rows.ndim == 2 else 0
    return pa.ListArray.from_arrays(pa.array(np.arange(len(rows) + 1) * width, pa.int32()), pa.array(rows.reshape(-1), kind))


def _long(number: int) -> int | None:
    return int(number) if abs(number) < 1 << 63 else None

"""Integer centroids against a plain walk."""

import hashlib
import math
import random

import numpy as np
import pytest

from ledgerlake.llm import centroids, queries


def plain(rows, clusters=8, rounds=10, width=64):
    kept = [(i, [math.floor(1024 * float(x)) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and math.isfinite(x) for x in v)]
    hashed = sorted(((1, "", v) if i is None else (0, hashlib.sha256(f"3:{i}".encode()).hexdigest(), v)) for i, v in kept)
    means = [v for *_, v in hashed[:clusters]]

    def assign():
        return [min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(means)) for _, v in kept]

    for _ in range(rounds):
        own = assign()
        for k in range(len(means)):
            mine = [v for (_, v), (_, o) in zip(kept, own) if o == k]
            if mine:
                means[k] = [sum(column) // len(mine) for column in zip(*mine)]
    own = assign()
    return [(i, k, d, sum(x for x, o in own if o == k), sum(x for x, _ in own),
             hashlib.sha256(",".join(map(str, means[k])).encode()).hexdigest()) for (i, _), (d, k) in zip(kept, own)]


def long(x):
    return x if x is None or abs(x) < 1 << 63 else None


def order(rows):
    return sorted(rows, key=repr)


def vectors(n, seed=1, width=64):
    rnd = random.Random(seed)
    middles = [[rnd.gauss(0, 1) for _ in range(width)] for _ in range(5)]
    return [(k, [float(np.float32(m + rnd.gauss(0, 0.4))) for m in rnd.choice(middles)]) for k in range(n)]


def write(spark, tmp_path, rows):
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<float>")
    frame.repartition(3).write.mode("overwrite").parquet(f"{tmp_path}/embeddings.parquet")


def test_query(spark, tmp_path):
    rows = vectors(300)
    rows += [(3, rows[3][1]), (3, rows[3][1]), (900, None), (901, []), (902, [1.0] * 63), (903, [1.0] * 63 + [None]), (904, [float("nan")] + [0.0] * 63),
             (905, [float("inf")] * 64), (906, [0.0] * 64), (None, [0.5] * 64)]
    write(spark, tmp_path, rows)
    got = [tuple(r) for r in queries.op12_centroid_clusters(spark, str(tmp_path)).collect()]
    assert order(got) == order(plain(rows))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(5, [1.5] * 64)], [(k, [float(k % 2)] * 64) for k in range(20)]])
def test_few_and_equal_vectors(spark, tmp_path, rows):
    write(spark, tmp_path, rows)
    got = [tuple(r) for r in queries.op12_centroid_clusters(spark, str(tmp_path)).collect()]
    assert order(got) == order(plain(rows))


def test_huge_components(spark, tmp_path):
    rows = [(k, [x * (1e30 if k % 9 == 0 else 1e6 if k % 9 == 1 else 1) for x in v]) for k, v in vectors(60, 2)]
    rows = [(k, [float(np.float32(x)) for x in v]) for k, v in rows]
    write(spark, tmp_path, rows)
    got = [tuple(r) for r in queries.op12_centroid_clusters(spark, str(tmp_path)).collect()]
    assert order(got) == order([(i, k, long(d), long(a), long(b), c) for i, k, d, a, b, c in plain(rows)])


def test_pivots_rule_centroids_out():
    rnd = np.random.default_rng(3)
    middles = rnd.integers(-4000, 4000, (8, 16))
    points = (middles[rnd.integers(0, 8, 2000)] + rnd.integers(-300, 300, (2000, 16))).astype(np.int64)
    pivots = centroids.spread_pivots(points[:256], 12)
    to_pivots = np.array([centroids.roots(centroids.squares(points - p)) for p in pivots]).T
    best, distance, measured = centroids.nearest(points, to_pivots, middles, np.array([centroids.roots(centroids.squares(pivots - c)) for c in middles]))
    full = ((points[:, None, :] - middles[None, :, :]) ** 2).sum(axis=2)
    assert (best == full.argmin(axis=1)).all() and (distance == full.min(axis=1)).all()
    assert measured < 0.5 * full.size


def test_names_that_clash(spark):
    frame = spark.createDataFrame([(k, v, "x", "y") for k, v in vectors(12, 4, 3)], "vec_id int, embedding array<double>, `Cluster` string, `o.t` string")
    out = centroids.cluster(frame, clusters=2, rounds=1, width=3)
    assert out.columns == ["vec_id", "embedding", "o.t", "cluster", "distance", "cluster_inertia", "inertia", "centroid", "measured"]
    assert out.count() == 12

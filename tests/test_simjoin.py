"""The similarity join and walks by component, against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.operators import settling, simjoin


def clustered(n, middles, spread, seed=3, width=12):
    rng = np.random.default_rng(seed)
    at = rng.normal(size=(middles, width))
    return (at[rng.integers(0, middles, n)] + rng.normal(size=(n, width)) * spread).astype(np.float32)


def frame(spark, vectors, ids=None):
    rows = [(i, None if v is None else [float(x) for x in v]) for i, v in zip(ids or range(len(vectors)), vectors)]
    return spark.createDataFrame(rows, "id bigint, vector array<float>")


def brute(vectors, limit):
    u = np.array(vectors, np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.round(np.maximum(1 - u @ u.T, 0), 9)
    return {(a, b): d[a, b] for a in range(len(u)) for b in range(a + 1, len(u)) if d[a, b] < limit}


@pytest.mark.parametrize("limit, cell_rows, block_rows", [(0.05, 20, 16), (0.3, 30, 7), (0.9, 40, 50), (0.05, 1000, 1000)])
def test_pairs(spark, limit, cell_rows, block_rows):
    vectors = clustered(400, 25, 0.15)
    got = simjoin.pairs_within(frame(spark, vectors), limit, cell_rows, block_rows).collect()
    want = brute(vectors, limit)
    found = {(min(r.a, r.b), max(r.a, r.b)): r.distance for r in got}
    assert len(found) == len(got) and found.keys() == want.keys()
    assert all(abs(found[p] - want[p]) < 1e-8 for p in want)


def test_null_and_zero_vectors_are_near_nothing(spark):
    df = frame(spark, [None, [0.0, 0.0], [1.0, 0.0], [1.0, 0.01]])
    assert [(min(r.a, r.b), max(r.a, r.b)) for r in simjoin.pairs_within(df, 0.5).collect()] == [(2, 3)]
    assert simjoin.pairs_within(df.limit(0), 0.5).count() == 0
    with pytest.raises(ValueError):
        simjoin.pairs_within(df, 1.5)


def test_neighbours_with_copies(spark):
    vectors = list(clustered(60, 6, 0.1)) + [[1.0] * 12] * 40
    vectors += vectors[:5]
    k, limit = 4, 0.2
    u = np.array(vectors, np.float64)
    u /= np.linalg.norm(u, axis=1, keepdims=True)
    d = np.round(np.maximum(1 - u @ u.T, 0), 9)
    want = {(i, rank + 1): j for i in range(len(u)) for rank, (_, j) in enumerate(sorted((d[i, j], j) for j in range(len(u)) if j != i and d[i, j] < limit)[:k])}
    got = simjoin.neighbours_within(frame(spark, vectors), k, limit, cell_rows=16).collect()
    assert {(r.id, r["rank"]): r.neighbour_id for r in got} == want


@pytest.mark.parametrize("cell_rows, block_rows", [(1000, 40), (16, 10), (1000, None)])
def test_blocks_keep_the_k_best_only(spark, monkeypatch, cell_rows, block_rows):
    """Where nearly all pairs are below the threshold, a comparison of blocks gives k rows for each of its rows at most."""
    vectors, k, limit, kept = clustered(200, 5, 0.8, seed=8), 3, 0.95, []
    first_n, cut = simjoin.first_n, simjoin.cut_lineage
    monkeypatch.setattr(simjoin, "first_n", lambda df, *a, **b: (kept.append(df), first_n(df, *a, **b))[1])
    monkeypatch.setattr(simjoin, "cut_lineage", lambda df: (kept.append(df), cut(df))[1])
    got = simjoin.neighbours_within(frame(spark, vectors), k, limit, cell_rows=cell_rows, block_rows=block_rows).collect()
    near = brute(vectors, limit)
    lists = {i: sorted((d, a + b - i) for (a, b), d in near.items() if i in (a, b))[:k] for i in range(len(vectors))}
    assert {(r.id, r["rank"]): r.neighbour_id for r in got} == {(i, n + 1): j for i, own in lists.items() for n, (_, j) in enumerate(own)}
    assert len(near) > 5_000 and (cell_rows == 16 or max(df.count() for df in kept) < len(near))


def test_candidates_follow_the_threshold(spark):
    """Twice the rows in twice the clusters: twice the candidates, a small part of all pairs."""
    shares = []
    for n in (4_000, 8_000):
        df = frame(spark, clustered(n, n // 40, 0.05, width=16))
        placed = simjoin.placed_rows(df, 0.02, cell_rows=128)
        compared = simjoin.candidates(placed)
        shares.append(compared / n)
    assert compared < 0.05 * n * n / 2
    assert shares[1] < 1.6 * shares[0]


def test_components(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(180)] + [(1000 + k, 1001 + k) for k in range(80)] + [(7, 7)] + [(2000, k) for k in range(2001, 2400)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        if a != b:
            a, b = find(a), find(b)
            root[max(a, b)] = min(a, b)
    got = settling.components(spark.createDataFrame(links, "a int, b int")).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == {x: find(x) for x in root}
    assert settling.components(spark.createDataFrame([], "a int, b int")).count() == 0


@pytest.mark.parametrize("slice_rows", [100, 100_000])
def test_a_long_chain_and_many_small_components(spark, slice_rows):
    """Item k of the chain takes thing k + 1 and needs k; so every second one is accepted."""
    n = 600
    items = spark.range(2 * n).select(F.col("id").alias("ord"))
    chain = items.filter(F.col("ord") < n)
    pairs = items.filter(F.col("ord") >= n)
    takes = chain.select("ord", (F.col("ord") + 1).alias("thing")).unionByName(pairs.select("ord", (100_000 + F.floor(F.col("ord") / 2)).alias("thing")))
    needs = chain.select("ord", F.col("ord").alias("thing")).unionByName(pairs.select("ord", (100_000 + F.floor(F.col("ord") / 2)).alias("thing")))
    got = {r.ord: r.accepted for r in settling.greedy_select(items, takes, needs, slice_rows).collect()}
    assert got == {k: k % 2 == 0 for k in range(2 * n)}

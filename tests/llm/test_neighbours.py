"""Hilbert orderings and nearest neighbours against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerlake.llm import neighbours


@pytest.mark.parametrize("dims, bits", [(1, 6), (2, 4), (3, 3), (4, 2)])
def test_hilbert_curve_visits_all_cells_in_single_steps(dims, bits):
    cells = np.stack(np.meshgrid(*[np.arange(1 << bits)] * dims, indexing="ij"), -1).reshape(-1, dims)
    keys = neighbours.hilbert(cells, bits)
    assert sorted(keys) == list(range(len(cells)))
    assert (np.abs(np.diff(cells[np.argsort(keys)], axis=0)).sum(axis=1) == 1).all()


def frame(spark, rows):
    return spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, score string, node int")


def brute(rows, k=20):
    width = next(len(v) for i, v, *_ in sorted((r for r in rows if r[0] is not None and r[1]), key=lambda r: r[0]))
    own = {}
    for i, v, *_ in rows:
        if i is not None and v is not None and len(v) == width and None not in v and np.isfinite(np.array(v, float)).all() and any(v):
            v = np.array(v, np.float32).astype(float)
            own[i] = min(own[i], v, key=tuple) if i in own else v
    ids = np.array(sorted(own))
    m = np.stack([own[i] for i in ids])
    out = {}
    for i in ids[ids % 20 == 0]:
        s = (m * own[i]).sum(axis=1)
        keep = ids != i
        order = np.lexsort((ids[keep], -s[keep]))[:k]
        out[int(i)] = list(zip(ids[keep][order].tolist(), s[keep][order].tolist()))
    return out


def rows_of(n, seed, width=24):
    rng = np.random.default_rng(seed)
    return [(int(k), (rng.normal(size=width) * rng.uniform(0.5, 2)).astype(np.float32).tolist(), "s", 1) for k in range(n)]


def test_small_tables_are_exact(spark):
    """One block holds all: lengths differ, a third are copies, and odd vectors take no part."""
    rows = rows_of(300, 1)
    rows += [(1000 + k, rows[7][1], "s", 1) for k in range(150)]
    rows += [(2000, None, "s", 1), (2020, [0.0] * 24, "s", 1), (2040, [float("nan")] * 24, "s", 1), (2060, [1.0] * 5, "s", 1), (2080, [float("inf")] * 24, "s", 1),
             (2100, [None] + [1.0] * 23, "s", 1), (2120, [], "s", 1), (None, rows[3][1], "s", 1), rows[40], (60, [9.0] * 24, "s", 1)]
    out = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    got = {}
    for r in sorted(out, key=lambda r: (r.query_id, r.rank)):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(got[r.query_id])
    want = brute(rows)
    assert got.keys() == want.keys()
    for q, found in want.items():
        assert [x for x, _ in got[q]] == [x for x, _ in found]
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in found], abs=1e-12)


def test_fewer_candidates_than_asked_for_and_none(spark):
    few = frame(spark, rows_of(5, 2))
    assert [r.rank for r in neighbours.nearest(few, F.col("vec_id") % 20 == 0).orderBy("rank").collect()] == [1, 2, 3, 4]
    assert neighbours.nearest(few.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_recall_over_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 128)
    monkeypatch.setattr(neighbours, "ROWS_PER_PARTITION", 500)
    monkeypatch.setattr(neighbours, "QUERIES_PER_GROUP", 40)
    rows = rows_of(4000, 3, 64)
    out = neighbours.nearest(frame(spark, rows), F.col("vec_id") % 20 == 0).collect()
    want = brute(rows)
    got = {}
    for r in out:
        got.setdefault(r.query_id, set()).add(r.vec_id)
    assert all(len(v) == 20 for v in got.values()) and got.keys() == want.keys()
    recall = np.mean([len(got[q] & {x for x, _ in found}) / 20 for q, found in want.items()])
    assert recall >= 0.9, recall


def test_width_is_that_of_most_usable_vectors(spark):
    rows = rows_of(60, 3)
    for ragged in ([float("nan")], [None, 1.0], [2.0, 1.0]):
        first = [(-1, ragged, "s", 1)]
        got = {tuple(r) for r in neighbours.nearest(frame(spark, first + rows), F.lit(True), k=3).select("query_id", "rank", "vec_id").collect()}
        assert got and {q for q, _, _ in got} == {r[0] for r in rows}

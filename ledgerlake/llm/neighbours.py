"""Approximate nearest neighbours by shifted space-filling curves.

Vectors are projected to a few dimensions, once for each ordering with its own rotation and shift,
and put in the order of their Hilbert index by a range partitioning. A query looks at the window of
rows around its own place in each ordering; inner products rank what it meets there, and the best
of all windows are merged.

Largest inner product becomes nearness on a sphere: a candidate of length n gets one more
coordinate, sqrt(M * M - n * n) with M the greatest length, and a query gets 0 there.

The window is a share of all rows. On vectors without structure (like random directions, where the
twentieth neighbour is hardly nearer than the rest) no index of this kind finds nine in ten by
looking at less; where vectors are clustered, a smaller share will do.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlake.llm.scratch import drop, written

ORDERINGS = 6
SHARE = 0.26
CURVE_DIMENSIONS, BITS = 8, 7
ROWS_PER_PARTITION = 20_000
BLOCK = 8192
QUERIES_PER_GROUP = 20_000


def hilbert(cells: np.ndarray, bits: int) -> np.ndarray:
    """Place on the Hilbert curve of cells (rows, dimensions) with `bits` bits each, by the transposed form:
    exclusive-or out the rotations from the top bit down, then turn Gray code into numbers."""
    x = cells.astype(np.int64).T.copy()
    for b in range(bits - 1, 0, -1):
        low = (1 << b) - 1
        for k in range(len(x)):
            flip = (x[k] >> b) & 1 == 1
            swapped = np.where(flip, 0, (x[0] ^ x[k]) & low)
            x[0] ^= np.where(flip, low, swapped)
            x[k] ^= swapped
    for k in range(1, len(x)):
        x[k] ^= x[k - 1]
    turned = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, 0, -1):
        turned ^= np.where((x[-1] >> b) & 1 == 1, (1 << b) - 1, 0)
    x ^= turned
    key = np.zeros(x.shape[1], np.int64)
    for b in range(bits - 1, -1, -1):
        for row in x:
            key = key << 1 | (row >> b) & 1
    return key


@functools.lru_cache(maxsize=4)
def projections(width: int, orderings: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(ordering, width, curve dimension) rotations, which use up the directions of one before the next begins, and shifts."""
    rng = np.random.default_rng(seed)
    dims = min(CURVE_DIMENSIONS, width)
    per = width // dims
    found: list[np.ndarray] = []
    while len(found) < orderings:
        turn = np.linalg.qr(rng.normal(size=(width, width)))[0]
        found += [turn[:, k * dims : (k + 1) * dims] for k in range(per)]
    return np.stack(found[:orderings]), rng.uniform(-0.5, 0.5, (orderings, dims))


def usable(vector: Column, width: Column | int) -> Column:
    """Of the right width, with finite components only, and not zero."""
    sound = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == width) & sound & F.exists(vector, lambda x: x != 0), F.lit(False))


def matrix(column: pa.Array, width: int) -> np.ndarray:
    flat = column.flatten() if isinstance(column, pa.ListArray) else pa.concat_arrays([c.flatten() for c in column.chunks])
    return flat.to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, width)


def nearest(vectors: DataFrame, is_query: Column, key: str = "vec_id", vector: str = "embedding", k: int = 20,
            orderings: int = ORDERINGS, share: float = SHARE, seed: int = 11) -> DataFrame:
    """(query_id, rank, vec_id, score): the k best candidates found for each query row, its own row left out.

    `is_query` is a condition on the key. Rows with a null key, or with a vector that is null, zero,
    not finite or of another width than most usable ones (the smaller of two widths), take no part. Of rows with the same key
    the one with the least vector counts. Equal vectors are one candidate with its k + 1 least keys, and one
    query with an answer for all of its keys, so copies crowd neither windows nor tasks. Scores are
    inner products in double precision; ties go to the smaller key. No vectors, no rows.
    """
    rows = vectors.select(F.col(key).alias("id"), F.col(vector).cast("array<double>").alias("v")).where("id is not null")
    widths = rows.where(usable(F.col("v"), F.size("v"))).groupBy(F.size("v").alias("width")).count()
    most = widths.orderBy(F.col("count").desc(), "width").first()
    width = most["width"] if most else 1
    rows = rows.where(usable(F.col("v"), width)).groupBy("id").agg(F.min("v").alias("v"))
    # One node per different vector; its name is the least key.
    few = rows.withColumn("r", F.row_number().over(Window.partitionBy("v").orderBy("id"))).where(F.col("r") <= k + 1)
    nodes = few.groupBy("v").agg(F.min("id").alias("node"), F.array_sort(F.collect_list("id")).alias("ids"))
    asked = rows.withColumnRenamed("id", key).where(is_query).select(F.col(key).alias("query_id"), F.col("v").alias("qv"))
    wanted = asked.groupBy("qv").agg(F.lit(True).alias("asked"))
    nodes = written(nodes.join(wanted, F.col("v") == F.col("qv"), "left").select("node", "v", "ids", F.coalesce("asked", F.lit(False)).alias("asked")))
    queries = written(asked.join(nodes.where("asked").select("node", "v"), F.col("qv") == F.col("v")).select("query_id", "node"))
    top = nodes.agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("asked"), 1)).alias("q"), F.sqrt(F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))).alias("m")).first()
    total, greatest = top["n"], top["m"] or 1.0

    placed = _placed(nodes, width, orderings, seed, total, greatest)
    reach = max(k, int(np.ceil(share * total / 2)))
    # As many queries as a block meets at most; a block is copied for every so many of them.
    chunks = max(1, -(-int(top["q"] * min(1.0, share + 2 * BLOCK / max(1, total))) // QUERIES_PER_GROUP))
    found = written(_searched(placed, reach, total, width, k, chunks))

    # A node's copies share its score; a query's own key is left out, so k + 1 of them are enough.
    best = found.groupBy("node", "other").agg(F.max("score").alias("score"))
    best = best.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy(F.col("score").desc(), "other"))).where(F.col("r") <= k + 1)
    answers = best.join(nodes.select(F.col("node").alias("other"), "ids"), "other").select("node", F.explode("ids").alias("vec_id"), "score")
    order = Window.partitionBy("node").orderBy(F.col("score").desc(), "vec_id")
    answers = answers.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).drop("r")
    merged = queries.join(answers, "node").where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id"))
    return merged.select("query_id", rank.cast("int").alias("rank"), "vec_id", "score").where(F.col("rank") <= k)


def _placed(nodes: DataFrame, width: int, orderings: int, seed: int, total: int, greatest: float) -> DataFrame:
    """Candidates and queries with their place among the candidates of each ordering."""

    def keyed(batches):
        turns, shifts = projections(width + 1, orderings, seed)
        for batch in batches:
            v = matrix(batch.column(1), width) / greatest
            asked = batch.column(2).to_numpy(zero_copy_only=False)
            lengths = np.linalg.norm(v, axis=1)
            more = np.sqrt(np.maximum(0, 1 - lengths**2))
            for query, own in ((False, np.arange(len(v))), (True, np.flatnonzero(asked))):
                if not len(own):
                    continue
                at = np.column_stack([v[own] / (lengths[own, None] if query else 1), np.zeros(len(own)) if query else more[own]])
                taken = batch.take(pa.array(own))
                for o in range(orderings):
                    # Projections of unit vectors are about 1 / sqrt(width) wide; cells span six of those.
                    cells = (at @ turns[o] * np.sqrt(width) / 6 + 0.5) * (1 << BITS) + shifts[o]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(own), o, np.int32)), pa.array(hilbert(np.clip(cells, 0, (1 << BITS) - 1), BITS)),
                         pa.array(np.full(len(own), query)), taken.column(0), taken.column(1)],
                        names=["ordering", "place", "query", "node", "v"],
                    )

    keys = nodes.select("node", "v", "asked").mapInArrow(keyed, "ordering int, place bigint, query boolean, node bigint, v array<double>")
    parts = max(1, -(-total * orderings // ROWS_PER_PARTITION))
    ranged = keys.repartitionByRange(parts, "ordering", "place", "node").sortWithinPartitions("ordering", "place", "node", "query")

    def numbered(batches):
        ordering, seen, part = -1, 0, TaskContext.get().partitionId()
        for batch in batches:
            own, query = (batch.column(c).to_numpy(zero_copy_only=False) for c in (0, 2))
            before = np.cumsum(~query) - ~query
            starts = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            base = np.repeat(before[starts], np.diff([*starts, len(own)]))
            rank = before - base
            if own[0] == ordering:
                rank[: starts[1] if len(starts) > 1 else len(own)] += seen
            ordering, seen = own[-1], rank[-1] + (not query[-1])
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(np.full(len(own), part, np.int32)), batch.column(2), batch.column(3), batch.column(4), pa.array(rank)],
                names=["ordering", "part", "query", "node", "v", "rank"],
            )

    # The sorted runs are numbered and written once; a run's rows then count on from the runs before it.
    ranged = written(ranged.mapInArrow(numbered, "ordering int, part int, query boolean, node bigint, v array<double>, rank bigint"))
    sizes = ranged.groupBy("ordering", "part").agg(F.count(F.when(~F.col("query"), 1)).alias("n"))
    before = Window.partitionBy("ordering").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = written(sizes.select(F.col("ordering").alias("o"), F.col("part").alias("p"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("start")))
    out = ranged.join(starts, (F.col("ordering") == F.col("o")) & (F.col("part") == F.col("p")))
    return out.select("ordering", "query", "node", "v", (F.col("start") + F.col("rank")).alias("position"))


def _searched(placed: DataFrame, reach: int, total: int, width: int, k: int, chunks: int) -> DataFrame:
    """(node, other, score): the best of every block that a query's windows meet."""
    blocks = -(-total // BLOCK)
    last = F.lit(max(0, blocks - 1)).cast("bigint")
    low, high = F.floor((F.col("position") - reach) / BLOCK), F.floor((F.col("position") + reach) / BLOCK)
    candidates = placed.where("not query").select("ordering", F.floor(F.col("position") / BLOCK).alias("block"), F.explode(F.sequence(F.lit(0), F.lit(chunks - 1))).alias("chunk"), "node", "v")
    asking = placed.where("query").select(
        F.col("ordering").alias("o"), F.explode(F.sequence(F.greatest(low, F.lit(0).cast("bigint")), F.least(high, last))).alias("block"), F.pmod(F.xxhash64("node"), F.lit(chunks)).cast("int").alias("chunk"),
        F.col("node").alias("asked"), F.col("v").alias("qv"),
    )

    def search(left: pa.Table, right: pa.Table) -> pa.Table:
        out = [[], [], []]
        if left.num_rows and right.num_rows:
            right = right.combine_chunks().take(pa.array(np.argsort(right.column("node").to_numpy(), kind="stable")))
            own, others = right.column("node").to_numpy(), matrix(right.column("v").combine_chunks(), width)
            n = min(k + 1, len(own))
            names, wanted = left.column("asked").to_numpy(), matrix(left.column("qv").combine_chunks(), width)
            for row in range(0, len(names), 256):
                scores = wanted[row : row + 256] @ others.T
                best = np.argpartition(-scores, n - 1, axis=1)[:, :n]
                out[0].append(np.repeat(names[row : row + 256], n))
                out[1].append(own[best].ravel())
                # Summed anew, the same way for a pair wherever it meets.
                out[2].append((wanted[row : row + 256, None, :] * others[best]).sum(axis=2).ravel())
        return pa.table({c: pa.array(np.concatenate(x) if x else [], t) for c, x, t in zip(("node", "other", "score"), out, (pa.int64(), pa.int64(), pa.float64()))})

    return asking.groupBy("o", "block", "chunk").cogroup(candidates.groupBy("ordering", "block", "chunk")).applyInArrow(search, "node bigint, other bigint, score double")

"""Exact similarity self-join: all pairs of vectors nearer than a cosine distance.

Unit vectors within cosine distance t are within e = sqrt(2t) of each other. Space is cut by a tree:
a cell chooses pivots among its own rows, and every row goes home to the child of its nearest pivot.
A row of pivot i is at least (d(x, p_j)^2 - d(x, p_i)^2) / (2 d(p_i, p_j)) away from all rows whose nearest
pivot is j, so it visits the other children where no such bound exceeds e. Cells are split until they hold
at most `cell_rows` home rows or their rows can't be told apart, so where data has structure the
candidates of a row follow from the threshold and not from the table. What is left is cut into blocks
and compared exactly, one bounded matrix product for each pair of blocks.

Of a home and a visited child only the later one gets the visitor, so a pair is found once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import cut_lineage
from .knn import _best, _distances, _names, _unit
from .ordering import first_n

#: Children of a cell at most and at least, and the number that all cells split in one pass have together,
#: which bounds the broadcast; pivots are chosen from four times as many rows, which come to the driver.
FAN, LEAST_FAN, FAN_PER_PASS = 1_024, 16, 65_536
CELL_ROWS, BLOCK_ROWS, DEPTH = 1_024, 2_048, 6  # names of cells fit a long
#: Blocks of a cell whose rows keep their k best only, and rows of such a block at most.
SPREAD, WIDE_ROWS = 16, 32_768
_SLACK = 1e-6


def _matrix(column: pa.Array) -> np.ndarray:
    return _unit(column.to_pylist())


def _spread(rows: np.ndarray, count: int) -> np.ndarray:
    """Rows far from each other: the first, then always that furthest from those chosen."""
    chosen, far = [0], ((rows - rows[0]) ** 2).sum(axis=1)
    while len(chosen) < min(count, len(rows)) and far.max() > 1e-9:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((rows - rows[chosen[-1]]) ** 2).sum(axis=1))
    return rows[chosen]


def reachable(rows: np.ndarray, pivots: np.ndarray, e: float) -> tuple[np.ndarray, np.ndarray]:
    """Home child of each row, and which children can hold a row within e of it, as the plane halfway to its own pivot tells."""
    squares = np.maximum(2.0 - 2.0 * rows @ pivots.T, 0.0)
    home = squares.argmin(axis=1)
    apart = 2.0 * np.sqrt(np.maximum(2.0 - 2.0 * pivots @ pivots.T, 0.0))
    np.fill_diagonal(apart, np.inf)
    own = squares[np.arange(len(rows)), home]
    return home, (squares - own[:, None]) <= (e + _SLACK) * np.maximum(apart[home], 1e-12)


def _pivots(placed: DataFrame, cells: list[int], fan: int) -> dict[int, np.ndarray]:
    """Pivots of each of a bounded number of cells, from its home rows of least hash."""
    wanted = placed.sparkSession.createDataFrame([(c,) for c in cells], "cell bigint")
    home = placed.filter("home").join(F.broadcast(wanted), "cell").withColumn("hash", F.xxhash64(F.col("id").cast("string")))
    rows = first_n(home.select("cell", "vector", "hash", "id"), ["cell"], [F.col("hash"), F.col("id")], 4 * fan).select("cell", "rank", "vector").collect()
    found: dict[int, list] = {}
    for r in sorted(rows, key=lambda r: (r.cell, r["rank"])):
        found.setdefault(r.cell, []).append(r.vector)
    return {cell: _spread(_unit(vectors), fan) for cell, vectors in found.items()}


def _split(placed: DataFrame, pivots: dict[int, np.ndarray], e: float) -> DataFrame:
    """Rows of the given cells in the children they reach; other rows as they are."""
    box = placed.sparkSession.sparkContext.broadcast(pivots)

    def run(batches):
        for batch in batches:
            cells = batch.column(2).to_numpy()
            homes = batch.column(3).to_numpy(zero_copy_only=False)
            row_out, cell_out, home_out = [], [], []
            for cell in np.unique(cells):
                own = np.flatnonzero(cells == cell)
                if cell not in box.value:
                    row_out.append(own), cell_out.append(cells[own]), home_out.append(homes[own])
                    continue
                nearest, reach = reachable(_matrix(batch.column(1).take(pa.array(own))), box.value[cell], e)
                at_home = homes[own]
                reach[at_home] &= np.arange(reach.shape[1])[None, :] > nearest[at_home, None]
                reach[at_home, nearest[at_home]] = True
                row, child = np.nonzero(reach)
                row_out.append(own[row])
                cell_out.append(cell * FAN + child + 1)
                home_out.append(at_home[row] & (child == nearest[row]))
            rows = pa.array(np.concatenate(row_out)) if row_out else pa.array([], pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(rows), batch.column(1).take(rows),
                 pa.array(np.concatenate(cell_out) if row_out else [], pa.int64()), pa.array(np.concatenate(home_out) if row_out else [], pa.bool_())],
                names=["id", "vector", "cell", "home"],
            )

    return cut_lineage(placed.mapInArrow(run, placed.schema))


def placed_rows(entries: DataFrame, max_distance: float, cell_rows: int = CELL_ROWS, depth: int = DEPTH) -> DataFrame:
    """(id, vector, cell, home): every row in its home cell, and in the cells it visits.

    A cell stops being split when it is small, or when a split leaves nearly all of its home rows and
    visits in one child (copies and rows that the threshold can't separate).
    """
    e = float(np.sqrt(2.0 * max_distance))
    id_type = entries.schema["id"].dataType.simpleString()
    norm = F.aggregate("vector", F.lit(0.0), lambda total, x: total + x.cast("double") * x.cast("double"))
    placed = cut_lineage(
        entries.select("id", F.col("vector").cast("array<float>").alias("vector")).filter(F.col("vector").isNotNull()).filter(norm > 0)
        .select(F.col("id").cast(id_type).alias("id"), "vector", F.lit(0).cast("bigint").alias("cell"), F.lit(True).alias("home"))
    )
    final: set[int] = set()
    for _ in range(depth):
        counts = placed.groupBy("cell").agg(F.count(F.when(F.col("home"), 1)).alias("n"), F.count("*").alias("all"))
        large = [(r.cell, r.n, r["all"]) for r in counts.filter(F.col("n") > cell_rows).collect() if r.cell not in final]
        if not large:
            break
        # As many children as the rows ask for, and no more than a pass may have for all its cells.
        fan = max(LEAST_FAN, min(FAN, 4 * max(n for _, n, _ in large) // cell_rows, FAN_PER_PASS // len(large)))
        for at in range(0, len(large), FAN_PER_PASS // fan):
            part = large[at : at + FAN_PER_PASS // fan]
            pivots = {c: p for c, p in _pivots(placed, [c for c, _, _ in part], fan).items() if len(p) > 1}
            final |= {c for c, _, _ in part if c not in pivots}
            if pivots:
                gain = _kept_work(placed, pivots, e)
                final |= {c for c in pivots if gain.get(c, 1.0) > 0.7}
                placed = _split(placed, {c: p for c, p in pivots.items() if c not in final}, e)
    return placed


def _kept_work(placed: DataFrame, pivots: dict[int, np.ndarray], e: float) -> dict[int, float]:
    """Share of a cell's comparisons that is left after a split, estimated on its sample of home rows."""
    wanted = placed.sparkSession.createDataFrame([(c,) for c in pivots], "cell bigint")
    home = placed.filter("home").join(F.broadcast(wanted), "cell").withColumn("hash", F.xxhash64(F.col("id").cast("string"), F.lit(1)))
    rows = first_n(home.select("cell", "vector", "hash", "id"), ["cell"], [F.col("hash"), F.col("id")], 256).select("cell", "vector").collect()
    found: dict[int, list] = {}
    for r in rows:
        found.setdefault(r.cell, []).append(r.vector)
    left = {}
    for cell, vectors in found.items():
        nearest, reach = reachable(_unit(vectors), pivots[cell], e)
        homes = np.bincount(nearest, minlength=reach.shape[1])
        left[cell] = float((homes * reach.sum(axis=0)).sum()) / len(vectors) ** 2
    return left


def candidates(placed: DataFrame) -> int:
    """Number of pairs that are compared."""
    n = F.count(F.when(F.col("home"), 1))
    per_cell = placed.groupBy("cell").agg((n * (n - 1) / 2 + n * (F.count("*") - n)).alias("pairs"))
    return int(per_cell.agg(F.sum("pairs")).first()[0] or 0)


def _met(entries: DataFrame, max_distance: float, cell_rows: int, block_rows: int | None) -> tuple[DataFrame, DataFrame]:
    """Both sides of the block pairs to compare: left by (cell, lb, rb), right by (other_cell, lb2, rb2).

    Without `block_rows`, a cell is cut into some SPREAD blocks of at most WIDE_ROWS rows, so that few copies of a row travel.
    """
    if not 0 < max_distance <= 1:
        raise ValueError("the distance must be above 0 and at most 1")
    placed = placed_rows(entries, max_distance, cell_rows)
    rows = F.lit(block_rows) if block_rows else F.greatest(F.lit(BLOCK_ROWS), F.least(F.lit(WIDE_ROWS), F.ceil(F.col("all") / SPREAD)))
    counts = placed.groupBy("cell").agg(F.count(F.when(F.col("home"), 1)).alias("homes"), F.count("*").alias("all"))
    blocks = counts.filter("homes > 0").select(
        "cell", F.ceil(F.col("homes") / rows).cast("int").alias("hb"), F.ceil((F.col("all") - F.col("homes")) / rows).cast("int").alias("vb")
    )
    sized = placed.join(blocks, "cell")
    spot = F.xxhash64(F.col("id").cast("string"))
    home = sized.filter("home").withColumn("block", F.pmod(spot, F.col("hb")).cast("int"))
    last = F.col("hb") + F.col("vb") - 1
    left = home.select("id", "vector", "cell", F.col("block").alias("lb"), F.explode(F.sequence("block", last)).alias("rb"))
    # Other names than on the left: both sides come from one frame.
    right_home = home.select(
        F.col("id").alias("other"), F.col("vector").alias("other_vector"), F.col("cell").alias("other_cell"),
        F.explode(F.sequence(F.lit(0), "block")).alias("lb2"), F.col("block").alias("rb2"),
    )
    right_visit = sized.filter("NOT home").select(
        F.col("id").alias("other"), F.col("vector").alias("other_vector"), F.col("cell").alias("other_cell"),
        F.explode(F.sequence(F.lit(0), F.col("hb") - 1)).alias("lb2"), (F.col("hb") + F.pmod(spot, F.col("vb"))).cast("int").alias("rb2"),
    )

    return left, right_home.unionByName(right_visit)


def pairs_within(entries: DataFrame, max_distance: float, cell_rows: int = CELL_ROWS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(a, b, distance) of all pairs of entries(id, vector) with a distance below `max_distance`, once each.

    Ids are unique. Null and zero vectors are near nothing. Which end of a pair is `a` isn't stated.
    Copies of a vector should be one entry (see `vector_classes`): m copies are m * m / 2 pairs.
    """
    left, right = _met(entries, max_distance, cell_rows, block_rows)
    id_type = entries.schema["id"].dataType.simpleString()

    def match(key, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"a": [], "b": [], "distance": []})
        near = _distances(_unit(one["vector"]), _unit(two["other_vector"]))
        hit = near < max_distance
        if key[1] == key[2]:  # a block against itself: both sides hold the same rows
            place = {x: k for k, x in enumerate(one["id"])}
            hit &= np.arange(len(one))[:, None] < np.array([place[x] for x in two["other"]])[None, :]
        a, b = np.nonzero(hit)
        return pd.DataFrame({"a": one["id"].to_numpy()[a], "b": two["other"].to_numpy()[b], "distance": near[a, b]})

    return left.groupBy("cell", "lb", "rb").cogroup(right.groupBy("other_cell", "lb2", "rb2")).applyInPandas(match, f"a {id_type}, b {id_type}, distance double")


def nearest_within(entries: DataFrame, k: int, max_distance: float, cell_rows: int = CELL_ROWS, block_rows: int | None = None) -> DataFrame:
    """(id, near, distance, rank): up to k nearest others below the distance, for distinct vectors with unique ids.

    Every two blocks give each of their rows its k best there, so what leaves a comparison follows from rows and
    blocks, and not from how many pairs the threshold lets through.
    """
    left, right = _met(entries, max_distance, cell_rows, block_rows)
    id_type = entries.schema["id"].dataType.simpleString()

    def match(key, one: pd.DataFrame, two: pd.DataFrame) -> pd.DataFrame:
        if not len(one) or not len(two):
            return pd.DataFrame({"probe_id": [], "id": [], "distance": []})
        sides = [(_names(one["id"]), _unit(one["vector"])), (_names(two["other"]), _unit(two["other_vector"]))]
        same = key[1] == key[2]  # a block against itself: both sides hold the same rows
        found = [
            _best(*probes, *others, k + int(same), max_distance, np.full(len(probes[0]), np.inf))
            for probes, others in ([sides] if same else [sides, sides[::-1]])
        ]
        found = pd.concat([f[f["probe_id"] != f["id"]] if same else f for f in found], ignore_index=True)
        return found[["probe_id", "id", "distance"]]

    schema = f"id {id_type}, near {id_type}, distance double"
    met = left.groupBy("cell", "lb", "rb").cogroup(right.groupBy("other_cell", "lb2", "rb2"))
    lists = met.applyInPandas(lambda key, one, two: match(key, one, two).set_axis(["id", "near", "distance"], axis=1), schema)
    return first_n(lists, ["id"], [F.col("distance"), F.col("near")], k)


def vector_classes(entries: DataFrame) -> DataFrame:
    """(id, class_id): the least id among the entries with exactly the same vector."""
    keyed = entries.select("id", "vector").filter(F.col("vector").isNotNull()).withColumn("vkey", F.xxhash64("vector"))
    least = keyed.groupBy("vkey", "vector").agg(F.min("id").alias("class_id"))
    return keyed.join(least, ["vkey", "vector"]).select("id", "class_id")


def neighbours_within(entries: DataFrame, k: int, max_distance: float, **plan: int) -> DataFrame:
    """(id, neighbour_id, distance, rank): up to k nearest other rows below the distance, ties by id.

    Copies of a vector are joined once; each then takes the shared list without itself. A list needs
    at most k + 1 ids of any one vector.
    """
    keyed = cut_lineage(
        entries.select("id", "vector").filter(F.col("vector").isNotNull()).join(vector_classes(entries), "id").select("id", "class_id", "vector")
    )
    # A class beyond the k nearest, by distance and least id, has no id among the k nearest.
    others = nearest_within(keyed.filter("id = class_id").select("id", "vector"), k, max_distance, **plan)
    both = (
        others.select(F.col("id").alias("class_id"), F.col("near").alias("near_class"), "distance")
        .unionByName(keyed.filter("id = class_id").select("class_id", F.col("id").alias("near_class"), F.lit(0.0).alias("distance")))
    )
    listed = first_n(keyed.select(F.col("class_id").alias("near_class"), F.col("id").alias("neighbour_id")), ["near_class"], [F.col("neighbour_id")], k + 1).drop("rank")
    shared = first_n(both.join(listed, "near_class"), ["class_id"], [F.col("distance"), F.col("neighbour_id")], k + 1).select("class_id", "neighbour_id", "distance")
    found = keyed.select("id", "class_id").join(shared, "class_id").filter("id <> neighbour_id").drop("class_id")
    return first_n(found, ["id"], [F.col("distance"), F.col("neighbour_id")], k)

"""Best-fit packing by hierarchical residuals.

Partitions pack their items best fit, longest first. Nearly full bins are final. The others go up
a tree, where a node packs the bins of its children as if they were items, and so on up to one root.

What goes up is bounded without losing anything. Of the bins of a best-fit packing at most one is
at most half full (two would have become one), and only such bins can still be placed in another.
So there are at most as many movable bins as partitions, and a node needs to send up no more fuller
bins than that; it sends those with most room. A node thus reads at most (fan + fan * partitions)
rows, whatever the number of items.
"""

from __future__ import annotations

import math

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlake.llm.scratch import drop, without, written

ITEMS_PER_PARTITION = 100_000
FAN = 8
NODE = "node bigint, bin bigint, target bigint, at bigint, fill bigint, up boolean"


def best_fit(lengths, capacity: int) -> tuple[list[int], list[int], list[int]]:
    """Bin and offset of each item, in the given order, and the fill of each bin.

    An item goes to the bin with the least room that holds it, else to a new one. Open bins stand in
    stacks by their room; one integer has a bit for each room that some bin has.
    """
    open_bins: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms, bins, offsets, fills = 0, [], [], []
    for n in lengths:
        fitting = rooms >> n
        if fitting:
            room = n + (fitting & -fitting).bit_length() - 1
            own = open_bins[room].pop()
            if not open_bins[room]:
                rooms ^= 1 << room
        else:
            room, own = capacity, len(fills)
            fills.append(0)
        bins.append(own)
        offsets.append(fills[own])
        fills[own] += n
        if room > n:
            open_bins[room - n].append(own)
            rooms |= 1 << (room - n)
    return bins, offsets, fills


def going_up(fills: list[int], capacity: int, slack: int, partitions: int) -> set[int]:
    """The bins a node sends up: all at most half full, and the emptiest others, one per partition at most."""
    small = [b for b, fill in enumerate(fills) if 2 * fill <= capacity]
    fuller = [b for b, fill in enumerate(fills) if 2 * fill > capacity and capacity - fill > slack]
    fuller.sort(key=lambda b: (fills[b], b))
    return {*small, *fuller[:partitions]}


def pack(items: DataFrame, capacity: int, length: str = "length", sequence: str = "sequence_id", offset: str = "offset",
         items_per_partition: int = ITEMS_PER_PARTITION, fan: int = FAN, slack: int | None = None) -> DataFrame:
    """The items with the number of their sequence and their place in it, gapless from 0.

    `length` holds whole numbers from 1 to `capacity`; others raise an error in the task. Repeated
    rows are items of their own. The two result columns take the place of columns of those names. No
    items, no rows. Bins with at most `slack` room (a 64th of the capacity, if not given) are final
    at once. The packing depends on the stored order of the rows only, so a task that runs again
    finds the same one.
    """
    slack = capacity // 64 if slack is None else slack
    own = ("__item", "__bin", "__at", "__fill", "__up")
    stored = written(without(items, sequence, offset, *own).withColumn("__item", F.monotonically_increasing_id()))
    partitions = max(1, math.ceil(stored.count() / items_per_partition))
    dealt = stored.repartition(partitions, F.xxhash64("__item"))
    at_length, at_item = dealt.columns.index(length), dealt.columns.index("__item")

    def leaf(batches):
        rows = list(batches)
        if not rows:
            return
        table = pa.Table.from_batches(rows).combine_chunks()
        order = pc.sort_indices(
            pa.table({"n": table.column(at_length), "i": table.column(at_item)}), [("n", "descending"), ("i", "ascending")]
        )
        table = table.take(order)
        lengths = table.column(at_length).to_pylist()
        if any(n is None or not 0 < n <= capacity for n in lengths):
            raise ValueError(f"lengths must be from 1 to {capacity}")
        bins, offsets, fills = best_fit(lengths, capacity)
        up, base = going_up(fills, capacity, slack, partitions), TaskContext.get().partitionId() << 33
        for name, values, kind in (
            ("__bin", [base + b for b in bins], pa.int64()),
            ("__at", offsets, pa.int64()),
            ("__fill", [fills[b] for b in bins], pa.int64()),
            ("__up", [not at and b in up for b, at in zip(bins, offsets)], pa.bool_()),
        ):
            table = table.append_column(name, pa.array(values, kind))
        yield from table.to_batches(max_chunksize=10_000)

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    placed = written(dealt.mapInArrow(leaf, f"{schema}, __bin bigint, __at bigint, __fill bigint, __up boolean"))
    drop(stored)
    moves = _merge_up(placed, capacity, slack, fan)
    out = [F.col(f"`{c}`") for c in placed.columns if c not in own]
    if moves is None:
        return placed.select(*out, F.col("__bin").alias(sequence), F.col("__at").alias(offset))
    return placed.join(moves, placed["__bin"] == moves["moved"], "left").select(
        *out, F.coalesce("moved_to", "__bin").alias(sequence), (F.col("__at") + F.coalesce("moved_at", F.lit(0))).alias(offset)
    )


def _merge_up(placed: DataFrame, capacity: int, slack: int, fan: int) -> DataFrame | None:
    """(moved, moved_to, moved_at): the leaf bins that end inside another one, and where."""

    def node(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["fill", "bin"], ascending=[False, True], kind="stable").reset_index(drop=True)
        bins, offsets, fills = best_fit(rows["fill"].tolist(), capacity)
        up = going_up(fills, capacity, slack, leaves)
        first = {}
        for row, b in enumerate(bins):
            first.setdefault(b, row)
        heads = rows["bin"].to_numpy()[[first[b] for b in bins]]
        return rows.assign(
            target=heads, at=offsets, fill=[fills[b] for b in bins], up=[not at and b in up for b, at in zip(bins, offsets)]
        )[["node", "bin", "target", "at", "fill", "up"]]

    bins = placed.where("__up").select(
        F.shiftright("__bin", 33).alias("node"), F.col("__bin").alias("bin"), F.col("__fill").alias("fill")
    )
    last = placed.agg(F.max(F.shiftright("__bin", 33))).first()[0]
    levels, partitions = [], (last or 0) + 1
    leaves = partitions
    while partitions > 1:
        partitions = math.ceil(partitions / fan)
        level = written(
            bins.withColumn("node", F.floor(F.col("node") / fan).cast("bigint")).groupBy("node").applyInPandas(node, NODE)
        )
        levels.append(level.where("bin <> target").select("bin", "target", "at"))
        bins = level.where("up").select("node", "bin", "fill")
    if not levels:
        return None
    total = _named(levels[-1])
    for level in reversed(levels[:-1]):
        further = level.join(total, level["target"] == total["moved"], "left").select(
            F.col("bin").alias("moved"), F.coalesce("moved_to", "target").alias("moved_to"),
            (F.col("at") + F.coalesce("moved_at", F.lit(0))).alias("moved_at"),
        )
        total = total.unionByName(further)
    return written(total)


def _named(level: DataFrame) -> DataFrame:
    return level.select(F.col("bin").alias("moved"), F.col("target").alias("moved_to"), F.col("at").alias("moved_at"))

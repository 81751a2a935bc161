"""Advisory precedent: a fold over the deliberations of each conflict pattern.

There are few patterns, so each one is hot. The fold is a small automaton: the standing
resolution, a confidence out of a finite set, and an additive count. A bounded chunk of
consecutive deliberations is therefore a map from every possible entry state to its exit
state; chunk maps compose, so chunks are folded in parallel and joined in a tree.

Deliberations: (pattern_hash, seq, kind, resolution, winner_rule, source_key), with seq unique
per pattern and kind 'deliberate' or 'reinforce'. The set of resolutions must be small.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.trust import floor_div
from ..schema import PRECEDENT_BASE, PRECEDENT_CEILING, PRECEDENT_FLOOR, PRECEDENT_STEP
from ..session import cut_lineage

_FAN_IN = 64


def _confidences() -> list[float]:
    """Every confidence reachable from the base in double arithmetic."""
    seen, todo = {PRECEDENT_BASE}, [PRECEDENT_BASE]
    while todo:
        c = todo.pop()
        steps = [min(PRECEDENT_CEILING, c + PRECEDENT_STEP)]
        if c - PRECEDENT_STEP >= PRECEDENT_FLOOR:
            steps.append(c - PRECEDENT_STEP)
        for n in steps:
            if n not in seen:
                seen.add(n)
                todo.append(n)
    return sorted(seen)


CONFIDENCES = _confidences()
_INDEX = {c: i for i, c in enumerate(CONFIDENCES)}
_UP = np.array([_INDEX[min(PRECEDENT_CEILING, c + PRECEDENT_STEP)] for c in CONFIDENCES])
_DOWN = np.array(
    [_INDEX[c - PRECEDENT_STEP] if c - PRECEDENT_STEP >= PRECEDENT_FLOOR else -1 for c in CONFIDENCES]
)
_BASE = _INDEX[PRECEDENT_BASE]
_N = len(CONFIDENCES)


def _tables(n_res: int):
    """Per event code (resolution, reinforce; new source or not) and state: next state, whether
    the event sets the standing rule anew, and whether it adds one application.

    State 0 is no precedent yet, then resolution x confidence.
    """
    res = np.concatenate([[-1], np.repeat(np.arange(n_res), _N)])
    conf = np.concatenate([[_BASE], np.tile(np.arange(_N), n_res)])
    nexts, starts, adds = [], [], []
    for code in range(2 * (n_res + 1)):
        given, is_new = code // 2, code % 2 == 1
        known = res >= 0
        agree = known & ((res == given) | (given == n_res))
        dissent = known & ~agree
        flip = dissent & (_DOWN[conf] < 0)
        start = flip | (~known & (given < n_res))
        moved = np.where(agree & is_new, _UP[conf], np.where(dissent, _DOWN[conf], conf))
        moved = np.where(start, _BASE, moved)
        standing = np.where(start, given, res)
        nexts.append(np.where(standing < 0, 0, 1 + standing * _N + moved))
        starts.append(start)
        adds.append(agree.astype(np.int64))
    return nexts, starts, adds


def _codes(rows: pd.DataFrame, n_res: int) -> np.ndarray:
    given = np.where(rows["reinforce"].to_numpy(dtype=bool), n_res, rows["res"].to_numpy())
    return given * 2 + rows["is_new"].to_numpy(dtype=np.int64)


def _fold(rows: pd.DataFrame, n_res: int):
    """Transition of one chunk for every entry state: (state, count, reset, seat).

    Every event is a map; neighbours are composed, all pairs at once, until one map is left.
    """
    nexts, starts, adds = (np.stack(t) for t in _tables(n_res))
    codes = _codes(rows, n_res)
    reset = starts[codes]
    seat = np.where(reset, rows["seq"].to_numpy(dtype=np.int64)[:, None], -1)
    maps = nexts[codes], np.where(reset, 1, adds[codes]), reset, seat
    while len(maps[0]) > 1:
        even = len(maps[0]) // 2 * 2
        joined = _compose(tuple(m[:even:2] for m in maps), tuple(m[1:even:2] for m in maps))
        maps = tuple(np.concatenate([j, m[even:]]) for j, m in zip(joined, maps))
    return tuple(m[0] for m in maps)


def _compose(first, second):
    """`first` then `second`, both (state, count, reset, seat) arrays by entry state, of one map or a row for each."""
    s1, c1, r1, t1 = first
    s2, c2, r2, t2 = (np.take_along_axis(a, s1, -1) for a in second)
    return s2, np.where(r2, c2, c1 + c2), r1 | r2, np.where(t2 >= 0, t2, t1)


_MAP = "state array<int>, count array<bigint>, reset array<boolean>, seat array<bigint>"


def _prepared(
    events: DataFrame, chunk_rows: int, standing: DataFrame | None = None, sources: DataFrame | None = None
) -> tuple[DataFrame, list[str]]:
    """Events that count, coded, with their chunk; patterns that stand already count from their first event."""
    given = events.filter("kind = 'deliberate'").select("resolution")
    if standing is not None:
        given = given.unionByName(standing.select("resolution"))
    names = sorted(r[0] for r in given.distinct().collect()) or [""]  # no resolution at all: one name that stays unused
    # Written, so that the planner sees how small they are and need not shuffle by hot pattern.
    births = events.groupBy("pattern_hash").agg(
        F.min(F.when(F.col("kind") == "deliberate", F.col("seq"))).alias("born"), F.min("seq").alias("_first")
    )
    if standing is not None:
        births = births.join(standing.select("pattern_hash", F.lit(True).alias("_stands")), "pattern_hash", "left")
        births = births.withColumn("born", F.when(F.col("_stands"), F.col("_first")).otherwise(F.col("born")))
    born = cut_lineage(births.select("pattern_hash", "born"))
    alive = events.join(born, "pattern_hash").filter(F.col("seq") >= F.col("born")).drop("born")
    debuts = alive.groupBy("pattern_hash", "source_key").agg(F.min("seq").alias("debut"))
    if sources is not None:
        met = sources.select("pattern_hash", "source_key", F.lit(True).alias("_met"))
        debuts = debuts.join(met, ["pattern_hash", "source_key"], "left")
        debuts = debuts.withColumn("debut", F.when(F.col("_met").isNull(), F.col("debut"))).drop("_met")
    debut = cut_lineage(debuts)
    code = F.array_position(F.array(*[F.lit(n) for n in names]), F.col("resolution")) - 1
    ready = (
        alive.join(debut, ["pattern_hash", "source_key"])
        .withColumn("is_new", F.coalesce(F.col("seq") == F.col("debut"), F.lit(False)))
        .withColumn("reinforce", F.col("kind") == "reinforce")
        .withColumn("res", F.coalesce(code, F.lit(-1)).cast("int"))
        .withColumn("_span", floor_div(F.col("seq"), chunk_rows))
    )
    return ready.join(_chunks(alive, chunk_rows), ["pattern_hash", "_span"]).drop("_span"), names


def _chunks(alive: DataFrame, chunk_rows: int) -> DataFrame:
    """(pattern_hash, _span, chunk): consecutive spans of `seq` joined until they have `chunk_rows` rows, and fewer than twice that.

    A pattern's events can lie far apart in `seq`; a chunk for every span would then hold a few rows only.
    """
    spans = alive.groupBy("pattern_hash", floor_div(F.col("seq"), chunk_rows).alias("_span")).agg(F.count("*").alias("_n"))
    before = Window.partitionBy("pattern_hash").orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    earlier = F.coalesce(F.sum("_n").over(before), F.lit(0))
    return cut_lineage(spans.select("pattern_hash", "_span", floor_div(earlier, chunk_rows).alias("chunk")))


def _chunk_maps(ready: DataFrame, n_res: int) -> DataFrame:
    key_type = ready.schema["pattern_hash"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        state, count, reset, seat = _fold(rows, n_res)
        return pd.DataFrame(
            {
                "pattern_hash": [rows["pattern_hash"].iloc[0]], "chunk": [rows["chunk"].iloc[0]],
                "state": [state], "count": [count], "reset": [reset], "seat": [seat],
            }
        )

    return (
        ready.select("pattern_hash", "chunk", "seq", "res", "is_new", "reinforce")
        .groupBy("pattern_hash", "chunk")
        .applyInPandas(run, f"pattern_hash {key_type}, chunk bigint, {_MAP}")
    )


def _levels(maps: DataFrame) -> list[DataFrame]:
    """Chunk maps of each pattern, composed `_FAN_IN` neighbours a level up to one map a pattern."""
    key_type = maps.schema["pattern_hash"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        total = None
        for r in rows.itertuples():
            part = tuple(np.asarray(x) for x in (r.state, r.count_, r.reset, r.seat))
            total = part if total is None else _compose(total, part)
        return pd.DataFrame(
            {
                "pattern_hash": [rows["pattern_hash"].iloc[0]], "chunk": [rows["parent"].iloc[0]],
                "state": [total[0]], "count": [total[1]], "reset": [total[2]], "seat": [total[3]],
            }
        )

    levels = [maps]
    while True:
        top = levels[-1].agg(F.max("chunk"), F.min("chunk")).first()
        if top[0] is None or top[0] == top[1]:
            return levels
        levels.append(
            cut_lineage(
                levels[-1].withColumn("parent", floor_div(F.col("chunk"), _FAN_IN))
                .withColumnRenamed("count", "count_")
                .groupBy("pattern_hash", "parent")
                .applyInPandas(run, f"pattern_hash {key_type}, chunk bigint, {_MAP}")
            )
        )


def _entries(levels: list[DataFrame], start: DataFrame) -> DataFrame:
    """(pattern_hash, chunk, entry, entry_count): the state in which each chunk is entered.

    It goes down the levels, from the state a pattern starts in; a group is the children of one map.
    """
    key_type = levels[0].schema["pattern_hash"].dataType.simpleString()

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("chunk")
        state, count, out = int(rows["entry"].iloc[0]), int(rows["entry_count"].iloc[0]), []
        for r in rows.itertuples():
            out.append((r.pattern_hash, r.chunk, state, count))
            count = r.count_[state] if r.reset[state] else count + r.count_[state]
            state = r.state[state]
        return pd.DataFrame(out, columns=["pattern_hash", "chunk", "entry", "entry_count"])

    entries = levels[-1].select("pattern_hash", "chunk").join(start, "pattern_hash")
    for lower in reversed(levels[:-1]):
        above = entries.withColumnRenamed("chunk", "parent")
        entries = cut_lineage(
            lower.withColumnRenamed("count", "count_").drop("seat")
            .withColumn("parent", floor_div(F.col("chunk"), _FAN_IN))
            .join(above, ["pattern_hash", "parent"])
            .groupBy("pattern_hash", "parent")
            .applyInPandas(run, f"pattern_hash {key_type}, chunk bigint, entry int, entry_count bigint")
        )
    return entries


def _decoded(df: DataFrame, names: list[str]) -> DataFrame:
    idx = F.col("exit") - 1
    return df.withColumn(
        "resolution", F.array(*[F.lit(n) for n in names])[F.floor(idx / _N).cast("int")]
    ).withColumn("confidence", F.array(*[F.lit(c) for c in CONFIDENCES])[F.pmod(idx, F.lit(_N)).cast("int")])


def fold(events: DataFrame, chunk_rows: int = 20_000) -> DataFrame:
    """(pattern_hash, contradiction_type?, resolution, winner_rule, confidence, applied_count)."""
    ready, names = _prepared(events, chunk_rows)
    done = _levels(cut_lineage(_chunk_maps(ready, len(names))))[-1].select(
        "pattern_hash",
        F.col("state")[0].alias("exit"),
        F.col("count")[0].alias("applied_count"),
        F.col("seat")[0].alias("seat"),
    )
    ruling = events.select("pattern_hash", F.col("seq").alias("seat"), "winner_rule")
    return (
        _decoded(done, names)
        .join(ruling, ["pattern_hash", "seat"])
        .select("pattern_hash", "resolution", "winner_rule", "confidence", "applied_count")
    )


def _no_start(ready: DataFrame) -> DataFrame:
    return ready.select("pattern_hash").distinct().select("pattern_hash", F.lit(0).alias("entry"), F.lit(0).cast("bigint").alias("entry_count"))


def trace(events: DataFrame, chunk_rows: int = 20_000) -> DataFrame:
    """Per deliberation: standing resolution and confidence after it, and `overturned`.

    Chunk maps, composed in a tree, give every chunk its entry state; the chunks are then replayed
    in parallel.
    """
    ready, names = _prepared(events, chunk_rows)
    ready = cut_lineage(ready)
    levels = _levels(cut_lineage(_chunk_maps(ready, len(names))))
    return _replayed(ready, names, _entries(levels, _no_start(ready)))


_STANDING = ["pattern_hash", "resolution", "winner_rule", "confidence", "applied_count"]


def advance(
    events: DataFrame, standing: DataFrame | None = None, sources: DataFrame | None = None, chunk_rows: int = 20_000
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """`trace` of a batch of events that follow others, and what the next batch has to know.

    `standing` (the columns of `fold`) and `sources` (pattern_hash, source_key) are what the earlier
    batches left; None for the first. Gives the trace, the standing rules of the batch's patterns, and
    the sources that are new. Cuts of the same events into batches give the same rows.
    """
    ready, names = _prepared(events, chunk_rows, standing, sources)
    ready = cut_lineage(ready)
    levels = _levels(cut_lineage(_chunk_maps(ready, len(names))))
    start = _no_start(ready).withColumn("_winner", F.lit(None).cast("string"))
    if standing is not None:
        number = (F.array_position(F.array(*[F.lit(n) for n in names]), F.col("resolution")) - 1) * _N
        number = number + F.array_position(F.array(*[F.lit(c) for c in CONFIDENCES]), F.col("confidence"))
        held = standing.select("pattern_hash", number.cast("int").alias("_at"), F.col("applied_count").alias("_n"), F.col("winner_rule").alias("_rule"))
        start = start.join(held, "pattern_hash", "left").select(
            "pattern_hash", F.coalesce("_at", "entry").alias("entry"), F.coalesce("_n", "entry_count").alias("entry_count"), F.col("_rule").alias("_winner")
        )
    start = cut_lineage(start)
    rows = _replayed(ready, names, _entries(levels, start.drop("_winner")))
    count = F.col("count")[F.col("entry")]
    left = levels[-1].join(start, "pattern_hash").select(
        "pattern_hash", "_winner", F.col("state")[F.col("entry")].alias("exit"), F.col("seat")[F.col("entry")].alias("seat"),
        F.when(F.col("reset")[F.col("entry")], count).otherwise(F.col("entry_count") + count).alias("applied_count"),
    )
    ruling = events.select("pattern_hash", F.col("seq").alias("seat"), "winner_rule")
    after = _decoded(left, names).join(ruling, ["pattern_hash", "seat"], "left")
    after = after.withColumn("winner_rule", F.when(F.col("seat") >= 0, F.col("winner_rule")).otherwise(F.col("_winner"))).select(*_STANDING)
    return rows, after, ready.filter("is_new").select("pattern_hash", "source_key")


def _replayed(ready: DataFrame, names: list[str], starts: DataFrame) -> DataFrame:
    key_type = ready.schema["pattern_hash"].dataType.simpleString()

    def replay(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("seq")
        # Lists: a step takes one number out, which is slow from arrays.
        nexts, begins, adds = ([x.tolist() for x in t] for t in _tables(len(names)))
        state, count = int(rows["entry"].iloc[0]), int(rows["entry_count"].iloc[0])
        before, after, conf, counts, flips = [], [], [], [], []
        for code in _codes(rows, len(names)).tolist():
            begin = begins[code][state]
            before.append(names[(state - 1) // _N] if state else None)
            flips.append(begin and state > 0)
            count = 1 if begin else count + adds[code][state]
            state = nexts[code][state]
            after.append(names[(state - 1) // _N])
            conf.append(CONFIDENCES[(state - 1) % _N])
            counts.append(count)
        return pd.DataFrame(
            {
                "pattern_hash": rows["pattern_hash"].to_numpy(), "seq": rows["seq"].to_numpy(),
                "before_resolution": before, "after_resolution": after, "confidence": conf,
                "applied_count": counts, "overturned": flips,
            }
        )

    return (
        ready.select("pattern_hash", "chunk", "seq", "res", "is_new", "reinforce")
        .join(starts, ["pattern_hash", "chunk"])
        .groupBy("pattern_hash", "chunk")
        .applyInPandas(
            replay,
            f"pattern_hash {key_type}, seq bigint, before_resolution string, after_resolution string,"
            " confidence double, applied_count bigint, overturned boolean",
        )
    )


def listing(precedents: DataFrame) -> DataFrame:
    return precedents.orderBy(F.col("applied_count").desc(), F.col("confidence").desc(), "pattern_hash")

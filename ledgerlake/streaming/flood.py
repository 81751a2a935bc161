"""Flood admission on a stream, equal to the batch operator for rows in time order."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..functions.trust import floor_div
from ..schema import FLOOD_LIMIT, FLOOD_WINDOW_SECONDS
from .common import use_rocksdb, write_batch


#: Actors are dealt over so many groups, so the number of keys follows the spans and not the actors.
GROUPS = 256


class _Window(StatefulProcessor):
    """State of one (group of actors, span): low-trust submission times of two window widths, by actor."""

    def __init__(self, width: int, limit: int, carry: bool):
        self.width, self.limit, self.carry = width, limit, carry

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.times = handle.getListState("times", "actor string, us bigint")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        _, span = key
        batch = pd.concat(list(rows)).sort_values(["us", "order_id"], kind="stable", ignore_index=True)
        mark = int(timerValues.getCurrentWatermarkInMs())
        missed = batch["us"].to_numpy(dtype=np.int64) <= mark * 1000
        if missed.any():
            over = batch[missed & batch["own"].to_numpy(dtype=bool)]
            batch = batch[~missed]
            if len(over):
                held = (over["low"].to_numpy() == 1) & (self.limit > 0)
                yield self._out(over, [None] * len(over), held, [pd.Timestamp(mark, unit="ms", tz="UTC")] * len(over))
            if not len(batch):
                return
        known = list(self.times.get())
        low = batch[batch["low"] == 1]
        if len(low):
            self.times.appendList([(None if pd.isna(actor) else actor, int(us)) for actor, us in zip(low["actor"].tolist(), low["us"])])
        self.handle.registerTimer(int((span + 2) * self.width // 1000))
        own = batch[batch["own"].astype(bool)]
        if not len(own):
            return
        # Times of all actors in one row: each actor has a stretch of its own, wider than three windows.
        everyone = pd.concat([own["actor"], low["actor"], pd.Series([t[0] for t in known], dtype=own["actor"].dtype)], ignore_index=True)
        code = pd.factorize(everyone, use_na_sentinel=False)[0].astype(np.int64)
        first = (span - 2) * self.width
        stretch = 6 * self.width
        at = code[: len(own)] * stretch + own["us"].to_numpy(dtype=np.int64) - first
        new = code[len(own) : len(own) + len(low)] * stretch + low["us"].to_numpy(dtype=np.int64) - first
        before = code[len(own) + len(low) :] * stretch + np.array([t[1] for t in known], dtype=np.int64) - first
        every = np.sort(np.concatenate([before, new]))
        upto = np.searchsorted(every, at, side="right")
        start = np.searchsorted(every, at - self.width, side="left")
        # Low-trust rows of this batch at the time of a row that have its id (itself) or a larger one.
        peers = pd.DataFrame({"at": np.concatenate([at, new]), "id": pd.concat([own["order_id"], low["order_id"]], ignore_index=True), "new": np.repeat([0, 1], [len(at), len(new)])})
        peers = peers.sort_values(["at", "id", "new"], ascending=[True, False, False], kind="stable")
        above = peers.groupby("at")["new"].cumsum() - peers["new"]
        later = above[peers["new"] == 0].sort_index().to_numpy(dtype=np.int64)
        prior = upto - start - later
        held = (own["low"].to_numpy() == 1) & (prior >= self.limit) & (self.limit > 0)
        yield self._out(own, prior, held, [None] * len(own))

    def _out(self, own: pd.DataFrame, prior, held, missed: list) -> pd.DataFrame:
        more = {"carried": own["carried"].to_numpy()} if self.carry else {}
        return pd.DataFrame(
            {
                "actor": own["actor"].to_numpy(), "order_id": own["order_id"].to_numpy(), "prior": pd.Series(prior, dtype="Int64").to_numpy(dtype=object),
                "held": held, "missed": pd.Series(missed, dtype="datetime64[us, UTC]"), **more,
            }
        )

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.times.clear()
        return iter(())

    def close(self) -> None:
        pass


def split_late(marked: DataFrame, batch_id: int, root: str) -> None:
    """A batch of `flood_stream` in two sinks below `root`: `judged`, and `late` with the watermark that was missed."""
    write_batch(marked.filter("missed IS NULL").drop("missed"), f"{root}/judged", batch_id)
    write_batch(marked.filter("missed IS NOT NULL").drop("prior"), f"{root}/late", batch_id)


def flood_stream(
    events: DataFrame,
    actor: str,
    submitted: str,
    order_id: str,
    low: Column,
    limit: int = FLOOD_LIMIT,
    window_seconds: int = FLOOD_WINDOW_SECONDS,
    lateness: str = "10 minutes",
    carry: Column | None = None,
) -> DataFrame:
    """(actor, order_id, prior, held, missed), every row once. State is keyed by (group of actors, span), two windows
    wide at most, so a busy actor is spread over tasks, rare ones share a call, and old state expires with the watermark.

    A row that isn't later than the watermark (the latest time of all earlier batches, less
    `lateness`) comes out too: `missed` is that watermark, null for all others. It counts for no window, has no
    `prior`, and is held if it is a low-trust one, since nobody can tell any more what came before it.
    `carry`, a text, comes out again as `carried`."""
    use_rocksdb(events.sparkSession)
    width = window_seconds * 1_000_000
    us = F.unix_micros(F.col("at"))
    span = floor_div(us, width)
    is_low = F.col("low") == 1
    visits = F.filter(
        F.array(
            F.struct(span.alias("span"), F.lit(True).alias("own")),
            F.when(is_low, F.struct((span + 1).alias("span"), F.lit(False).alias("own"))),
        ),
        lambda v: v.isNotNull(),
    )
    more = [] if carry is None else [carry.cast("string").alias("carried")]
    own_text = [] if carry is None else [F.when(F.col("v.own"), F.col("carried")).alias("carried")]
    kept = [] if carry is None else ["carried"]
    routed = (
        events.select(
            # As text: rows of several keys come in one batch, where a missing number makes doubles of the others.
            F.col(actor).cast("string").alias("actor"),
            F.col(order_id).alias("order_id"),
            F.col(submitted).cast("timestamp").alias("at"),
            low.cast("int").alias("low"),
            *more,
        )
        .withWatermark("at", lateness)
        # Without the event time itself, so that rows past the watermark aren't dropped before the state sees them.
        .select("actor", "order_id", us.alias("us"), "low", *kept, F.explode(visits).alias("v"))
        .select("actor", "order_id", "us", "low", "v.span", "v.own", *own_text)
    )
    actor_type = events.select(actor).schema[0].dataType.simpleString()
    id_type = routed.schema["order_id"].dataType.simpleString()
    group = F.pmod(F.xxhash64("actor"), F.lit(GROUPS)).cast("int")
    return routed.withColumn("actors", group).groupBy("actors", "span").transformWithStateInPandas(
        statefulProcessor=_Window(width, limit, carry is not None),
        outputStructType=f"actor string, order_id {id_type}, prior bigint, held boolean, missed timestamp" + (", carried string" if kept else ""),
        outputMode="Append",
        timeMode="EventTime",
    ).withColumn("actor", F.col("actor").cast(actor_type))

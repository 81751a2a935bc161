"""Precedent as a stream: each batch is folded in chunks and joined to what the earlier ones left."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import precedent
from ..session import cut_lineage
from .common import read_batches, write_batch


def process_batch(batch: DataFrame, batch_id: int, root: str, chunk_rows: int = 20_000) -> None:
    """Trace one batch of deliberations, in order of seq, after all earlier batches.

    Below `root`: `trace` in the shape of the batch trace, `standing` (the rules of the batch's patterns
    after it) and `sources` (those seen for the first time), each by batch. A replayed batch reads
    only what stands before it and writes its folders anew. No task holds more than `chunk_rows` events or
    the 64 maps below one map, however hot a pattern is.
    """
    spark = batch.sparkSession
    events = cut_lineage(batch)
    standing = read_batches(spark, f"{root}/standing", batch_id)
    if standing is not None:
        names = [c for c in standing.columns if c not in ("pattern_hash", "batch_id")]
        last = standing.groupBy("pattern_hash").agg(F.max_by(F.struct(*names), "batch_id").alias("last"))
        standing = cut_lineage(last.select("pattern_hash", "last.*"))
    rows, after, new = precedent.advance(events, standing, read_batches(spark, f"{root}/sources", batch_id), chunk_rows)
    write_batch(rows, f"{root}/trace", batch_id)
    write_batch(new, f"{root}/sources", batch_id)
    write_batch(after, f"{root}/standing", batch_id)


def start_precedent(deliberations: DataFrame, root: str, checkpoint: str, trigger: dict, **job) -> StreamingQuery:
    """Drain a stream of deliberations through process_batch."""
    return (
        deliberations.writeStream.foreachBatch(lambda batch, batch_id: process_batch(batch, batch_id, root, **job))
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )

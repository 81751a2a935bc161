"""Chain heads as keyed state: append hashes to records as they arrive."""

from __future__ import annotations

import hashlib
import hmac as _hmac
from collections.abc import Iterator, Mapping

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from .common import use_rocksdb


class _Head(StatefulProcessor):
    def __init__(self, keys: Mapping[str, str]):
        self.keys = {name: value.encode() for name, value in keys.items()}

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.head = handle.getValueState("head", "hash string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values("chain_seq", kind="stable")
        held = self.head.get() if self.head.exists() else None
        prev = held[0] if held else None
        before, after = [], []
        for key_id, text in zip(batch["key_id"], batch["canonical"]):
            before.append(prev)
            message = text if prev is None else text + prev
            prev = _hmac.new(self.keys[key_id], message.encode(), hashlib.sha256).hexdigest()
            after.append(prev)
        self.head.update((prev,))
        yield pd.DataFrame(
            {
                "chain_id": batch["chain_id"].to_numpy(), "chain_seq": batch["chain_seq"].to_numpy(),
                "id": batch["id"].to_numpy(), "key_id": batch["key_id"].to_numpy(),
                "canonical": batch["canonical"].to_numpy(), "prev_hash": before, "record_hash": after,
            }
        )

    def close(self) -> None:
        pass


def chain_stream(records: DataFrame, keyring: Mapping[str, str]) -> DataFrame:
    """Adds prev_hash and record_hash to a stream of (chain_id, chain_seq, id, key_id, canonical).

    State is one hash per chain. Records of a chain must arrive in chain_seq order from batch to
    batch; within a batch they are sorted, so the rows of one chain in one batch are held at once:
    bound them by the source's rate limit.
    """
    use_rocksdb(records.sparkSession)
    staged = records.select("chain_id", "chain_seq", "id", "key_id", "canonical")
    types = {f.name: f.dataType.simpleString() for f in staged.schema.fields}
    return staged.groupBy("chain_id").transformWithStateInPandas(
        statefulProcessor=_Head(keyring),
        outputStructType=(
            f"chain_id {types['chain_id']}, chain_seq bigint, id {types['id']}, key_id string,"
            " canonical string, prev_hash string, record_hash string"
        ),
        outputMode="Append",
        timeMode="None",
    )

"""Blocks of earlier propositions over a stream of turns; an extension, the reference works in batch only.

Turns must come in order within a dialogue: a block holds the complete earlier
set, so a late turn would change what was already emitted.  Late ones are
emitted with ``late`` set and take no part.

State is a map with an entry per proposition, so a new turn writes one entry
and never the history; a dialogue is forgotten once the watermark has passed
its last turn by ``idle``.  The session needs the RocksDB state store.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUTPUT = "dialogue_id string, new_id string, old_id string, block_index int, late boolean"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


class Blocks(StatefulProcessor):
    """The propositions of one dialogue, by turn and id."""

    def __init__(self, block_size: int, idle_ms: int):
        self.block_size, self.idle_ms = block_size, idle_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "turn bigint, prop_id string", "at_ms bigint")
        self.last = handle.getValueState("last", "turn bigint, at_ms bigint")

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        batch = pd.concat(list(rows)).sort_values(["turn", "prop_id"])
        last, at_ms = self.last.get() if self.last.exists() else (None, 0)
        earlier = sorted((int(k[0]), k[1]) for k in self.seen.keys()) if last is not None else []  # as many as a row's output names
        out = []
        for row in batch.itertuples():
            turn, now = int(row.turn), int(row.at.timestamp() * 1000)
            if last is not None and turn < last:
                out.append((key[0], row.prop_id, None, None, True))
                continue
            out += [(key[0], row.prop_id, old, i // self.block_size, False) for i, (t, old) in enumerate(earlier) if t < turn]
            earlier.append((turn, row.prop_id))
            self.seen.updateValue((turn, row.prop_id), (now,))
            last, at_ms = turn, max(at_ms, now)
        if last is not None:
            for t in list(self.handle.listTimers()):
                self.handle.deleteTimer(t)
            self.handle.registerTimer(at_ms + self.idle_ms)
            self.last.update((last, at_ms))
        if out:
            yield pd.DataFrame(out, columns=["dialogue_id", "new_id", "old_id", "block_index", "late"], dtype=object).astype({"block_index": "Int32", "late": bool})

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def stream_blocks(turns: DataFrame, block_size: int = 8, idle: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """(dialogue_id, prop_id, turn, at) to a row per earlier proposition with its block, as turns arrive.

    ``at`` is the time of a turn; ``delay`` is how far the watermark stays
    behind, ``idle`` how long a dialogue is kept after its last turn.
    """
    spark = turns.sparkSession
    idle_ms = spark.range(1).selectExpr(f"cast(unix_millis(timestamp'1970-01-01 00:00:00' + interval {idle}) - unix_millis(timestamp'1970-01-01 00:00:00') as bigint)").head()[0]
    return (
        turns.withWatermark("at", delay)
        .groupBy("dialogue_id")
        .transformWithStateInPandas(statefulProcessor=Blocks(block_size, idle_ms), outputStructType=OUTPUT, outputMode="Append", timeMode="EventTime")
    )

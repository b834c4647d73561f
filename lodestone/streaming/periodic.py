"""Work that comes due: a key's notices are told of at most once an interval.

The state of a key is what waits and when it was last told of, and a timer stands
for the next time. Both are in the stream's checkpoint, so a stream that was
stopped goes on where it was: what came due meanwhile is told when it is back.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lodestone.sources.scratch import ship

OUT = "key string, at timestamp, notices long, note string"


class Periodic(StatefulProcessor):
    """The first notice of a key is told at once; later ones wait until an interval
    has passed since, and are then told together, with the note of the last."""

    def __init__(self, seconds: float):
        self.interval = int(1000 * seconds)

    def init(self, handle) -> None:
        self.handle = handle
        self.waiting = handle.getValueState("waiting", "notices long, note string")
        self.told = handle.getValueState("told", "at long")

    def _tell(self, key, now: int) -> pd.DataFrame:
        notices, note = self.waiting.get()
        self.waiting.clear()
        self.told.update((now,))
        return pd.DataFrame({"key": [key[0]], "at": [pd.Timestamp(now, unit="ms")], "notices": [notices], "note": [note]})

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("ts", kind="stable")
        now, before = timerValues.getCurrentProcessingTimeInMs(), self.waiting.exists()
        notices = (self.waiting.get()[0] if before else 0) + len(pdf)
        self.waiting.update((notices, pdf["note"].iloc[-1]))
        if not self.told.exists() or now - self.told.get()[0] >= self.interval:
            yield self._tell(key, now)
        elif not before:
            self.handle.registerTimer(self.told.get()[0] + self.interval)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.waiting.exists():  # else the notices were told when others came
            yield self._tell(key, timerValues.getCurrentProcessingTimeInMs())

    def close(self) -> None:
        pass


def due(notices: DataFrame, seconds: float) -> DataFrame:
    """key, at, notices and note of what comes due, of a stream (key, ts, note). A
    key's commits that wait for a sync, or its changes that wait for a summary in
    the memory log, are such notices. The state store must be able to hold timers
    (RocksDB)."""
    ship(notices.sparkSession)
    rows = notices.select(F.col("key").cast("string").alias("key"), "ts", F.col("note").cast("string").alias("note"))
    return rows.groupBy("key").transformWithStateInPandas(Periodic(seconds), OUT, "Append", "ProcessingTime")


def act(stream: DataFrame, do: Callable[[DataFrame], None], checkpoint: str, every: str = "10 seconds") -> StreamingQuery:
    """Runs ``do`` on each batch of what is due; batches do not overlap."""

    def run(batch: DataFrame, batch_id: int) -> None:
        if not batch.isEmpty():
            do(batch)

    return stream.writeStream.outputMode("append").foreachBatch(run).option("checkpointLocation", checkpoint).trigger(processingTime=every).start()

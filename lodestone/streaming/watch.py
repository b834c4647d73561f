"""Streaming forms: file changes, debouncing, index maintenance, stream folding."""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery

from lodestone.sources.files import utf8
from lodestone.sources.store import BlockStore


def file_stream(spark: SparkSession, path: str, pattern: str = "*", most: int = 1000) -> DataFrame:
    """filepath, text, ts of files as they are created or modified."""
    d = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary")
    d = d.option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", most).load(path)
    return d.select(F.regexp_replace("path", "^file:/*", "/").alias("filepath"), utf8(F.col("content")).alias("text"), F.col("modificationTime").alias("ts"))


def debounce(events: DataFrame, gap: str = "500 milliseconds", late: str = "10 seconds", key: str = "filepath") -> DataFrame:
    """One row for each burst of a key's events: a gap ends it. Batch or stream."""
    d = events.withWatermark("ts", late) if events.isStreaming else events
    g = d.groupBy(F.session_window("ts", gap).alias("w"), key).agg(F.count("*").alias("events"), F.max("ts").alias("last_ts"))
    return g.select(key, F.col("w.start").alias("start"), "last_ts", "events")


class TtlCache(StatefulProcessor):
    """hit or miss of each request (key, ts, value); a miss is stored ttl seconds."""

    def __init__(self, ttl: float):
        self.ttl = ttl

    def init(self, handle) -> None:
        # an entry that has served its time, by the clock, twice over goes
        self.entry = handle.getValueState("entry", "value string, at double", max(1, int(2000 * self.ttl)))

    def handleInputRows(self, key, rows, timerValues):
        pdf = pd.concat(list(rows)).sort_values("ts", kind="stable")
        out, held = [], self.entry.get() if self.entry.exists() else None
        for ts, value in zip(pdf["ts"], pdf["value"], strict=True):
            now = ts.timestamp()
            hit = held is not None and now - held[1] <= self.ttl
            if not hit:
                held = (str(value), now)
            out.append((key[0], ts, hit, held[0]))
        self.entry.update(held)
        yield pd.DataFrame(out, columns=["key", "ts", "hit", "value"])

    def close(self) -> None:
        pass


def cached(requests: DataFrame, ttl: float) -> DataFrame:
    """A stream's requests through the cache, a key's state in one place."""
    return requests.groupBy("key").transformWithStateInPandas(TtlCache(ttl), "key string, ts timestamp, hit boolean, value string", "Append", "ProcessingTime")


def maintain(changes: DataFrame, store: BlockStore, parse: Callable[[DataFrame], DataFrame], checkpoint: str, every: str | None = None, project: str | None = None) -> StreamingQuery:
    """Keeps a store up to date with a stream of (filepath, text, change).

    Batches run one at a time, so no two syncs overlap; each replaces all blocks
    of the files it names, in one project. ``every`` throttles; without it the stream runs once.
    """

    def apply(batch: DataFrame, batch_id: int) -> None:
        if batch.isEmpty():
            return
        now = batch.groupBy("filepath").agg(F.max_by(F.struct("text", "change"), "ts").alias("x")).select("filepath", "x.text", "x.change").persist()
        new = parse(now.where("change <> 'deleted'").select("filepath", "text")).persist()  # files are read and parsed once a batch
        try:
            store.apply_changes(new, now.select("filepath", "change"), project)
        finally:
            new.unpersist()
            now.unpersist()

    q = changes.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)
    return (q.trigger(processingTime=every) if every else q.trigger(availableNow=True)).start()


def should_sync(last: Column, now: Column, behind: Column, interval: int = 60) -> Column:
    """Whether a sync is due: an interval has passed and commits wait."""
    return (behind > 0) & (last.isNull() | (F.unix_timestamp(now) - F.unix_timestamp(last) >= interval))


def freshness(behind: Column, quick: int = 1000, full: int = 10_000) -> Column:
    return F.when(behind >= full, "full").when(behind >= quick, "quick").otherwise("fresh")


def fold_stream(events: DataFrame) -> DataFrame:
    """The text of each content block (message_id, index) from its deltas
    (seq, kind, text), and the stop reason of its message."""
    d = events.where("kind = 'content_block_delta'").groupBy("message_id", "index").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "").alias("text"))
    stop = events.where("kind = 'message_delta'").groupBy("message_id").agg(F.max_by("text", "seq").alias("stop_reason"))
    return d.join(stop, "message_id", "left")

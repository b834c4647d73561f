"""Caches as keyed tables: expiry, eviction, replay and semantic lookup."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as X

from . import scan


def unexpired(entries: DataFrame, now: Column, ttl: int) -> DataFrame:
    """Entries (key, value, ts) not older than ttl seconds."""
    return entries.where(F.unix_micros(now.cast("timestamp")) - F.unix_micros(F.col("ts").cast("timestamp")) <= ttl * 1_000_000)


def evict(entries: DataFrame, most: int, key: list[str] | None = None) -> DataFrame:
    """The newest entries of each key group."""
    w = W.partitionBy(*(key or [])).orderBy(F.desc("ts"), "key") if key else None
    if w is None:  # a top-k, so no single task sorts all
        return entries.orderBy(F.desc("ts"), "key").limit(most)
    return entries.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def replay(requests: DataFrame, ttl: int) -> DataFrame:
    """hit of each request (key, ts, event_id) to a cache that each miss fills.

    An entry is written at a miss and lives ttl seconds from then, so a key's
    requests fold in order. They stream through a sorted partition with one
    value of state; no key's requests are collected.
    """

    def fold(batches):
        key, since = None, 0
        for pdf in batches:
            hits = []
            for k, t in zip(pdf["key"], pdf["t"], strict=True):
                hit = k == key and t - since <= ttl * 1_000_000
                if not hit:
                    key, since = k, t
                hits.append(hit)
            yield pdf.assign(hit=hits)[["key", "event_id", "hit"]]

    d = requests.select("key", F.unix_micros(F.col("ts").cast("timestamp")).alias("t"), F.col("event_id").cast("long").alias("event_id"))
    d = d.where("key IS NOT NULL").repartition("key").sortWithinPartitions("key", "t", "event_id")
    return d.mapInPandas(fold, "key string, event_id long, hit boolean")


def hit_rate(replayed: DataFrame) -> DataFrame:
    return replayed.groupBy("key").agg(F.count("*").alias("requests"), F.sum(F.col("hit").cast("long")).alias("hits"), F.round(F.avg(F.col("hit").cast("double")), 3).alias("hit_rate"))


def semantic_lookup(probes: DataFrame, entries: DataFrame, now: Column, least: float = 0.92) -> DataFrame:
    """value and kind of match of each probe (probe_id, query, vector) among
    entries (query, vector, value, expires_at).

    The same normalised query answers first; once it is expired it answers with
    nothing, without a semantic fallback. Otherwise the most similar unexpired
    entry does, if it is similar enough.
    """
    p = probes.withColumn("k", F.md5(X.normalised_query(F.col("query"))))
    e = entries.withColumn("k", F.md5(X.normalised_query(F.col("query"))))
    live = F.col("expires_at") > now
    exact = p.join(e.select("k", "value", live.alias("live")), "k").groupBy("probe_id").agg(F.max_by("value", F.struct("live", "value")).alias("value"), F.max("live").alias("live"))
    exact = exact.select("probe_id", F.when(F.col("live"), F.col("value")).alias("value"), F.when(F.col("live"), "exact").otherwise("expired").alias("match"))
    rest = p.join(exact, "probe_id", "left_anti").where(F.size("vector") > 0).select(F.col("probe_id").alias("query_id"), "vector")
    held = e.where(live & (F.size("vector") > 0)).select(F.col("value").alias("id"), "vector")
    near = scan.nearest_pairs(held, rest, 1, 6, larger_id=True).where(F.col("cos") >= least)
    best = near.groupBy(F.col("query_id").alias("probe_id")).agg(F.max_by("id", F.struct("cos", "id")).alias("value")).withColumn("match", F.lit("semantic"))
    found = exact.unionByName(best)
    return probes.select("probe_id").join(found, "probe_id", "left").select("probe_id", "value", F.coalesce("match", F.lit("miss")).alias("match"))

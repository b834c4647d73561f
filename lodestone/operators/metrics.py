"""Aggregates over event logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

BARS = "▁▂▃▄▅▆▇█"
COST_PER_MILLION = 0.14


def entries_at(events: DataFrame, key: str, value: str, places: dict[str, Column], accuracy: int = 10_000) -> DataFrame:
    """key, count and, by name, entries of each key's sorted values: ``places`` has
    the entry's number, from 0, made of column ``count``.

    A mergeable sketch brackets each entry within a few ranks in ``accuracy``; only
    values inside the brackets are sorted, and counts of the values below them
    make the ranks exact. No task sorts, or collects, a whole key.
    """
    d = events.where(F.col(value).isNotNull()).select(F.col(key), F.col(value).alias("v"))
    # the sketch in steps of a few ranks; an entry lies between the steps around it
    steps = accuracy // 20
    grid = F.array(*[F.lit(i / steps) for i in range(steps + 1)])
    base = d.groupBy(key).agg(F.count("*").alias("count"), F.min("v").alias("_min"), F.max("v").alias("_max"), F.percentile_approx("v", grid, accuracy).alias("_q"))
    few = F.col("count") <= accuracy  # a bracket would be narrower than a rank
    step = lambda at, way: F.greatest(F.lit(0), F.least(F.lit(steps), F.floor(at / F.col("count") * steps) + way)).cast("int")
    part = [F.struct(F.lit(n).alias("p"), F.when(few, F.col("_min")).otherwise(F.get("_q", step(at, -1))).alias("lo"), F.when(few, F.col("_max")).otherwise(F.get("_q", step(at, 2))).alias("hi"), at.alias("at")) for n, at in places.items()]
    brackets = base.select(F.col(key).alias("_k"), F.array(*part).alias("parts"))
    near = d.join(brackets, F.col(key).eqNullSafe(F.col("_k"))).select(key, "v", F.explode(F.filter("parts", lambda x: F.col("v") <= x["hi"])).alias("x"))
    counted = near.groupBy(key, "x.p", "x.at", F.when(F.col("v") >= F.col("x.lo"), F.col("v")).alias("v")).agg(F.count("*").alias("c"))
    upto = F.sum("c").over(W.partitionBy(key, "p").orderBy(F.asc_nulls_first("v")).rowsBetween(W.unboundedPreceding, 0))
    found = counted.withColumn("upto", upto).where("v IS NOT NULL AND upto > at")
    picks = found.groupBy(F.col(key).alias("_k")).agg(*[F.min(F.when(F.col("p") == n, F.col("v"))).alias(n) for n in places])
    return base.select(key, "count").join(picks, F.col(key).eqNullSafe(F.col("_k")), "left").drop("_k")


def percentile_place(p: int) -> Column:
    """int(p * (n - 1) / 100) of column ``count``: no interpolation."""
    return F.floor(F.lit(p) * (F.col("count") - 1) / 100)


def latency_summary(events: DataFrame, key: str, value: str = "value", accuracy: int = 10_000) -> DataFrame:
    """count, mean, min, max, p50, p95 and p99 of each key."""
    picks = entries_at(events, key, value, {f"p{p}": percentile_place(p) for p in (50, 95, 99)}, accuracy).drop("count").withColumnRenamed(key, "_key")
    base = events.where(F.col(value).isNotNull()).groupBy(key).agg(F.count("*").alias("count"), F.round(F.avg(value), 4).alias("mean"), F.min(value).alias("min"), F.max(value).alias("max"))
    return base.join(picks, F.col(key).eqNullSafe(F.col("_key")), "left").drop("_key")


def cold_and_warm(runs: DataFrame, key: str, query: str, order: list[str], value: str = "value", accuracy: int = 10_000) -> DataFrame:
    """key, phase, count, p50 and p95: a query's first run by ``order`` is cold, the
    later ones are warm. First runs come from one aggregate; no key is sorted."""
    d = runs.where(F.col(value).isNotNull()).withColumn("_o", F.struct(*order))
    first = d.groupBy(F.col(key).alias("_k"), F.col(query).alias("_q")).agg(F.min("_o").alias("_f"))
    d = d.join(first, F.col(key).eqNullSafe(F.col("_k")) & F.col(query).eqNullSafe(F.col("_q")))
    d = d.select(F.struct(F.col(key).alias("key"), F.when(F.col("_o") == F.col("_f"), "cold").otherwise("warm").alias("phase")).alias("part"), F.col(value).alias("value"))
    out = entries_at(d, "part", "value", {f"p{p}": percentile_place(p) for p in (50, 95)}, accuracy)
    return out.select(F.col("part.key").alias(key), "part.phase", "count", "p50", "p95")


def summary(events: DataFrame, recent: int = 50) -> DataFrame:
    """For each category of (category, ts, value, results, error): totals,
    averages, the average results of the last events, and the error rate."""
    last = F.row_number().over(W.partitionBy("category").orderBy(F.desc("ts"), F.desc("event_id"))) <= recent
    d = events.withColumn("_last", last)
    return d.groupBy("category").agg(
        F.count("*").alias("total"), F.round(F.avg("value"), 1).alias("avg_value"), F.round(F.avg(F.when(F.col("_last"), F.col("results"))), 1).alias("avg_results"),
        F.round(100 * F.avg(F.col("error").cast("double")), 1).alias("error_rate"), F.max("ts").alias("last_ts"),
    )


def keep_last(events: DataFrame, most: int, key: str = "category") -> DataFrame:
    """The last rows of each key by time."""
    w = W.partitionBy(key).orderBy(F.desc("ts"), F.desc("event_id"))
    return events.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def token_stats(history: DataFrame, now: Column, days: int = 90) -> DataFrame:
    """Totals and means over the last days of (ts, original, compressed, ms)."""
    d = history.where(F.col("ts") > now - F.expr(f"INTERVAL {days} DAYS"))
    saved = F.col("original") - F.col("compressed")
    pct = F.when(F.col("original") > 0, F.round(saved / F.col("original") * 100, 1)).otherwise(0.0)
    return d.agg(
        F.count("*").alias("total_requests"), F.coalesce(F.sum(saved), F.lit(0)).alias("total_saved_tokens"), F.coalesce(F.round(F.avg(pct), 1), F.lit(0.0)).alias("avg_savings_pct"),
        F.coalesce(F.sum("ms"), F.lit(0)).alias("total_time_ms"), F.coalesce(F.round(F.avg("ms"), 0), F.lit(0.0)).alias("avg_time_ms"), F.round(F.coalesce(F.sum(saved), F.lit(0)) / 1e6 * COST_PER_MILLION, 4).alias("saved_cost"),
    )


def retained(history: DataFrame, now: Column, days: int = 90, most: int = 10_000) -> DataFrame:
    """History within the last days, and of that the newest rows: a top-k, not a sort of all."""
    return history.where(F.col("ts") > now - F.expr(f"INTERVAL {days} DAYS")).orderBy(F.desc("ts"), F.desc("event_id")).limit(most)


def recent_activity(logs: list[DataFrame], most: int = 8) -> DataFrame:
    """The newest rows of several logs with one schema (ts, source, detail)."""
    every = logs[0]
    for log in logs[1:]:
        every = every.unionByName(log)
    return every.orderBy(F.desc("ts"), "source", "detail").limit(most)


def sparkline(points: DataFrame, key: str) -> DataFrame:
    """A bar for each point (key, pos, value), between the key's extremes."""
    w = W.partitionBy(key)
    low, high = F.min("value").over(w), F.max("value").over(w)
    place = F.when(high == low, F.lit(4)).otherwise(F.floor((F.col("value") - low) / (high - low) * 7))
    bar = F.substring(F.lit(BARS), place.cast("int") + 1, F.lit(1))
    return points.select(key, "pos", bar.alias("bar")).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "bar"))), lambda x: x["bar"]), "").alias("line"))


def token_reduction(queries: DataFrame, whole: str = "whole_tokens", used: str = "used_tokens") -> DataFrame:
    """Median and quartiles (lower order statistics) of the tokens used, and the
    reduction against the whole."""
    every = queries.withColumn("_all", F.lit(0))
    picks = entries_at(every, "_all", used, {n: F.floor(F.col("count") * p) for n, p in (("median", 0.5), ("p25", 0.25), ("p75", 0.75))})
    d = queries.agg(F.max(whole).alias("whole_tokens")).withColumn("_all", F.lit(0)).join(picks, "_all", "left")
    d = d.select(F.coalesce("count", F.lit(0)).alias("n"), "whole_tokens", "median", "p25", "p75")
    return d.withColumn("reduction_pct", F.when(F.col("whole_tokens") > 0, F.round(100 * (1 - F.col("median") / F.col("whole_tokens")), 1)).otherwise(0.0))


def index_latency(events: DataFrame, key: str, value: str = "value") -> DataFrame:
    """n, p50 and p95 of each key: the sorted values' entries at n div 2 and at
    int(0.95 n)."""
    out = entries_at(events, key, value, {"p50": F.floor(F.col("count") / 2), "p95": F.floor(F.col("count") * 95 / 100)})
    return out.withColumnRenamed("count", "n")


def tree_tokens(files: DataFrame, most: int = 50) -> DataFrame:
    """files, whole_tokens of all texts, and tree_tokens of the first paths, one a line."""
    tree = files.select("filepath").orderBy("filepath").limit(most).agg(F.array_join(F.array_sort(F.collect_list("filepath")), "\n").alias("tree"))
    tokens = lambda c: F.greatest(F.lit(1), F.floor(F.length(c) / 4)).cast("long")
    return files.agg(F.count("*").alias("files"), F.sum(tokens(F.coalesce("text", F.lit("")))).alias("whole_tokens")).crossJoin(tree.select(tokens("tree").alias("tree_tokens")))


def end_to_end(contexts: DataFrame, totals: DataFrame, agent_files: int = 10) -> DataFrame:
    """reduction of each context's tokens against the whole collection, and against
    an agent that reads ``agent_files`` files of mean size besides the tree."""
    d = contexts.crossJoin(totals)
    agent = F.col("tree_tokens") + agent_files * F.floor(F.col("whole_tokens") / F.greatest(F.col("files"), F.lit(1)))
    saved = lambda base: F.when(base > 0, F.round(100.0 * (1 - F.col("tokens") / base), 1)).otherwise(0.0)
    return d.select("query_id", "tokens", saved(F.col("whole_tokens")).alias("whole_pct"), saved(agent).alias("agent_pct"))

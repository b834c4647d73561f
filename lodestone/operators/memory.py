"""The memory log: append, rotate, compact, tail; and one line for a diff."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as X


def entry(log: DataFrame) -> DataFrame:
    """Entries (log_id, ts, note) as stamped lines."""
    note = F.trim(F.regexp_replace("note", "\n", " "))
    return log.withColumn("line", F.concat(F.lit("["), F.date_format("ts", "yyyy-MM-dd HH:mm"), F.lit("] "), note))


def rotate(log: DataFrame, most: int = 50, key: str = "log_id") -> DataFrame:
    """The newest entries of each log."""
    w = W.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    return log.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def compact(log: DataFrame, limit: int = 200, key: str = "log_id") -> DataFrame:
    """Logs of ``limit`` lines or more: the first ``limit`` become one line."""
    w = W.partitionBy(key)
    d = log.withColumn("_n", F.count("*").over(w)).withColumn("_r", F.row_number().over(w.orderBy("ts", "seq")))
    d = d.where((F.col("_n") < limit) | (F.col("_r") > limit) | (F.col("_r") == 1))
    note = F.concat(F.lit("[COMPACTED] Multiple historical changes ("), F.lit(str(limit)), F.lit(" entries compacted)."))
    return d.withColumn("note", F.when((F.col("_n") >= limit) & (F.col("_r") == 1), note).otherwise(F.col("note"))).drop("_n", "_r")


def tail(log: DataFrame, last: int = 10, budget: int | None = None, key: str = "log_id") -> DataFrame:
    """text of each log's newest lines that fit the budget; the newest alone is cut."""
    w = W.partitionBy(key).orderBy(F.desc("ts"), F.desc("seq"))
    d = log.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= last)
    if budget is not None:
        used = F.sum(F.length("line") + 1).over(w.rowsBetween(W.unboundedPreceding, 0)) - 1  # with line ends
        d = d.withColumn("_t", F.greatest(F.lit(1), F.floor(used / 4)))
        d = d.where((F.col("_t") <= budget) | (F.col("_r") == 1)).withColumn("line", F.when(F.col("_t") > budget, F.substring(F.col("line"), F.lit(1), F.lit(4 * budget))).otherwise(F.col("line")))
    return d.groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"), "line"))), lambda x: x["line"]), "\n").alias("text"))


def summarise(diffs: DataFrame) -> DataFrame:
    return diffs.withColumn("summary", X.diff_summary(F.col("diff")))

"""Readers and writers of logs and settings."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import os

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.metrics import keep_last, retained
from lodestone.operators import memory
from lodestone.plans.profiles import PROFILES, Settings

EVENT = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("category", T.StringType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("value", T.DoubleType()),
    T.StructField("results", T.IntegerType()), T.StructField("error", T.BooleanType()), T.StructField("detail", T.StringType()),
])
USAGE = T.StructType([
    T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("query", T.StringType()), T.StructField("original", T.LongType()),
    T.StructField("compressed", T.LongType()), T.StructField("strategies", T.ArrayType(T.StringType())), T.StructField("ms", T.LongType()),
])


class EventLog:
    """An append-only log; limits apply when it is read or compacted."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType = EVENT):
        self.spark, self.path, self.schema = spark, path, schema

    def append(self, rows: DataFrame) -> None:
        have = set(rows.columns)
        rows.select(*[(F.col(f.name) if f.name in have else F.lit(None)).cast(f.dataType).alias(f.name) for f in self.schema]).write.mode("append").parquet(self.path)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.path)

    def recent(self, most: int = 500) -> DataFrame:
        return keep_last(self.read(), most)

    def retained(self, now, days: int = 90, most: int = 10_000) -> DataFrame:
        return retained(self.read(), now, days, most)


class MemoryLog:
    """Notes of several logs (log_id, ts, note). An append rotates and compacts in
    the same step: it writes a new generation, which readers see whole or not at
    all, and drops the one before."""

    SCHEMA = "log_id string, ts timestamp_ntz, seq long, note string"

    def __init__(self, spark: SparkSession, path: str, most: int = 50, limit: int = 200):
        self.spark, self.path, self.most, self.limit = spark, path.rstrip("/"), most, limit
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def _generations(self) -> list[int]:
        if not self._fs.exists(self._path(self.path)):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(self._path(self.path))]
        return sorted(int(n[2:]) for n in names if n.startswith("g=") and self._fs.exists(self._path(f"{self.path}/{n}/_SUCCESS")))

    def read(self) -> DataFrame:
        held = self._generations()
        if not held:
            return self.spark.createDataFrame([], self.SCHEMA)
        return self.spark.read.schema(self.SCHEMA).parquet(f"{self.path}/g={held[-1]}")

    def append(self, notes: DataFrame) -> None:
        """notes(log_id, ts, note): then each log keeps its newest, long logs are compacted."""
        held, old = self._generations(), self.read()
        n = held[-1] if held else 0
        base = F.lit(n + 1).cast("long") * (1 << 40)  # what comes later stands later
        new = notes.select(F.col("log_id").cast("string").alias("log_id"), F.col("ts").cast("timestamp_ntz").alias("ts"), (base + F.pmod(F.xxhash64("note"), F.lit(1 << 40))).alias("seq"), "note")
        memory.compact(memory.rotate(old.unionByName(new), self.most), self.limit).write.parquet(f"{self.path}/g={n + 1}")
        for g in held[:-1]:  # readers of the last one may still be at it
            self._fs.delete(self._path(f"{self.path}/g={g}"), True)

    def tail(self, last: int = 10, budget: int | None = None) -> DataFrame:
        """log_id and text of each log's newest lines."""
        return memory.tail(memory.entry(self.read()), last, budget)


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """Whole-document JSON files, by a given schema where there is one."""
    r = spark.read.option("multiLine", "true")
    return (r.schema(schema) if schema is not None else r).json(path)


def memory_lines(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a memory file: ts and note of its stamped lines, in order."""
    d = spark.read.text(path, wholetext=True).select(F.posexplode(F.split("value", "\n")).alias("seq", "line"))
    p = r"^\[(\d{4}-\d{2}-\d{2} \d{2}:\d{2})\] (.*)$"
    return d.where(F.col("line").rlike(p)).select("seq", F.to_timestamp_ntz(F.regexp_extract("line", p, 1), F.lit("yyyy-MM-dd HH:mm")).alias("ts"), F.regexp_extract("line", p, 2).alias("note"))


def load_settings(text: str) -> Settings:
    """Settings from JSON text; unknown names and profiles are errors, excludes add up."""
    given = json.loads(text or "{}")
    known = {f.name for f in dataclasses.fields(Settings)}
    if wrong := set(given) - known:
        raise ValueError(f"unknown settings: {sorted(wrong)}")
    if given.get("profile", "code") not in PROFILES:
        raise ValueError(f"unknown profile: {given['profile']}")
    s = Settings(**{k: v for k, v in given.items() if k != "exclude"})
    s.exclude = list(dict.fromkeys([*s.exclude, *given.get("exclude", [])]))
    return s


def dump_settings(settings: Settings) -> str:
    return json.dumps(dataclasses.asdict(settings), indent=2, sort_keys=True)


def evaluation_queries(spark: SparkSession, items: list[tuple[str, set[str]]]) -> tuple[DataFrame, DataFrame]:
    """(queries, gold) from pairs of a query and its relevant ids."""
    queries = spark.createDataFrame([(i, q) for i, (q, _) in enumerate(items)], "query_id long, query string")
    gold = spark.createDataFrame([(i, g) for i, (_, ids) in enumerate(items) for g in sorted(ids)], "query_id long, gold string")
    return queries, gold


def index_location(root: str, where: str = "auto", home: str | None = None) -> str:
    """The folder of a tree's index: within the tree, or in the user's cache
    under the tree's id. ``auto`` leaves the tree where it is a mount of another
    system (below /mnt)."""
    if where not in ("auto", "native", "in_project"):
        raise ValueError(f"unknown index location: {where}")
    root = os.path.realpath(root)
    if where == "native" or (where == "auto" and root.startswith("/mnt/")):
        return os.path.join(home or os.path.expanduser("~"), ".cache", "lodestone", hashlib.sha1(root.encode()).hexdigest()[:12])
    return os.path.join(root, ".lodestone")

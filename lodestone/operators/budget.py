"""Token budgets, chunking, planning and tree reduction."""

from __future__ import annotations

import itertools
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, LongType, StructType
from pyspark.sql.window import Window as W

from lodestone.sources.scratch import Tables, ship

TOOL_CAP, SESSION_WINDOW, SESSION_PCT = 8000, 120_000, 0.30
LOCAL_TOKENS, ONE_SHOT, CEILING_FACTOR, RESERVE, OVERLAP, PROMPT = 6000, 0.75, 4, 1024, 0.12, 64


def budget_prefix(ranked: DataFrame, budget: int, keys: list[str] | None = None) -> DataFrame:
    """Rows (rank, tokens) of each key up to the first that overflows the budget."""
    w = W.partitionBy(*(keys or ["query_id"])).orderBy("rank").rowsBetween(W.unboundedPreceding, 0)
    return ranked.withColumn("used", F.sum("tokens").over(w)).where(F.col("used") <= budget)


def session_charge(outputs: DataFrame, cap: int, per_tool: int = TOOL_CAP) -> DataFrame:
    """emitted tokens of each output (session, seq, tokens): whole while they fit,
    the first overflow cut to what is left, nothing after it."""
    d = outputs.withColumn("capped", F.least("tokens", F.lit(per_tool)))
    before = F.coalesce(F.sum("capped").over(W.partitionBy("session").orderBy("seq").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    return d.withColumn("emitted", F.greatest(F.lit(0), F.least(F.col("capped"), cap - before)))


def chunk_bounds(sized: DataFrame, local: int = LOCAL_TOKENS, reserve: int = RESERVE, overlap: float = OVERLAP) -> DataFrame:
    """Overlapping windows (chunk, start, end) over each row's tokens."""
    size = max(256, local - reserve - PROMPT)
    stride = max(1, size - int(size * overlap))
    last = F.greatest(F.lit(0), F.ceil((F.col("tokens") - size) / stride)).cast("int")
    d = sized.withColumn("chunk", F.explode(F.sequence(F.lit(0), last)))
    start = F.col("chunk").cast("long") * stride
    return d.withColumn("start", start).withColumn("end", F.least(start + size, F.col("tokens")))


def plan_work(work: DataFrame, has_model: bool = True, local: int = LOCAL_TOKENS, tool: int = TOOL_CAP) -> DataFrame:
    """work_class of each row (tokens, has_instruction)."""
    t = F.col("tokens")
    kind = F.when(F.lit(not has_model) | ~F.col("has_instruction"), "context_only").when(t <= ONE_SHOT * local, "local_one_shot").when(t <= CEILING_FACTOR * tool, "local_map_reduce").otherwise("defer_to_cloud")
    return work.withColumn("work_class", kind)


def greedy_batches(parts: DataFrame, most: int = LOCAL_TOKENS) -> DataFrame:
    """batch of each part (key, seq, tokens): parts in order, a new batch where
    the next would overflow. The running sum restarts, which no window does.

    Parts are dealt by ranges of (key, seq), so a key spreads over as many tasks as
    its parts need. Each part has a link to where the next batch begins if one
    begins at it, which prefix sums give; following the links numbers the batches.
    Of a key that reaches into further ranges, each range says what it makes of any
    number of tokens that the batch before it may already hold: at most ``most``
    cases. These are put together in order, and its parts numbered again.
    """
    tables, ordered = Tables(parts.sparkSession, "batches"), ["key", "seq", "tokens"]
    ship(parts.sparkSession)
    parts = parts.select("key", F.col("seq").cast("long").alias("seq"), F.coalesce(F.col("tokens"), F.lit(0)).cast("long").alias("tokens"))
    key = parts.schema["key"]
    found = StructType([key]).add("seq", "long").add("tokens", "long").add("batch", "long").add("part", "integer")
    for c in ("sums", "begun", "left"):
        found = found.add(c, ArrayType(LongType()))
    rows = parts.repartitionByRange(*ordered).sortWithinPartitions(*ordered).mapInArrow(_first_pass(most, to_arrow_schema(found)), found)
    rows = tables.keep(rows, "rows")
    out = ["key", "seq", "tokens", "batch"]
    edges = rows.where("sums IS NOT NULL")
    spread = edges.groupBy("key").agg(F.count("*").alias("n")).where("n > 1").select(F.col("key").alias("_key"))
    if spread.isEmpty():
        return rows.where("sums IS NULL").select(*out)
    spread = tables.keep(spread, "spread")
    same = F.col("key").eqNullSafe(F.col("_key"))
    entry = StructType([key]).add("part", "integer").add("used", "long").add("before", "long")
    chained = edges.join(spread, same, "left_semi").select("key", "part", "tokens", "sums", "begun", "left").repartition("key").sortWithinPartitions("key", "part")
    entries = tables.keep(chained.mapInArrow(_chain(most, to_arrow_schema(entry)), entry), "entries")
    whole = rows.where("sums IS NULL").join(spread, same, "left_anti").select(*out)
    again = rows.where("sums IS NULL").join(entries.withColumnsRenamed({"key": "_key", "part": "_part"}), same & (F.col("part") == F.col("_part"))).select(*ordered, "part", "used", "before")
    final = StructType([found[c] for c in out])
    again = again.repartition("key", "part").sortWithinPartitions("key", "part", "seq", "tokens").mapInArrow(_second_pass(most, to_arrow_schema(final)), final)
    return whole.unionByName(again)


def _changes(t: pa.Table, columns: list[str]) -> np.ndarray:
    """Whether a row differs from the one before it; nulls equal nulls."""
    n = t.num_rows
    new = np.ones(n, bool)
    if n:
        new[1:] = False
    for c in columns:
        code = t.column(c).combine_chunks().dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)
        new[1:] |= code[1:] != code[:-1]
    return new


class _Links:
    """Where the next batch begins, for a batch that begins at each row."""

    def __init__(self, tokens: np.ndarray, first: np.ndarray, most: int):
        n = len(tokens)
        self.sums = np.concatenate(([0], np.cumsum(tokens)))  # before each row
        begin = np.flatnonzero(first)
        self.ends = np.concatenate((begin[1:], [n]))[np.cumsum(first) - 1] if n else np.zeros(0, np.int64)
        full = np.searchsorted(self.sums, self.sums[:-1] + most, side="right") - 1  # the first row that overflows
        filled = np.where(tokens > 0, np.arange(n), n)
        filled = np.minimum.accumulate(filled[::-1])[::-1] if n else filled  # a batch without tokens takes any part
        self.next = np.minimum(np.maximum(full, np.minimum(filled, n) + 1), self.ends)

    def starts(self, at: int, end: int) -> np.ndarray:
        out, link = np.zeros(end - at, bool), self.next[at:end].tolist()
        i, n = 0, end - at
        while i < n:
            out[i] = True
            i = link[i] - at
        return out


def _whole(batches) -> pa.Table | None:
    held = [b for b in batches if b.num_rows]
    return pa.Table.from_batches(held).combine_chunks() if held else None


def _first_pass(most: int, schema: pa.Schema):
    """Each part's batch as if its key began in this range; for the first and the
    last key of the range also a row of what follows from tokens held before."""

    def run(batches):
        t = _whole(batches)
        if t is None:
            return
        number, n = TaskContext.get().partitionId(), t.num_rows
        tokens, first = t.column("tokens").to_numpy(), _changes(t, ["key"])
        links = _Links(tokens, first, most)
        count = np.cumsum(links.starts(0, n))
        begin = np.flatnonzero(first)
        batch = count - count[begin][np.cumsum(first) - 1]
        nothing = [pa.nulls(n, schema.field(c).type) for c in ("sums", "begun", "left")]
        yield from pa.Table.from_arrays([*(t.column(c) for c in ("key", "seq", "tokens")), pa.array(batch), pa.array(np.full(n, number, np.int32)), *nothing], schema=schema).to_batches(1 << 16)
        for b in sorted({int(begin[0]), int(begin[-1])}):
            e = int(links.ends[b])
            sums = links.sums[b + 1 : e + 1] - links.sums[b]
            reach = min(int(np.searchsorted(sums, most, side="left")) + 1, e - b)
            begun, left, link = [0] * (e - b), [0] * (e - b), (links.next[b:e] - b).tolist()
            for i in range(e - b - 1, -1, -1):  # batches that begin from row i on, and what the last one holds
                j = link[i]
                begun[i], left[i] = (1, int(links.sums[e] - links.sums[b + i])) if j >= e - b else (begun[j] + 1, left[j])
            row = [t.column("key").slice(b, 1).combine_chunks(), pa.array([0]), pa.array([int(sums[-1])]), pa.array([0]), pa.array([number], pa.int32()), *(pa.array([x], schema.field("sums").type) for x in (sums[:reach].tolist(), begun[:reach], left[:reach]))]
            yield pa.RecordBatch.from_arrays(row, schema=schema)

    return run


def _chain(most: int, schema: pa.Schema):
    """Rows of one key in order of its ranges -> what the last batch holds, and its
    number, where each range begins."""

    def run(batches):
        last, used, before = (), 0, 0
        for b in batches:
            out = []
            for key, part, total, sums, begun, left in zip(*(b.column(c).to_pylist() for c in ("key", "part", "tokens", "sums", "begun", "left")), strict=True):
                if (key,) != last:
                    last, used, before = (key,), 0, 0
                out.append((part, used, before))
                i = int(np.searchsorted(sums, most - used, side="right")) if used else 0
                if i >= len(sums):  # all of it still fits
                    used += total
                else:
                    before, used = before + begun[i] - (used == 0), left[i]
            yield pa.RecordBatch.from_arrays([b.column("key"), *(pa.array([o[i] for o in out], schema.field(i + 1).type) for i in range(3))], schema=schema)

    return run


def _second_pass(most: int, schema: pa.Schema):
    """The parts of keys that spread, with what their ranges began with."""

    def run(batches):
        t = _whole(batches)
        if t is None:
            return
        n, tokens, used, before = t.num_rows, *(t.column(c).to_numpy() for c in ("tokens", "used", "before"))
        first = _changes(t, ["key", "part"])
        links, batch = _Links(tokens, first, most), np.zeros(n, np.int64)
        for b in np.flatnonzero(first):
            e, u = int(links.ends[b]), int(used[b])
            at = b + int(np.searchsorted(links.sums[b + 1 : e + 1] - links.sums[b], most - u, side="right")) if u else b
            batch[b:e] = before[b]
            if at < e:
                batch[at:e] += np.cumsum(links.starts(at, e)) - (u == 0)
        yield from pa.Table.from_arrays([*(t.column(c) for c in ("key", "seq", "tokens")), pa.array(batch)], schema=schema).to_batches(1 << 16)

    return run


def tree_reduce(parts: DataFrame, reduce: Callable[[DataFrame], DataFrame], most: int = LOCAL_TOKENS) -> DataFrame:
    """Batches are reduced until each key has one part left; each round is written,
    so ``reduce`` sees each batch once. If a round leaves as many parts as it found,
    that is an error: it would go on for ever.

    ``reduce`` maps (key, batch, text) to (key, seq, tokens, text) rows.
    """
    tables, before = Tables(parts.sparkSession, "reduce"), None
    for i in itertools.count():
        batched = parts.join(greedy_batches(parts, most), ["key", "seq", "tokens"])
        joined = batched.groupBy("key", "batch").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "text"))), lambda x: x["text"]), "\n\n").alias("text"))
        parts = tables.keep(reduce(joined.withColumn("text", F.expr(f"substring(text, 1, {4 * most})"))), f"round-{i}")
        tables.only(f"round-{i}")
        n, keys = parts.agg(F.count("*"), F.countDistinct("key")).first()
        if n == keys:
            return parts
        if n == before:
            raise RuntimeError(f"reducing does not shrink {n} parts of {keys} keys")
        before = n

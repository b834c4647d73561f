"""Packing token sequences by cutting-stock column generation.

A text's ids are cut at every ``size`` ids, which fills whole sequences; what
remains of it is one piece. Piece lengths, rounded up to ``UNIT`` ids, make a
histogram of at most size / UNIT classes, whatever the number of documents. A
linear program over patterns (how many pieces of which classes share a
sequence) is solved by column generation: knapsack dynamic programming prices
new patterns until none lowers the number of sequences. The counts of those
patterns that fill a sequence, rounded down, are dealt to the pieces by their
rank within their class. The pieces that are left (rounding, and lengths that
fill no pattern) lie end to end in the order of class and rank, and are cut
where a sequence ends, at a multiple of ``GRAIN`` ids; checksums of both parts
at these places come with each piece, so nothing is encoded twice.

Ranks come from counts by class and hash bucket and a sort within each bucket,
so no class has to pass through one task.

Edge cases: a null or empty text is the end id alone; a very long text gives as
many pieces as it needs, all but its last filling a sequence; ties in length or
rank are settled by id, start and checksum; rows that repeat are packed each; rows without doc_id are packed too; an empty table gives no rows;
further columns are ignored.
"""

from __future__ import annotations

import base64
import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .storage import Scratch, bounded, tidy
from .tokens import tokenizer_path

UNIT = 8
#: Hash buckets of a class at least, and pieces of the table to a bucket.
BUCKETS, BUCKET_PIECES = 256, 1 << 16
GRAIN = 16
#: Share of a sequence that a pattern must fill.
FULL = 0.985
PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, heads array<long>, tails array<long>"
_encoders: dict = {}


def encoder(json_path: str, ranks_path: str | None):
    """text -> ids as the tokenizers library gives them for json_path.

    With ranks_path (the same vocabulary as ranks) a faster library gives the
    same ids; texts that hold the vocabulary's special string go to tokenizers.
    """
    key = (json_path, ranks_path)
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        exact = Tokenizer.from_file(json_path)
        exact.no_truncation()
        exact.no_padding()
        slow = lambda text: exact.encode(text, add_special_tokens=False).ids
        if ranks_path is None:
            _encoders[key] = slow
        else:
            import public_tokenizers
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            special = [t.content for t in exact.get_added_tokens_decoder().values()]
            _encoders[key] = lambda text: slow(text) if any(s in text for s in special) else fast.encode_ordinary(text)
    return _encoders[key]


def _cutter(size: int, end: int, full: int, grain: int, json_path: str | None, ranks_path: str | None, fast: bool):
    """Texts -> pieces. Pieces of ``full`` ids or more are never cut again."""

    def run(batches):
        json_file = json_path or tokenizer_path("byte_bpe_50k.json")
        ranks_file = ranks_path or (tokenizer_path("byte_bpe_50k.tiktoken") if fast and json_path is None else None)
        encode = encoder(json_file, ranks_file)
        for b in batches:
            out = []
            for doc, text in zip(b.column("doc_id").to_pylist(), b.column("text").to_pylist(), strict=True):
                ids = np.array([*encode(text or ""), end], dtype="<u4")
                for at in range(0, len(ids), size):
                    part = ids[at : at + size].tobytes()
                    cuts = range(4 * grain, len(part), 4 * grain) if len(part) < 4 * full else ()
                    heads, crc = [], 0
                    for c in cuts:
                        crc = zlib.crc32(part[c - 4 * grain : c], crc)
                        heads.append(crc)
                    out.append((doc, at, len(part) // 4, zlib.crc32(part), len(ids), heads, [zlib.crc32(part[c:]) for c in cuts]))
            kinds = [pa.int64()] * 5 + [pa.list_(pa.int64())] * 2
            yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)], names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "heads", "tails"])

    return run


def _price(values: np.ndarray, widths: np.ndarray, room: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of widths within room (unbounded knapsack)."""
    best, pick = np.zeros(room + 1), np.full(room + 1, -1)
    order = np.argsort(widths)
    w, v = widths[order], values[order]
    for c in range(1, room + 1):
        n = int(np.searchsorted(w, c, side="right"))
        best[c], pick[c] = best[c - 1], -2
        if n:
            gain = v[:n] + best[c - w[:n]]
            j = int(gain.argmax())
            if gain[j] > best[c] + 1e-12:
                best[c], pick[c] = gain[j], j
    counts, c = np.zeros(len(widths), np.int64), room
    while c > 0 and pick[c] != -1:
        if pick[c] == -2:
            c -= 1
        else:
            counts[order[pick[c]]] += 1
            c -= int(w[pick[c]])
    return float(best[room]), counts


def column_generation(widths: np.ndarray, demand: np.ndarray, room: int, gap: float = 5e-4, steps: int = 4000) -> list[tuple[np.ndarray, float]]:
    """Patterns and their (fractional) counts, within ``gap`` of the least number."""
    n = len(widths)
    per = room // widths
    basis = [np.where(np.arange(n) == i, per[i], 0) for i in range(n)]
    inverse = np.diag(1.0 / per)
    x = demand / per
    for _ in range(steps):
        dual = inverse.sum(axis=0)
        value, column = _price(np.maximum(dual, 0), widths, room)
        if value <= 1 + 1e-9 or x.sum() - float(dual @ demand) / value <= gap * x.sum():
            break
        move = inverse @ column
        ratio = np.full(n, np.inf)
        up = move > 1e-10
        ratio[up] = x[up] / move[up]
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        x = np.maximum(x - ratio[out] * move, 0)
        x[out] = ratio[out]
        row = inverse[out] / move[out]
        inverse -= np.outer(move, row)
        inverse[out] = row
        basis[out] = column
    return [(basis[i], float(x[i])) for i in range(n) if x[i] > 1e-9]


def plan(histogram: dict[int, int], room: int, full: float = FULL) -> list[tuple[dict[int, int], int]]:
    """(pattern: class -> pieces, times) that use at most what the histogram has,
    each pattern filling a sequence."""
    left = {c: n for c, n in histogram.items() if n > 0}
    out = [({c: 1}, left.pop(c)) for c in sorted(left) if c >= full * room]
    if not left:
        return out
    widths = np.array(sorted(left))
    demand = np.array([left[int(c)] for c in widths])
    for pattern, times in sorted(column_generation(widths, demand, room), key=lambda p: (-p[1], p[0].tolist())):
        used = np.flatnonzero(pattern)
        whole = int(min([np.floor(times + 1e-6), *(left[int(widths[i])] // pattern[i] for i in used)]))
        if whole > 0 and int(pattern @ widths) >= full * room:
            out.append(({int(widths[i]): int(pattern[i]) for i in used}, whole))
            for i in used:
                left[int(widths[i])] -= whole * int(pattern[i])
    return out


def pack(spark: SparkSession, docs: DataFrame, size: int = 2048, end: int = 1, json_path: str | None = None, ranks_path: str | None = None, fast: bool = True) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset of each
    piece of docs(doc_id, text)."""
    bounded(spark)
    scratch = Scratch(spark, "pack")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    unit = max(1, min(UNIT, size // 32))
    room, grain = size // unit, max(1, min(GRAIN, size // 64))
    whole = math.ceil(FULL * room)  # a piece of this class fills a sequence
    pieces = rows.mapInArrow(tidy(_cutter(size, end, (whole - 1) * unit + 1, grain, json_path, ranks_path, fast)), PIECES)
    pieces = pieces.withColumn("c", F.least(F.ceil(F.col("length") / unit).cast("int"), F.lit(room)))
    pieces = scratch.keep(pieces, "pieces")
    buckets = max(BUCKETS, pieces.count() // BUCKET_PIECES)  # the more pieces, the more tasks rank them
    pieces = pieces.withColumn("b", F.pmod(F.xxhash64("doc_id", "start", "ids_crc32"), F.lit(buckets)).cast("int"))
    counts = scratch.keep(pieces.groupBy("c", "b").agg(F.count("*").alias("n")), "counts")
    histogram = {r[0]: r[1] for r in counts.groupBy("c").agg(F.sum("n")).collect()}  # at most room rows
    slots, sequences, taken = [], 0, Counter()
    for pattern, times in plan(histogram, room):
        for c, per in pattern.items():
            slots.append((c, taken[c], taken[c] + per * times, per, sequences))
            taken[c] += per * times
        sequences += times
    up_to = W.unboundedPreceding, -1
    before = F.coalesce(F.sum("n").over(W.partitionBy("c").orderBy("b").rowsBetween(*up_to)), F.lit(0))
    # for each class: the rank from which its pieces are left over
    limits = F.broadcast(spark.createDataFrame([(c, taken[c]) for c in histogram] or [(0, 0)], "lc int, taken long"))
    starts = counts.select(F.col("c").alias("c2"), F.col("b").alias("b2"), before.alias("before")).join(limits, F.col("c2") == F.col("lc"))
    rank = F.row_number().over(W.partitionBy("c", "b").orderBy("doc_id", "start", "ids_crc32")) - 1
    ranked = pieces.withColumn("r", rank).join(starts, (F.col("c") == F.col("c2")) & (F.col("b") == F.col("b2"))).withColumn("r", F.col("r") + F.col("before"))
    ranked = scratch.keep(ranked.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "c", "b", "r", (F.col("r") >= F.col("taken")).alias("rest"), F.when(F.col("r") >= F.col("taken"), F.col("heads")).alias("heads"), F.when(F.col("r") >= F.col("taken"), F.col("tails")).alias("tails")), "ranked")
    # the plan's rows: at most room patterns of at most room classes each
    table = F.broadcast(spark.createDataFrame(slots or [(0, 0, 0, 1, 0)], "sc int, lo long, hi long, per long, base long"))
    dealt = ranked.where("NOT rest").join(table, (F.col("c") == F.col("sc")) & (F.col("r") >= F.col("lo")) & (F.col("r") < F.col("hi")))
    columns = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "o"]
    dealt = dealt.withColumn("sequence_id", F.col("base") + F.floor((F.col("r") - F.col("lo")) / F.col("per"))).withColumn("o", -F.col("length")).select(*columns)
    # what is left, end to end: places by class, bucket and rank
    rest = ranked.where("rest")
    sums = rest.groupBy("c", "b").agg(F.sum("length").alias("len"))
    by_class = sums.groupBy("c").agg(F.sum("len").alias("len")).select(F.col("c").alias("c4"), F.coalesce(F.sum("len").over(W.orderBy("c").rowsBetween(*up_to)), F.lit(0)).alias("at_c"))  # at most room rows
    by_bucket = sums.select(F.col("c").alias("c3"), F.col("b").alias("b3"), F.coalesce(F.sum("len").over(W.partitionBy("c").orderBy("b").rowsBetween(*up_to)), F.lit(0)).alias("at_b"))
    within = F.coalesce(F.sum("length").over(W.partitionBy("c", "b").orderBy("r").rowsBetween(*up_to)), F.lit(0))
    rest = rest.withColumn("at", within).join(by_bucket, (F.col("c") == F.col("c3")) & (F.col("b") == F.col("b3"))).join(by_class, F.col("c") == F.col("c4")).withColumn("at", F.col("at") + F.col("at_b") + F.col("at_c"))
    step = size - grain  # a part may be up to a grain longer than its share
    own = F.floor(F.col("at") / step)
    cut = F.when(F.col("at") + F.col("length") > (own + 1) * step, F.floor(((own + 1) * step - F.col("at")) / grain) * grain)
    rest = rest.withColumn("s", own).withColumn("cut", cut)
    part = lambda start, length, crc, s, o: F.struct(start.alias("start"), length.cast("long").alias("length"), crc.alias("ids_crc32"), s.cast("long").alias("s"), o.cast("long").alias("o"))
    n = (F.col("cut") / grain).cast("int")
    uncut = F.array(part(F.col("start"), F.col("length"), F.col("ids_crc32"), F.col("s"), F.col("at")))
    second = part(F.col("start") + F.col("cut"), F.col("length") - F.col("cut"), F.get("tails", n - 1), F.col("s") + 1, F.lit(-1))
    parts = F.when(F.col("cut").isNull(), uncut).when(n == 0, F.array(part(F.col("start"), F.col("length"), F.col("ids_crc32"), F.col("s") + 1, F.lit(-1)))).otherwise(F.array(part(F.col("start"), F.col("cut"), F.get("heads", n - 1), F.col("s"), F.col("at")), second))
    rest = rest.select("doc_id", "doc_tokens", F.explode(parts).alias("p")).select("doc_id", "p.start", "p.length", "p.ids_crc32", "doc_tokens", (F.col("p.s") + sequences).alias("sequence_id"), F.col("p.o").alias("o"))
    place = F.coalesce(F.sum("length").over(W.partitionBy("sequence_id").orderBy("o", "doc_id", "start", "ids_crc32").rowsBetween(*up_to)), F.lit(0))
    out = dealt.unionByName(rest.select(*columns)).withColumn("offset", place)
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", F.col("sequence_id").cast("long").alias("sequence_id"), F.col("offset").cast("long").alias("offset"))

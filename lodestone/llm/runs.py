"""Periodic runs of words by Main-Lorentz divide and conquer.

A run is a maximal stretch of words with smallest period q (words q apart are
identical) that is at least ``times`` periods and ``least`` words long.

Words are interned to ids, the texts of a slice laid end to end, and cut in
halves again and again. A run lies whole in some node of that division and
crosses its middle m; since it holds four periods or more, one side of the middle
holds two, so the Z-function of that side at the middle, the length of what
words m.. and m + q.. have in common (for the left side, read backwards from
m - 1 and m - 1 - q), is at least q. Each such q is extended both ways to the
whole run; intervals found more than once are kept once, with the smallest period.

All nodes of a level are worked on at once in numpy. Z-values are found in two
steps: the first few words are compared, which ends nearly every q of an ordinary
text, and what is left is measured by halving over two polynomial prefix hashes,
so a text that is one single run costs n log n steps, not n * n. Each run that is
found is compared word by word before it counts.

No row leaves its task and nothing is shuffled; a task holds one slice of texts
(a longer text is a slice of its own), so hot keys and repeated rows do not matter.

Edge cases: a null or wordless text has no words and no runs; a text of any
length is one sequence; matches never cross texts; rows that repeat are judged
alike; an empty table gives no rows; further columns are ignored or, if named in
``carry``, returned.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import bounded, tidy

TIMES, LEAST = 4, 6
#: Bytes of texts that are worked on at once.
SLICE = 1 << 20
#: Words that are compared one by one before hashes are.
FEW = 4
#: Words of a level that are compared at once.
CELLS = 1 << 20
PRIMES = ((2147483647, 1103515245), (2147483629, 69069069))


class Words:
    """Ids of words of texts laid end to end, with common prefixes and suffixes."""

    def __init__(self, ids: np.ndarray, begin: np.ndarray):
        self.ids, n = ids, len(ids)
        own = np.repeat(np.arange(len(begin) - 1), np.diff(begin))
        self.text, self.first, self.end = own, begin[own], begin[own + 1]
        self.sums, self.powers = [], []
        for prime, base in PRIMES:
            power = np.ones(n + 1, np.uint64)
            have, step = 1, base
            while have <= n:  # base ** i by doubling
                more = min(have, n + 1 - have)
                power[have : have + more] = power[:more] * np.uint64(step) % np.uint64(prime)
                have, step = have + more, step * step % prime
            total = np.zeros(n + 1, np.uint64)
            np.cumsum((ids.astype(np.uint64) + np.uint64(1)) * power[:n] % np.uint64(prime), out=total[1:])
            self.sums.append(total % np.uint64(prime))
            self.powers.append(power)

    def same(self, i: np.ndarray, q: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the words of i.. and i + q.. agree for ``size`` words, by hash."""
        out = np.ones(len(i), bool)
        j = i + q
        for (prime, _), total, power in zip(PRIMES, self.sums, self.powers, strict=True):
            p = np.uint64(prime)
            a, b = (total[i + size] + p - total[i]) % p, (total[j + size] + p - total[j]) % p
            out &= a * power[q] % p == b
        return out

    def ahead(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words from i on and from i + q on agree, within the text."""
        return self._longest(i, q, self.end[i] - i - q, lambda have, step: i + have)

    def behind(self, i: np.ndarray, q: np.ndarray) -> np.ndarray:
        """How many words before i and before i + q agree, within the text."""
        return self._longest(i, q, i - self.first[i], lambda have, step: i - have - step)

    def _longest(self, i, q, most, at):
        have = np.zeros(len(i), np.int64)
        step = 1 << max(int(most.max(initial=0)).bit_length() - 1, 0)
        while step:
            fits = np.flatnonzero(have + step <= most)
            ok = fits[self.same(at(have, step)[fits], q[fits], np.full(len(fits), step))]
            have[ok] += step
            step >>= 1
        return have

    def crossing(self, half: int, most: int):
        """(x, q) of a level whose Z-value at the middle may reach q: x is where
        the first of two equal stretches begins or, read backwards, ends."""
        n, wide = len(self.ids), min(half // 2, most)
        nodes = -(-n // (2 * half))
        grid = np.full(nodes * 2 * half, -1, np.int64)
        grid[:n] = self.ids
        grid = grid.reshape(nodes, 2 * half)
        rest = np.arange(nodes) * 2 * half + half < n
        rows = max(1, CELLS // max(wide, 1))
        for lo in range(0, nodes, rows):
            some = grid[lo : lo + rows]
            middle = (np.arange(lo, lo + len(some)) * 2 * half + half)[:, None]
            for right in (True, False):
                if right:
                    equal = some[:, half + 1 : half + 1 + wide] == some[:, half : half + 1]
                else:
                    equal = some[:, half - 1 - wide : half - 1][:, ::-1] == some[:, half - 1 : half]
                node, q = np.nonzero(equal & rest[lo : lo + rows, None])
                q += 1
                m = middle[node, 0]
                # a stretch of q words that begins at m, or ends before it, and its neighbour lie in one text
                x = m if right else m - q
                first, last = (m, m + 2 * q) if right else (m - 2 * q, m)
                keep = (first >= 0) & (last <= n)
                x, q, first, last = x[keep], q[keep], first[keep], last[keep]
                keep = self.text[first] == self.text[last - 1]
                x, q, first = x[keep], q[keep], first[keep]
                for t in range(1, FEW):
                    at = first + np.minimum(t, q - 1) if right else first + q - 1 - np.minimum(t, q - 1)
                    keep = self.ids[at] == self.ids[at + q]
                    x, q, first = x[keep], q[keep], first[keep]
                if len(x):
                    yield right, x, q


def find_runs(ids: np.ndarray, begin: np.ndarray, times: int = TIMES, least: int = LEAST) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start (in ``ids``), length and smallest period of the runs of texts laid end
    to end (text t: ids[begin[t]:begin[t + 1]]), ordered by start, then period."""
    if times < 4:
        raise ValueError("a run of fewer than four periods need not hold two on one side of the middle")
    none = np.zeros(0, np.int64)
    longest = int(np.diff(begin).max(initial=0))
    if longest < max(least, times):
        return none, none, none
    words = Words(ids, begin)
    found, half = [], 4
    while half < len(ids):
        for right, x, q in words.crossing(half, longest // times):
            # on the right x is the middle and what follows counts, on the left x + q is the middle and what lies before
            keep = (words.ahead(x, q) if right else words.behind(x, q)) >= q
            x, q = x[keep], q[keep]
            start, stop = x - words.behind(x, q), x + q + words.ahead(x, q)
            keep = stop - start >= np.maximum(least, times * q)
            found.append(np.unique(np.stack([start[keep], stop[keep], q[keep]], axis=1), axis=0))
        half *= 2
    if not found:
        return none, none, none
    rows = np.unique(np.concatenate(found), axis=0)  # by start, stop, period
    rows = rows[np.concatenate(([True], (rows[1:, :2] != rows[:-1, :2]).any(1)))] if len(rows) else rows
    for start, stop, q in rows:
        if not np.array_equal(ids[start : stop - q], ids[start + q : stop]):
            raise ArithmeticError("two different stretches of words share a hash")
    order = np.lexsort((rows[:, 2], rows[:, 0]))
    start, stop, q = rows[order].T if len(rows) else (none, none, none)
    return start, stop - start, q


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """Words of one text in ten (by the id's CRC-32) repeat periodically from some
    place on; the words of a row without an id stay."""
    if doc_id is None or not words:
        return words
    h, n = zlib.crc32(str(doc_id).encode()), len(words)
    if h % 10:
        return words
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * (-(-(n - a) // p)))[: n - a]


def _finder(before, times: int, least: int):
    def work(ids: list, texts: list[bytes]):
        known: dict[bytes, int] = {}
        split = [t.split() for t in texts]  # of bytes: at ASCII space only
        if before is not None:
            split = [before(i, w) for i, w in zip(ids, split, strict=True)]
        begin = np.concatenate(([0], np.cumsum([len(w) for w in split])))
        interned = np.fromiter((known.setdefault(w, len(known)) for ws in split for w in ws), np.int64, int(begin[-1]))
        start, length, period = find_runs(interned, begin, times, least)
        at = np.searchsorted(start, begin)
        runs, kept = [], []
        for t, ws in enumerate(split):
            own = [(int(s - begin[t]), int(n), int(q)) for s, n, q in zip(*(x[at[t] : at[t + 1]] for x in (start, length, period)), strict=True)]
            if own:
                edge = np.zeros(len(ws) + 1, np.int64)
                for s, n, q in own:
                    edge[s + q] += 1
                    edge[s + n] -= 1
                gone = np.cumsum(edge)[:-1] > 0
                ws = [w for w, g in zip(ws, gone.tolist(), strict=True) if not g]
            runs.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in own])
            kept.append(b" ".join(ws))
        return runs, kept

    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches):
        for b in batches:
            ids, texts = b.column("doc_id").to_pylist(), [t or b"" for t in b.column("text").cast(pa.large_binary()).to_pylist()]
            lo = 0
            while lo < len(texts):
                hi, size = lo + 1, len(texts[lo])
                while hi < len(texts) and size + len(texts[hi]) <= SLICE:
                    size, hi = size + len(texts[hi]), hi + 1
                runs, kept = work(ids[lo:hi], texts[lo:hi])
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(lo, hi - lo) for c in b.schema.names if c != "text"), pa.array(runs, kind), pa.array(kept, pa.binary()).cast(pa.string())], names=[*(c for c in b.schema.names if c != "text"), "runs", "collapsed"])
                lo = hi

    return run


def collapse_runs(spark: SparkSession, docs: DataFrame, before=None, times: int = TIMES, least: int = LEAST, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, ``carry``, runs and collapsed for each row of docs(doc_id, text).

    runs: array of (start, length, period) in words, ordered by start, then period.
    collapsed: the words joined by one space, without those that some run contains
    after its first period. ``before``: a function (doc_id, words) -> words that is
    applied first."""
    bounded(spark)
    if {"text", "runs", "collapsed"} & set(carry):
        raise ValueError("a carried column has the name of a result")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), *[c for c in carry if c != "doc_id"], F.col("text").cast("string").alias("text"))
    more = "".join(f", `{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:-1])
    return rows.mapInArrow(tidy(_finder(before, times, least)), f"doc_id long{more}, runs array<struct<start:bigint,length:bigint,period:bigint>>, collapsed string")


def digest(found: DataFrame) -> DataFrame:
    """doc_id, n_runs, the longest run, and hashes of all runs and of what is left."""
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    out = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("best"), F.sha2(F.array_join(lines, ""), 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    start, length, period = (-F.col("best.start")), F.col("best.length"), (-F.col("best.period"))
    return out.select("doc_id", "n_runs", start.alias("start"), length.alias("length"), period.alias("period"), F.expr("(1000 * best.length) div (-best.period)").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")

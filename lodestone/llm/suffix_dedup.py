"""Suffix-array deduplication of repeated byte strings.

A window is ``length`` consecutive bytes of one text. Winnowing gives every
window an anchor, the least hash among its ``GRAM``-byte strings, so equal
windows have equal anchors; the windows that share an anchor form a snippet of
consecutive window starts. Only anchors seen more than once matter:

* equal snippets repeat as a whole, which a count by snippet hash shows;
* different snippets with one anchor meet in one task, where a sparse suffix
  array over their window starts gives the longest-previous-factor array:
  previous and next smaller positions in suffix order give the earlier matches;
* the snippets of an anchor with more than ``CROWD`` different ones are cut
  again by anchors of twice the bytes, which fewer of them share;
* anchors with more than ``CROWD`` snippets even then are counted window by
  window, by hash, which no single task has to hold.

``keep="first"`` removes later copies only, by (doc_id, position);
``keep="none"`` removes every copy.

The same steps over words in place of bytes find passages of a number of words
that other texts hold too (``shared_passages``); there a window counts if the
windows that equal it in suffix order lie in more than one text.

Edge cases: a null or empty text loses nothing, nor does one under ``length``
bytes; a very long text is read in stretches that overlap; rows that repeat are
texts of their own and so copies of each other (rows without an order between
them, with keep="first", count as one; for passages, rows of one id and content
are one text); an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import Scratch, bounded, tidy

GRAM = 128
WORD_GRAM = 16
#: Different snippets of one anchor in one suffix array: under 1 MB of bytes.
CROWD = 1024
#: Symbols (bytes or words) of one suffix array.
BUNDLE = 1 << 18
#: Symbols of a text handled at once.
STRETCH = 1 << 22
#: Bytes of text handled at once; its arrays stay within a core's cache.
SLICE = 1 << 17

#: also: further places of an equal snippet in the same text, told for passages.
ANCHORS = "fp long, h1 long, h2 long, doc_id long, th long, lo long, hi long, occ long, also array<long>"
SNIPS = "fp long, doc_id long, th long, lo long, hi long, deep boolean, also array<long>, body binary"
PLACES = pa.list_(pa.int64())


def _digests(parts) -> tuple[np.ndarray, np.ndarray]:
    d = np.frombuffer(b"".join(map(xxhash.xxh3_128_digest, parts)), dtype=">i8").reshape(-1, 2).astype(np.int64)
    return d[:, 0].copy(), d[:, 1].copy()


def snippets(buf: np.ndarray, at: np.ndarray, length: int, gram: int):
    """row, anchor hash, first and last window start (in buf) of each snippet."""
    h = K.window_hash_pyramid(buf, gram)
    who = K.window_argmin(h, length - gram + 1)
    last = at[1:] - length
    ok = np.zeros(len(who) + 1, np.int64)
    use = last >= at[:-1]
    np.add.at(ok, at[:-1][use], 1)
    np.add.at(ok, last[use] + 1, -1)
    valid = np.flatnonzero(np.cumsum(ok[:-1]) > 0)
    if not len(valid):
        z = np.zeros(0, np.int64)
        return z, z, z, z
    row = np.searchsorted(at, valid, side="right") - 1
    cut = np.flatnonzero((np.diff(valid) != 1) | (np.diff(who[valid]) != 0) | (np.diff(row) != 0)) + 1
    first, end = np.concatenate(([0], cut)), np.concatenate((cut, [len(valid)])) - 1
    return row[first], h[who[valid[first]]].view(np.int64), valid[first], valid[end]


def _merge(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Union of the half-open intervals [lo, hi), touching ones joined."""
    if not len(lo):
        return lo, hi
    order = np.argsort(lo, kind="stable")
    lo, top = lo[order], np.maximum.accumulate(hi[order])
    cut = np.flatnonzero(lo[1:] > top[:-1]) + 1
    return lo[np.concatenate(([0], cut))], top[np.concatenate((cut, [len(lo)])) - 1]


def as_bytes(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The symbols of the texts of a slice, and where each text's begin: bytes."""
    return buf, at


def as_words(buf: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same for words, as 32 bits of their hashes."""
    starts, ends, row = K.word_spans(buf, at)
    return (K.word_hashes(buf, starts, ends, lower=False) >> np.uint64(32)).astype(np.uint32), np.searchsorted(row, np.arange(len(at)))


def _anchorer(length: int, gram: int, symbols=as_bytes, listed: bool = False):
    """Texts -> their snippets, one row for equal ones of a text. The places of
    the further ones are rows without an anchor, or listed with the first (``listed``)."""

    def run(batches):
        for b in batches:
            buf, at = K.text_buffer(b.column("text"))
            ids = b.column("doc_id").to_pylist()
            th = b.column("th").to_numpy(zero_copy_only=False)
            for lo, hi in K.slices(at, SLICE):
                all_, cuts = symbols(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                base, end, alone = 0, len(all_), hi - lo == 1
                while True:  # a long text comes in stretches that share length - 1 symbols
                    stop = min(end, base + STRETCH) if alone else end
                    own = all_[base:stop]
                    at_ = np.array([0, stop - base]) if alone else cuts
                    row, fp, a, z = snippets(own, at_, length, gram)
                    if len(row):
                        raw, wide = memoryview(own.tobytes()), own.itemsize
                        h1, h2 = _digests([raw[x:y] for x, y in zip((a * wide).tolist(), ((z + length) * wide).tolist(), strict=True)])
                        yield from told(row, fp, h1, h2, a - at_[row] + base, z - a, ids[lo:hi], th[lo:hi])
                    if stop >= end:
                        break
                    base = stop - length + 1

    def told(row, fp, h1, h2, a, more, ids, th):
        order = np.lexsort((a, h2, h1, row))
        row, fp, h1, h2, a, more = (x[order] for x in (row, fp, h1, h2, a, more))
        new = np.concatenate(([True], (row[1:] != row[:-1]) | (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])))
        first = np.flatnonzero(new)
        occ = np.diff(np.concatenate((first, [len(row)])))
        also = [None] * len(first)
        out = [(fp[first], h1[first], h2[first], row[first], a[first], a[first] + more[first], occ, np.zeros(len(first), bool))]
        if listed:
            for i in np.flatnonzero(occ > 1):
                also[i] = a[first[i] + 1 : first[i] + occ[i]].tolist()
        else:
            for r in np.unique(row[~new]):  # further copies in the same text: known to repeat
                own = ~new & (row == r)
                s, e = _merge(a[own], a[own] + more[own] + length)
                z = np.zeros(len(s), np.int64)
                out.append((z, z, z, np.full(len(s), r), s, e - length, z, np.ones(len(s), bool)))
        fp, h1, h2, row, s, e, occ, local = (np.concatenate(x) for x in zip(*out, strict=True))
        also += [None] * (len(fp) - len(also))
        yield pa.RecordBatch.from_arrays(
            [pa.array(fp, mask=local), pa.array(h1), pa.array(h2), pa.array([ids[i] for i in row], pa.int64()), pa.array(th[row]), pa.array(s), pa.array(e), pa.array(occ), pa.array(also, PLACES)],
            names=["fp", "h1", "h2", "doc_id", "th", "lo", "hi", "occ", "also"],
        )

    return run


def _cutter(length: int, gram: int, symbols=as_bytes):
    """Texts with the snippets asked of them -> the snippets' symbols; those of a
    crowd are cut again by longer anchors (deep)."""
    names = ("fp", "doc_id", "th", "lo", "hi", "deep", "also", "body")
    kinds = [pa.int64()] * 5 + [pa.bool_(), PLACES, pa.binary()]

    def run(batches):
        for b in batches:
            buf, at = K.text_buffer(b.column("text"))
            out, held = [], 0
            for i, (d, th, asked) in enumerate(zip(b.column("doc_id").to_pylist(), b.column("th").to_pylist(), b.column("asked").to_pylist(), strict=True)):
                text, _ = symbols(buf[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]))
                for q in asked:
                    own = text[q["lo"] : q["hi"] + length]
                    if q["crowd"]:
                        for fp, x, y in zip(*(v.tolist() for v in snippets(own, np.array([0, len(own)]), length, gram)[1:]), strict=True):
                            out.append((fp, d, th, q["lo"] + x, q["lo"] + y, True, [p + x for p in q["also"]] if q["also"] else None, own[x : y + length].tobytes()))
                    else:
                        out.append((q["fp"], d, th, q["lo"], q["hi"], False, q["also"], own.tobytes()))
                    held += 2 * own.nbytes
                    if held > 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names=list(names))
                        out, held = [], 0
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([o[j] for o in out], k) for j, k in enumerate(kinds)], names=list(names))

    return run


def _windows(length: int, wide: int = 1):
    """Snippets -> the hashes of their windows, of symbols of ``wide`` bytes."""

    def run(batches):
        for b in batches:
            for d, th, lo, also, body in zip(*(b.column(c).to_pylist() for c in ("doc_id", "th", "lo", "also", "body")), strict=True):
                n = len(body) // wide - length + 1
                h1, h2 = _digests([body[s * wide : (s + length) * wide] for s in range(n)])
                yield pa.RecordBatch.from_arrays([pa.array(h1), pa.array(h2), pa.array([d] * n, pa.int64()), pa.array([th] * n, pa.int64()), pa.array(range(lo, lo + n), pa.int64()), pa.array([[p + s for p in also] if also else None for s in range(n)], PLACES)], names=["h1", "h2", "doc_id", "th", "lo", "also"])

    return run


def rank_pyramid(buf: np.ndarray, length: int) -> dict[int, np.ndarray]:
    """Order-keeping ranks of the first 8 bytes of symbols, and of 2, 4, 8, ...
    times as many (up to length), from each place."""
    size = 8 // buf.itemsize
    pad = np.concatenate((buf, np.zeros(size, buf.dtype)))
    key = np.zeros(len(buf), np.uint64)
    for j in range(size):
        key = (key << np.uint64(8 * buf.itemsize)) | pad[j : j + len(buf)].astype(np.uint64)

    def ranks(key):
        order = np.argsort(key)
        s = key[order]
        out = np.empty(len(key), np.uint64)
        out[order] = np.cumsum(np.concatenate(([False], s[1:] != s[:-1]))).astype(np.uint64)
        return out

    found = {size: ranks(key)}
    while size * 2 <= length:
        r = found[size]
        after = np.zeros(len(r), np.uint64)
        after[: max(len(r) - size, 0)] = r[size:] + np.uint64(1)
        size *= 2
        found[size] = ranks((r << np.uint64(32)) | after)
    return found


def suffix_order(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, dict[int, np.ndarray]]:
    """The order of the suffixes at ``starts`` by their first ``length`` symbols
    (ties by place), a rank for each that equal ones share, and the pyramid."""
    pyramid = rank_pyramid(buf, length)
    top = max(pyramid)
    whole = (pyramid[top][starts] << np.uint64(32)) | pyramid[top][starts + (length - top)]
    return np.lexsort((starts, whole)), whole, pyramid


def _smaller(sa: np.ndarray, step: int) -> np.ndarray:
    """For each rank, the nearest rank before (step -1) or after (1) it whose
    suffix starts earlier in the text, or -1; by pointer jumping."""
    n = len(sa)
    v = np.concatenate((sa, [-1]))  # place n: nothing, smaller than all
    p = np.arange(n) + step
    p[0 if step < 0 else -1] = n
    p = np.concatenate((p, [n]))
    todo = np.flatnonzero(v[p[:n]] > v[:n])
    while len(todo):
        p[todo] = p[p[todo]]
        todo = todo[v[p[todo]] > v[todo]]
    return np.where(p[:n] == n, -1, p[:n])


def longest_previous_factors(buf: np.ndarray, starts: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """For the suffixes at ``starts`` (ascending, each with ``length`` symbols to
    follow): the longest match with an earlier one, and the longest with any
    other, both up to ``length`` (at least 8 bytes)."""
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    order, _, pyramid = suffix_order(buf, starts, length)
    top = max(pyramid)
    sa = starts[order]

    def lcp(x: np.ndarray, y: np.ndarray) -> np.ndarray:
        done, going = np.zeros(len(x), np.int64), np.ones(len(x), bool)
        for size in (top, *sorted(pyramid, reverse=True)):
            r = pyramid[size]
            i, j = np.minimum(x + done, len(r) - 1), np.minimum(y + done, len(r) - 1)
            hit = going & (done + size <= length) & (r[i] == r[j])
            done[hit] += size
        for _ in range(min(pyramid)):
            i, j = np.minimum(x + done, len(buf) - 1), np.minimum(y + done, len(buf) - 1)
            going &= (done < length) & (buf[i] == buf[j])
            done[going] += 1
        return done

    near = lcp(sa[1:], sa[:-1]) if len(sa) > 1 else np.zeros(0, np.int64)
    any_ = np.zeros(len(sa), np.int64)
    any_[1:] = near
    any_[:-1] = np.maximum(any_[:-1], near)
    early = np.zeros(len(sa), np.int64)
    for step in (-1, 1):
        p = _smaller(sa, step)
        has = p >= 0
        early[has] = np.maximum(early[has], lcp(sa[has], sa[p[has]]))
    lpf, other = np.empty(len(sa), np.int64), np.empty(len(sa), np.int64)
    lpf[order], other[order] = early, any_
    return lpf, other


def shared_windows(buf: np.ndarray, starts: np.ndarray, length: int, owner: np.ndarray) -> np.ndarray:
    """Whether the window at each of ``starts`` equals one of another owner:
    equal windows stand side by side in suffix order."""
    if not len(starts):
        return np.zeros(0, bool)
    order, whole, _ = suffix_order(buf, starts, length)
    own, key = owner[order], whole[order]
    new = np.flatnonzero(np.concatenate(([True], key[1:] != key[:-1])))
    mixed = np.minimum.reduceat(own, new) != np.maximum.reduceat(own, new)
    out = np.empty(len(starts), bool)
    out[order] = np.repeat(mixed, np.diff(np.concatenate((new, [len(key)]))))
    return out


def _matcher(length: int, keep: str, kind=np.uint8):
    """Snippets ordered by (fp, doc_id, lo) -> their repeated window runs."""

    def solve(rows):
        own = [np.frombuffer(r[-1], kind) for r in rows]
        size = np.array([len(x) for x in own])
        base = np.cumsum(size) - size
        count = size - length + 1
        which = np.repeat(np.arange(len(rows)), count)
        within = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        if keep == "across":
            number: dict = {}
            owner = np.array([number.setdefault(r[1:3], len(number)) for r in rows])
            hit = np.flatnonzero(shared_windows(np.concatenate(own), base[which] + within, length, owner[which]))
        else:
            lpf, other = longest_previous_factors(np.concatenate(own), base[which] + within, length)
            hit = np.flatnonzero((lpf if keep == "first" else other) >= length)
        cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(which[hit]) != 0)) + 1
        first, end = (np.concatenate(([0], cut)), np.concatenate((cut, [len(hit)])) - 1) if len(hit) else (cut, cut)
        for a, z in zip(hit[first].tolist(), hit[end].tolist(), strict=True):
            r = rows[which[a]]
            for place in (r[3], *(r[4] or ())):
                yield r[1], r[2], place + int(within[a]), place + int(within[z])

    wide = np.dtype(kind).itemsize

    def run(batches):
        held, size, last = [], 0, None

        def flush():
            got = list(solve(held))
            return pa.RecordBatch.from_arrays([pa.array([g[i] for g in got], pa.int64()) for i in range(4)], names=["doc_id", "th", "lo", "hi"])

        for b in batches:
            for row in zip(*(b.column(c).to_pylist() for c in ("fp", "doc_id", "th", "lo", "also", "body")), strict=True):
                if held and held[-1][:4] == row[:4]:  # of rows that repeat
                    continue
                if size >= BUNDLE and row[0] != last:
                    yield flush()
                    held, size = [], 0
                held.append(row)
                size, last = size + len(row[-1]) // wide, row[0]
        if held:
            yield flush()

    return run


SPANS = pa.list_(pa.struct([("lo", pa.int64()), ("hi", pa.int64())]))


def _spans(runs: list[dict] | None, length: int) -> tuple[np.ndarray, np.ndarray]:
    runs = runs or []
    return _merge(np.array([g["lo"] for g in runs], np.int64), np.array([g["hi"] for g in runs], np.int64) + length)


def _listed(lo: np.ndarray, hi: np.ndarray) -> list[dict]:
    return [{"lo": x, "hi": y} for x, y in zip(lo.tolist(), hi.tolist(), strict=True)]


def _remover(length: int, words: int):
    def run(batches):
        for b in batches:
            buf, at = K.text_buffer(b.column("text"))
            spans, kept, passages = [], [], []
            for i, gone in enumerate(b.column("gone").to_pylist()):
                own = buf[at[i] : at[i + 1]]
                lo, hi = _spans(gone, length)
                spans.append(_listed(lo, hi))
                mask = np.zeros(len(own) + 1, np.int8)
                mask[lo] += 1
                mask[hi] -= 1
                kept.append(own[np.cumsum(mask[:-1]) == 0].tobytes() if gone else own.tobytes())
            columns = [b.column("doc_id"), pa.array(np.diff(at)), pa.array(spans, SPANS), pa.array(kept, pa.binary())]
            if words:
                passages = [_listed(*_spans(x, words)) for x in b.column("shared").to_pylist()]
                columns.append(pa.array(passages, SPANS))
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_bytes", "spans", "kept", "passages"][: len(columns)])

    return run


def _texts(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text")).withColumn("th", F.xxhash64("text"))


def _same(a: str, b: str):
    return F.col(f"{a}.doc_id").eqNullSafe(F.col(f"{b}.doc_id")) & (F.col(f"{a}.th") == F.col(f"{b}.th"))


def _everywhere(found: DataFrame) -> DataFrame:
    """doc_id, th, lo, hi of each found run at its place and its further places."""
    places = F.explode(F.concat(F.array("lo"), F.coalesce("also", F.array().cast("array<long>"))))
    return found.select("doc_id", "th", places.alias("at"), (F.col("hi") - F.col("lo")).alias("more")).select("doc_id", "th", F.col("at").alias("lo"), (F.col("at") + F.col("more")).alias("hi"))


def _runs(scratch: Scratch, texts: DataFrame, length: int, gram: int, keep: str, words: bool) -> DataFrame:
    """doc_id, th, lo, hi: runs of window starts that repeat, kept as a table."""
    symbols, kind = (as_words, np.uint32) if words else (as_bytes, np.uint8)
    name = "words-" if words else "bytes-"
    made: list[str] = []

    def hold(frame: DataFrame, step: str) -> DataFrame:
        made.append(name + step)
        return scratch.keep(frame, name + step)

    place = F.struct("doc_id", "th", "lo", "hi")
    several = F.lit(True) if keep != "across" else F.min(F.struct("doc_id", "th")) != F.max(F.struct("doc_id", "th"))
    anchors = hold(texts.mapInArrow(tidy(_anchorer(length, gram, symbols, listed=keep == "across")), ANCHORS), "anchors")
    local = anchors.where("fp IS NULL").select("doc_id", "th", "lo", "hi")
    met = anchors.where("fp IS NOT NULL").groupBy("fp").agg(F.sum("occ").alias("c"), F.min("h1").alias("x"), F.max("h1").alias("y"), several.alias("s")).where("c > 1 AND s").select("fp", (F.col("x") != F.col("y")).alias("mixed"))
    cand = hold(anchors.where("fp IS NOT NULL").join(met, "fp"), "candidates")
    kinds = cand.groupBy("fp", "h1", "h2").agg(F.sum("occ").alias("cnt"), F.min(place).alias("rep"), F.first("mixed").alias("mixed"), several.alias("s"))
    kinds = hold(kinds, "kinds")
    whole = cand.join(kinds.where("cnt > 1 AND s").select("fp", "h1", "h2", "rep"), ["fp", "h1", "h2"])
    if keep == "first":
        whole = whole.where("NOT (rep <=> struct(doc_id, th, lo, hi))")
    whole = _everywhere(whole)
    asking_of = lambda which: kinds.where(which).select("fp", "rep.*", F.lit(None).cast("array<long>").alias("also"))
    asking = asking_of("mixed")
    if keep == "across":  # kinds of one text alone may be shared in part, at all of their places
        alone = kinds.where("mixed AND NOT s").select("fp", "h1", "h2")
        asking = asking_of("mixed AND s").unionByName(cand.join(alone, ["fp", "h1", "h2"]).select("fp", "doc_id", "th", "lo", "hi", "also"))
    sizes = kinds.where("mixed").groupBy("fp").agg(F.count("*").alias("n"))
    asked = asking.join(sizes, "fp").select("doc_id", "th", F.struct("lo", "hi", "fp", "also", (F.col("n") > CROWD).alias("crowd")).alias("q"))
    asked = asked.groupBy("doc_id", "th").agg(F.collect_list("q").alias("asked"))
    cut = texts.alias("t").join(asked.alias("a"), _same("t", "a")).select("t.doc_id", "t.th", "t.text", "a.asked").mapInArrow(tidy(_cutter(length, (length + gram) // 2, symbols)), SNIPS)
    snips = hold(cut, "snippets")
    order = ["fp", "doc_id", "lo"]
    crowds = hold(snips.where("deep").groupBy("fp").agg(F.count("*").alias("n")).where(F.col("n") > CROWD).select("fp"), "crowds")
    some = snips.join(crowds, "fp", "left_anti").repartition("fp").sortWithinPartitions(*order).select("fp", "doc_id", "th", "lo", "also", "body")
    some = some.mapInArrow(tidy(_matcher(length, keep, kind)), "doc_id long, th long, lo long, hi long")
    windows = snips.where("deep").join(crowds, "fp").select("doc_id", "th", "lo", "also", "body").distinct()
    windows = hold(windows.mapInArrow(tidy(_windows(length, np.dtype(kind).itemsize)), "h1 long, h2 long, doc_id long, th long, lo long, also array<long>"), "windows")
    twice = windows.groupBy("h1", "h2").agg(F.count("*").alias("c"), F.min(F.struct("doc_id", "th", "lo")).alias("rep"), several.alias("s")).where("c > 1 AND s").select("h1", "h2", "rep")
    many = windows.join(twice, ["h1", "h2"])
    if keep == "first":
        many = many.where("NOT (rep <=> struct(doc_id, th, lo))")
    many = _everywhere(many.withColumn("hi", F.col("lo")))
    runs = whole.union(some).union(many)
    out = scratch.keep(runs if keep == "across" else local.union(runs), name + "runs")
    for step in made:
        scratch.drop(step)
    return out


def remove_repeats(spark: SparkSession, docs: DataFrame, length: int = 400, keep: str = "first", passage_words: int = 0) -> DataFrame:
    """doc_id, n_bytes, spans (removed bytes [lo, hi)) and kept (the bytes left)
    for each row of docs(doc_id, text).

    With ``passage_words``, also passages: the runs of words [lo, hi) that lie in
    a passage of so many words which a text of another id or content holds too,
    compared word by word. They are told, not removed.
    """
    if keep not in ("first", "none") or length < 16 or not (passage_words == 0 or passage_words >= 8):
        raise ValueError("keep is 'first' or 'none'; length is 16 at least, passage_words 8")
    bounded(spark)
    scratch = Scratch(spark, "repeats")
    texts = _texts(docs)

    def by_text(runs: DataFrame, name: str) -> DataFrame:
        return runs.groupBy("doc_id", "th").agg(F.collect_list(F.struct("lo", "hi")).alias(name))

    gone = by_text(_runs(scratch, texts, length, min(GRAM, length // 2), keep, words=False), "gone")
    schema = "doc_id long, n_bytes long, spans array<struct<lo:long,hi:long>>, kept binary"
    if not passage_words:
        left = texts.alias("t").join(gone.alias("g"), _same("t", "g"), "left")
        return left.select("t.doc_id", "t.text", "g.gone").mapInArrow(tidy(_remover(length, 0)), schema)
    shared = by_text(_runs(scratch, texts, passage_words, min(WORD_GRAM, passage_words // 2), "across", words=True), "shared")
    found = gone.alias("g").join(shared.alias("p"), _same("g", "p"), "full")
    found = found.select(F.coalesce("g.doc_id", "p.doc_id").alias("doc_id"), F.coalesce("g.th", "p.th").alias("th"), "gone", "shared")
    left = texts.alias("t").join(found.alias("f"), _same("t", "f"), "left").select("t.doc_id", "t.text", "f.gone", "f.shared")
    return left.mapInArrow(tidy(_remover(length, passage_words)), schema + ", passages array<struct<lo:long,hi:long>>")

"""A quality score learnt from preference pairs (Bradley-Terry).

Features are computed from whole texts alone: shapes and repetition of the text,
and the shares of its words and word pairs in hash buckets. Labelled texts of quality 1 are
preferred to those of quality 0; the score's weights minimise the logistic loss
of feature differences over seeded pairs. The threshold is a quantile of the
scores of the labelled sample, and the score is mapped to 0..1 so that the
threshold lies at ``CUT``.

The sample is bounded by ``most_labels`` rows, those with the smallest hash of
their id; everything else covers all rows.

Edge cases: null and empty texts have all features 0 and get a score; very long
texts are read whole; of the texts of one labelled id one is learnt from; labels
without a text, and null labels, are not learnt from; a label that repeats
counts once; with labels of one kind only, or none, all scores are 0.5; rows
that repeat get equal scores; an empty table gives no rows; further columns are
ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import kernels as K
from .storage import bounded, tidy

CUT = 0.7
FEATURES = ["words", "unique", "repeat", "bigrams", "upper", "symbol", "bang", "digit", "mark", "nonascii", "length", "long", "short", "bare", "lines", "duplicate_words", "first_upper", "run"]


#: Hash buckets of words and of word pairs.
WORD_BUCKETS, PAIR_BUCKETS = 128, 64
WIDTH = len(FEATURES) + WORD_BUCKETS + PAIR_BUCKETS
#: Pairs whose differences are held at once while learning.
PAIRS_AT_ONCE = 20_000


def _class(chars: str) -> np.ndarray:
    t = np.zeros(256, np.float64)
    t[[ord(c) for c in chars]] = 1
    return t


_UPPER, _DIGIT = _class("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), _class("0123456789")
_SYMBOL, _BANG, _MARK, _LINE = _class("#*$%&|<>~^_=\\{}[]@"), _class("!?"), _class(".,;:"), _class("\n")
_LETTER = _class("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_HIGH = (np.arange(256) >= 128).astype(np.float64)


def text_features(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """(rows, features) of the texts of a slice."""
    rows = len(at) - 1
    out = np.zeros((rows, WIDTH))
    starts, ends, row = K.word_spans(buf, at)
    n = np.bincount(row, minlength=rows).astype(float)
    size = np.maximum(np.diff(at), 1)
    safe = np.maximum(n, 1)
    total = lambda table: np.diff(np.concatenate(([0.0], np.cumsum(table[buf])))[at])
    by_row = lambda x: np.bincount(row, weights=x, minlength=rows)
    out[:, 0] = np.log1p(n)
    if len(starts):
        h = K.word_hashes(buf, starts, ends)
        share = lambda r, h, n: np.sqrt(np.bincount(r * n + (h >> np.uint64(40)).astype(np.int64) % n, minlength=rows * n).reshape(rows, n) / safe[:, None])
        first = len(FEATURES)
        out[:, first : first + WORD_BUCKETS] = share(row, h, WORD_BUCKETS)
        order = np.lexsort((h, row))
        r, s = row[order], h[order]
        new = np.concatenate(([True], (r[1:] != r[:-1]) | (s[1:] != s[:-1])))
        kinds = np.bincount(r[new], minlength=rows)
        out[:, 1] = kinds / safe
        again = np.zeros(len(h))
        again[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
        out[:, 2] = by_row(again) / safe
        pairs = np.zeros(rows)
        if len(h) > 1:
            both = row[1:] == row[:-1]
            g = K.mix(h[:-1] * np.uint64(3) + h[1:])[both]
            pr = row[:-1][both]
            out[:, first + WORD_BUCKETS :] = share(pr, g, PAIR_BUCKETS)
            order = np.lexsort((g, pr))
            pr, g = pr[order], g[order]
            new = np.concatenate(([True], (pr[1:] != pr[:-1]) | (g[1:] != g[:-1]))) if len(g) else np.zeros(0, bool)
            pairs = np.bincount(pr[new], minlength=rows) / np.maximum(np.bincount(pr, minlength=rows), 1)
        out[:, 3] = np.where(n > 1, pairs, 1)
        width = (ends - starts).astype(float)
        out[:, 10] = by_row(width) / safe
        out[:, 11] = by_row(width > 18) / safe
        out[:, 12] = by_row(width < 2) / safe
        letters = np.concatenate(([0.0], np.cumsum(_LETTER[buf] + _HIGH[buf])))
        bare = (letters[ends] - letters[starts]) == 0
        out[:, 13] = by_row(bare) / safe
        out[:, 15] = np.log1p(n) * (1 - out[:, 1])
        out[:, 16] = by_row(_UPPER[buf[starts]]) / safe
        out[:, 17] = np.sqrt(out[:, 2])
    for i, table in ((4, _UPPER), (5, _SYMBOL), (6, _BANG), (7, _DIGIT), (8, _MARK), (9, _HIGH)):
        out[:, i] = np.sqrt(total(table) / size)
    out[:, 14] = np.log1p(total(_LINE)) / np.maximum(out[:, 0], 1)
    return out


def _featurer(batches):
    for b in batches:
        buf, at = K.text_buffer(b.column("text"))
        for lo, hi in K.slices(at):
            x = text_features(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
            yield pa.RecordBatch.from_arrays([b.column("quality").slice(lo, hi - lo), pa.array(list(x), pa.list_(pa.float64()))], names=["quality", "x"])


def fit(x: np.ndarray, y: np.ndarray, pairs: int = 200_000, ridge: float = 1e-3, seed: int = 5, steps: int = 30) -> dict:
    """Bradley-Terry weights by Newton's method, and the quantile threshold."""
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    z = (x - mean) / scale
    good, poor = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    rng = np.random.default_rng(seed)
    better, worse = good[rng.integers(len(good), size=pairs)], poor[rng.integers(len(poor), size=pairs)]
    w = np.zeros(x.shape[1])
    for _ in range(steps):
        grad, hess = ridge * w, ridge * np.eye(len(w))
        for at in range(0, pairs, PAIRS_AT_ONCE):
            d = z[better[at : at + PAIRS_AT_ONCE]] - z[worse[at : at + PAIRS_AT_ONCE]]
            p = 1 / (1 + np.exp(np.clip(d @ w, -30, 30)))  # of the pair told the wrong way
            grad -= p @ d / pairs
            hess += (d * (p * (1 - p))[:, None]).T @ d / pairs
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    s = z @ w
    levels = np.unique(np.quantile(s, np.linspace(0.001, 0.999, 999)))
    right = [((s >= t) == (y == 1)).mean() for t in levels]
    best = np.flatnonzero(np.array(right) >= max(right) - 1e-12)
    cut = float(levels[best].mean()) if len(best) else 0.0
    return {"mean": mean, "scale": scale, "w": w, "cut": cut, "slope": 4.0 / max(float(s.std()), 1e-9), "accuracy": float(max(right))}


def _scorer(model: dict | None):
    def run(batches):
        for b in batches:
            buf, at = K.text_buffer(b.column("text"))
            for lo, hi in K.slices(at):
                if model is None:
                    score = np.full(hi - lo, 0.5)
                else:
                    x = text_features(buf[at[lo] : at[hi]], at[lo : hi + 1] - at[lo])
                    # row by row, so that equal texts score alike wherever they stand
                    s = ((x - model["mean"]) / model["scale"] * model["w"]).sum(axis=1) - model["cut"]
                    score = 1 / (1 + np.exp(-np.clip(model["slope"] * s + np.log(CUT / (1 - CUT)), -30, 30)))
                yield pa.RecordBatch.from_arrays([b.column("doc_id").slice(lo, hi - lo), pa.array(score)], names=["doc_id", "score"])

    return run


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, most_labels: int = 20_000) -> dict | None:
    """The model of labels(doc_id, quality) over docs(doc_id, text)."""
    bounded(spark)
    labels = labels.where("doc_id IS NOT NULL AND quality IS NOT NULL").groupBy(F.col("doc_id").cast("long").alias("_id")).agg(F.max("quality").cast("int").alias("quality"))
    sample = labels.orderBy(F.xxhash64("_id"), "_id").limit(most_labels)
    texts = docs.select(F.col("doc_id").cast("long").alias("_id"), F.col("text").cast("string").alias("text"))
    # a label's text counts once, the least if ids repeat: at most most_labels rows come to the driver
    found = texts.join(F.broadcast(sample), "_id").groupBy("_id").agg(F.min("text").alias("text"), F.first("quality").alias("quality")).select("quality", "text").mapInArrow(tidy(_featurer), "quality int, x array<double>")
    rows = found.toArrow()
    y = rows.column("quality").to_numpy()
    if len({*y.tolist()} & {0, 1}) < 2:
        return None
    x = rows.column("x").combine_chunks().flatten().to_numpy().reshape(len(y), WIDTH)
    order = np.lexsort((*x.T[::-1], y))  # the same model whatever the order of rows
    return fit(x[order], y[order])


def score(spark: SparkSession, docs: DataFrame, model: dict | None) -> DataFrame:
    """doc_id and score of each row of docs(doc_id, text)."""
    bounded(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(tidy(_scorer(model)), "doc_id long, score double")


def held_out(doc_id: Column) -> Column:
    """The fold that is never learnt from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))

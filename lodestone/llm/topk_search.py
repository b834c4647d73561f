"""Exact top-k search by inner product, with a three-phase uniform threshold.

Vectors lie in blocks of bounded size, and each block scores bounded blocks of
queries. A score is the sum of ``LISTS`` partial scores, one for each stretch
of components.

1. Every block gathers, for each query and list, the k highest partial scores;
   what they are known to add up to at least gives lower bounds. The k-th best
   lower bound over all blocks is a cutoff that the k best must reach.
2. The cutoff goes back to all blocks. A vector reaches it only if one of its
   partial scores reaches cutoff / LISTS; such entries are sufficient, and those
   whose upper bound stays below the cutoff are dropped again.
3. The remaining entries' missing partial scores are resolved exactly.

Each block then tells its own k best, so a vector that is copied a thousand
times does not fill the answer's shuffle.

Edge cases: vectors that are null, or hold null or non-finite components, take
no part, neither do rows without an id; an empty vector scores 0 with all;
vectors of different lengths count as filled with zeros; an id that repeats
is a candidate each time, but never for its own query; a query that repeats is
answered once; ties go to the smaller id; scores beyond 64 bits are clipped; an
empty table or no other vector gives no rows; further columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .storage import Scratch, bounded

LISTS = 4
BLOCK_ROWS = 2048
QUERY_ROWS = 16384
CHUNK = 128


def _matrix(col) -> np.ndarray:
    """(rows, longest) whole numbers of a list column, filled with zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    size = pa.compute.list_value_length(col).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = pa.compute.list_flatten(col).to_numpy(zero_copy_only=False).astype(np.int64)
    wide = int(size.max(initial=0))
    if len(flat) == len(size) * wide:
        out = flat.reshape(len(size), wide)
    else:
        out = np.zeros((len(size), wide), np.int64)
        row = np.repeat(np.arange(len(size)), size)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)] = flat
    return out.astype(object) if len(flat) and (flat.max() >= 1 << 53 or flat.min() <= -(1 << 53)) else out


def _partials(q: np.ndarray, v: np.ndarray) -> list[np.ndarray]:
    """The lists' partial scores, (queries, vectors) each, exactly."""
    dim = max(q.shape[1], v.shape[1])
    q, v = (np.pad(x, ((0, 0), (0, dim - x.shape[1]))) for x in (q, v))
    most = int(np.abs(q).max(initial=0)) * int(np.abs(v).max(initial=0)) * max(dim, 1)
    kind = np.float64 if most < 1 << 52 else object
    edges = np.linspace(0, dim, LISTS + 1).astype(int)
    return [q[:, a:b].astype(kind) @ v[:, a:b].astype(kind).T for a, b in zip(edges[:-1], edges[1:], strict=True)]


def _best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest, ties to the smaller id."""
    if len(score) > 4 * k:
        cut = np.partition(score, len(score) - k)[len(score) - k]
        own = np.flatnonzero(score >= cut)
        return own[np.lexsort((ids[own], -score[own]))[:k]]
    return np.lexsort((ids, -score))[:k]


def _long(x) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, int(x)))


def _gather(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            v, ids = _matrix(left.column("v")), left.column("id").to_numpy()
            q, qid = _matrix(right.column("v")), right.column("id").to_numpy()
            for at in range(0, len(q), CHUNK):
                parts = _partials(q[at : at + CHUNK], v)
                for i, who in enumerate(qid[at : at + CHUNK]):
                    own = np.flatnonzero(ids != who)
                    if not len(own):
                        continue
                    rows = [p[i][own] for p in parts]
                    tops = [_best(r, ids[own], k) for r in rows]
                    seen = np.unique(np.concatenate(tops))
                    bound = np.zeros(len(seen), dtype=rows[0].dtype)
                    for r, t in zip(rows, tops, strict=True):
                        bound += np.where(np.isin(seen, t), r[seen], r.min())
                    for x in _best(bound, ids[own][seen], k):
                        out.append((int(who), _long(bound[x])))
        return pa.table({"query_id": pa.array([o[0] for o in out], pa.int64()), "bound": pa.array([o[1] for o in out], pa.int64())})

    return run


def _resolve(k: int):
    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            v, ids = _matrix(left.column("v")), left.column("id").to_numpy()
            q, qid, cuts = _matrix(right.column("v")), right.column("id").to_numpy(), right.column("cutoff").to_pylist()
            for at in range(0, len(q), CHUNK):
                parts = _partials(q[at : at + CHUNK], v)
                for i, who in enumerate(qid[at : at + CHUNK]):
                    cut = cuts[at + i]
                    rows = [p[i] for p in parts]
                    if cut is None:  # fewer than k others in all
                        own = np.flatnonzero(ids != who)
                    else:
                        share = cut / LISTS - (1e-6 + abs(cut) * 1e-12)
                        enough = [r >= share for r in rows]
                        own = np.flatnonzero(np.logical_or.reduce(enough) & (ids != who))
                        upper = sum(np.where(e[own], r[own], share) for e, r in zip(enough, rows, strict=True))
                        own = own[upper >= cut - (1e-3 + abs(cut) * 1e-9)]
                    score = sum(r[own] for r in rows)
                    for x in _best(score, ids[own], k):
                        if cut is None or score[x] >= cut:
                            out.append((int(who), int(ids[own[x]]), _long(score[x])))
        return pa.table({c: pa.array([o[i] for o in out], pa.int64()) for i, c in enumerate(("query_id", "vec_id", "score"))})

    return run


def top_k(spark: SparkSession, vectors: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """query_id, rank, vec_id, score: each query's k best of vectors.

    Both hold id long and v array<long>.
    """
    bounded(spark)
    scratch = Scratch(spark, "topk")
    vectors, queries = scratch.keep(vectors.where("id IS NOT NULL"), "vectors"), queries.where("id IS NOT NULL").dropDuplicates(["id"])
    queries = scratch.keep(queries, "queries")
    blocks = max(1, -(-vectors.count() // BLOCK_ROWS))
    groups = max(1, -(-queries.count() // QUERY_ROWS))
    deal = lambda d, n: F.pmod(F.xxhash64(d["id"]), F.lit(n))
    all_of = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    left = vectors.select("id", "v", deal(vectors, blocks).alias("cb"), all_of(groups).alias("qb"))

    def scored(q: DataFrame, f, schema: str) -> DataFrame:
        right = q.select("*", deal(q, groups).alias("qb"), all_of(blocks).alias("cb"))
        return left.groupBy("cb", "qb").cogroup(right.groupBy("cb", "qb")).applyInArrow(f, schema)

    bounds = scored(queries, _gather(k), "query_id long, bound long")
    nth = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("bound")))
    cutoff = scratch.keep(bounds.withColumn("n", nth).where(F.col("n") == k).select(F.col("query_id").alias("id"), F.col("bound").alias("cutoff")), "cutoff")
    found = scored(queries.join(cutoff, "id", "left"), _resolve(k), "query_id long, vec_id long, score long")
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(vector: Column, scale: int = 1024) -> Column:
    """floor(scale * x) of each component; null if one is null or not finite."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return F.when(~bad, F.transform(vector, lambda x: F.floor(x.cast("double") * scale).cast("long")))


#: The query's result in DuckDB's SQL.
SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: coalesce(p[1] * p[2], 0)))::BIGINT AS score
      FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank, vec_id, score FROM s)
SELECT * FROM r WHERE rank <= 10
"""

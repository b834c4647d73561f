"""An inverted file of vectors whose cells have bounds, and an exact search that skips cells.

Each vector goes to the centroid that it is nearest to, and there to a shell of
like angles to it. A query at angle q from a centroid is, by the triangle
inequality on the sphere, at least q - hi and at least lo - q from every vector of
a shell with angles lo..hi; that bounds the cosine. The shells of the highest
bounds are scored first and give a cutoff, and of the others only those are read
whose bound reaches it. Shells lie together in segments of bounded size, which are
read whole: a query goes to each segment once, however many shells it holds, and
brings its cutoff along. So the answer is that of a scan. How much is skipped
depends on the vectors: clustered ones allow much, random directions of many
components nearly nothing; ``search`` can say it.

Centroids are fitted on a bounded sample (``SAMPLE`` vectors of each table, in
order of a hash of their ids); every vector is indexed. Vectors that are null,
empty or of length zero have no cosine; they, and vectors of another dimension
than the query's, score 0.5, like in a scan.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import ArrayType, DoubleType, StructType
from pyspark.sql.window import Window as W

from lodestone.sources.scratch import Tables, discard, ship

from .scan import unit_rows

#: Vectors that centroids are fitted on, most cells of a dimension, shells of a half turn.
SAMPLE, MOST_CELLS, SHELLS = 4096, 1024, 64
#: Segments that a table is cut into, while they hold no fewer and no more vectors than these: a query goes to
#: each segment at most once, so what is moved grows with the queries, up to SEGMENTS * BLOCK_ROWS vectors.
SEGMENTS, LEAST_ROWS, BLOCK_ROWS = 32, 256, 65_536
#: Queries that meet a segment in one group, vectors that are scored first.
BLOCK_QUERIES, FIRST_ROWS = 65_536, 512
#: Components of a segment's vectors and of a group's queries, so wide vectors are fewer.
BLOCK_VALUES = 1 << 22
#: Scores that are computed at once.
CELLS = 1 << 20
#: More than rounding to four places and angles cost.
SLACK = 1e-4


def fit(vectors: np.ndarray, cells: int, rounds: int = 8) -> np.ndarray:
    """Unit centroids of unit vectors, from evenly dealt starts."""
    centre = vectors[np.linspace(0, len(vectors) - 1, cells).astype(int)].copy()
    for _ in range(rounds):
        own = (vectors @ centre.T).argmax(1)
        total = np.zeros_like(centre)
        np.add.at(total, own, vectors)
        size = np.linalg.norm(total, axis=1)
        centre[size > 0] = total[size > 0] / size[size > 0, None]
    return centre


def angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1, 1))


class Cells:
    """A stored index: rows/ (vectors by shell), shells/ (bounds), centres.json as a one-row table."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at, self.rows = spark, at, spark.read.parquet(f"{at}/rows")
        text = spark.read.parquet(f"{at}/centres").first()[0]
        self.centres = {int(d): np.array(c) for d, c in json.loads(text).items()}
        # one row for each shell, at most MOST_CELLS * SHELLS of each dimension
        self.shells = spark.read.parquet(f"{at}/shells").orderBy("dim", "cell", "shell").toPandas()

    @classmethod
    def build(cls, vectors: DataFrame, at: str) -> Cells:
        """Index vectors(id, vector[, filepath]) into the folder ``at``."""
        spark = vectors.sparkSession
        ship(spark)
        if "filepath" not in vectors.columns:
            vectors = vectors.withColumn("filepath", F.lit(None).cast("string"))
        vectors = vectors.select("id", "filepath", F.col("vector").cast("array<double>").alias("vector"))
        n = vectors.count()
        sample = [r[0] for r in vectors.where("size(vector) > 0").orderBy(F.xxhash64("id"), "id").limit(SAMPLE).select("vector").collect()]
        centres = {}
        for dim, (_, unit) in unit_rows(sample).items():
            centres[dim] = fit(unit, int(min(MOST_CELLS, len(unit), max(1, np.sqrt(n)))))
        schema = StructType([vectors.schema["id"], vectors.schema["filepath"]]).add("vector", ArrayType(DoubleType())).add("dim", "integer").add("cell", "integer").add("shell", "integer").add("angle", "double")
        vectors.mapInArrow(_assigner(centres, to_arrow_schema(schema)), schema).write.mode("overwrite").parquet(f"{at}/raw")
        raw = spark.read.schema(schema).parquet(f"{at}/raw")
        key = ["dim", "cell", "shell"]
        shells = raw.groupBy(*key).agg(F.count("*").alias("n"), F.min("angle").alias("lo"), F.max("angle").alias("hi")).orderBy(*key).toPandas()
        shells["segment"], shells["blocks"] = _segments(shells["dim"].to_numpy(), shells["n"].to_numpy())
        kinds = "dim int, cell int, shell int, n long, lo double, hi double, segment int, blocks int"
        spark.createDataFrame([tuple(r) for r in shells.astype(object).to_numpy().tolist()], kinds).coalesce(1).write.mode("overwrite").parquet(f"{at}/shells")
        place = (F.col("segment") + F.pmod(F.xxhash64("id"), "blocks")).cast("int").alias("segment")
        dealt = raw.join(spark.read.parquet(f"{at}/shells").select(*key, "segment", "blocks"), key).select("id", "filepath", "vector", place)
        dealt.repartitionByRange("segment").sortWithinPartitions("segment").write.mode("overwrite").parquet(f"{at}/rows")
        discard(spark, f"{at}/raw")
        spark.createDataFrame([(json.dumps({d: c.tolist() for d, c in centres.items()}),)], "centres string").coalesce(1).write.mode("overwrite").parquet(f"{at}/centres")
        return cls(spark, at)

    def search(self, queries: DataFrame, k: int, prefix: str | None = None, read: list | None = None) -> DataFrame:
        """query_id, id, score of the vectors that may be among the k nearest of each
        query(query_id, vector): those in the blocks that were read, k of each.
        ``read`` gets (phase, vectors scored, vectors times queries)."""
        tables = Tables(self.spark, "cells")
        asked = queries.select("query_id", F.col("vector").cast("array<double>").alias("vector"))
        n, wide = asked.agg(F.count("*"), F.coalesce(F.max(F.size("vector")), F.lit(1))).first()
        groups = max(1, -(-n // min(BLOCK_QUERIES, max(LEAST_ROWS, BLOCK_VALUES // max(wide, 1)))))
        first = self._pairs(asked.withColumn("cutoff", F.lit(None).cast("double")), k, groups, True)
        first = tables.keep(self._scored(first, k, prefix), "first")
        place = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "id"))
        cutoff = first.withColumn("_n", place).where(F.col("_n") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("cutoff"))
        rest = self._pairs(asked.join(cutoff, F.col("query_id") == F.col("_q"), "left").drop("_q"), k, groups, False)
        if read is not None:
            rest = tables.keep(rest, "rest")
            size = self.rows.groupBy("segment").agg(F.count("*").alias("n"))
            for phase, pairs in (("first", self._pairs(asked.withColumn("cutoff", F.lit(None).cast("double")), k, groups, True)), ("rest", rest)):
                used = pairs.join(size, "segment").agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
                read.append((phase, used, int(self.shells["n"].sum()) * n))
        return first.unionByName(self._scored(rest, k, prefix))

    def _pairs(self, asked: DataFrame, k: int, groups: int, first: bool) -> DataFrame:
        """The segments that each query is to meet: without a cutoff those of the
        highest bounds, else the others that reach it."""
        dims, cell, n, lo, hi, begin, blocks = (self.shells[c].to_numpy() for c in ("dim", "cell", "n", "lo", "hi", "segment", "blocks"))
        centres, need = self.centres, max(k, FIRST_ROWS)
        # a segment has several shells, or a shell several segments; both are in one order
        held = np.repeat(np.arange(len(n)), blocks)
        segment = begin[held] + np.arange(len(held)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        starts = np.flatnonzero(np.diff(segment, prepend=-1))
        out = StructType([asked.schema["query_id"]]).add("vector", ArrayType(DoubleType())).add("cutoff", "double").add("segment", "integer")
        schema = to_arrow_schema(out)

        def segments(shells: np.ndarray) -> np.ndarray:
            return np.logical_or.reduceat(shells[:, held], starts, axis=1) if len(starts) else np.zeros((len(shells), 0), bool)

        def bounds(vectors: list) -> np.ndarray:
            """(queries, shells): the most that a score can be."""
            most = np.full((len(vectors), len(dims)), 0.5)
            for dim, (i, unit) in unit_rows(vectors).items():
                own = np.flatnonzero(dims == dim)
                if len(own) and dim not in centres:
                    most[np.ix_(i, own)] = 1.0
                elif len(own):
                    q = angles(unit, centres[dim])[:, cell[own]]
                    gap = np.maximum(0, np.maximum(q - hi[own], lo[own] - q))
                    most[np.ix_(i, own)] = (1 + np.cos(gap)) / 2
            return most

        def run(batches):
            for b in batches:
                vectors, cutoffs = b.column("vector").to_pylist(), b.column("cutoff").to_numpy(zero_copy_only=False)
                for at in range(0, len(vectors), 64):
                    most = bounds(vectors[at : at + 64])
                    order = np.argsort(-most, axis=1, kind="stable")
                    before = np.cumsum(n[order], axis=1) - n[order]
                    taken = np.zeros(most.shape, bool)
                    np.put_along_axis(taken, order, before < need, axis=1)
                    meets = segments(taken)
                    if not first:
                        least = np.nan_to_num(cutoffs[at : at + 64].astype(float), nan=-1.0)
                        meets = ~meets & segments(most >= least[:, None] - SLACK)
                    q, s = np.nonzero(meets)
                    for lo_ in range(0, len(s), 4096):
                        part = slice(lo_, lo_ + 4096)
                        who = pa.array(q[part] + at)
                        yield pa.RecordBatch.from_arrays([*(b.column(c).take(who) for c in ("query_id", "vector", "cutoff")), pa.array(segment[starts][s[part]].astype(np.int32))], schema=schema)

        return asked.mapInArrow(run, out).withColumn("qb", F.pmod(F.xxhash64("query_id"), F.lit(groups)).cast("int"))

    def _scored(self, pairs: DataFrame, k: int, prefix: str | None) -> DataFrame:
        """query_id, id, score: of each segment the k best that reach the query's cutoff."""
        rows = self.rows if prefix is None else self.rows.where(F.col("filepath").startswith(prefix))
        met = pairs.select(*[F.col(c).alias(c) for c in ("segment", "qb")]).distinct().join(rows.select("segment", "id", F.col("vector").alias("own")), "segment")
        out = StructType([pairs.schema["query_id"]]).add("id", rows.schema["id"].dataType).add("score", "double")
        schema = to_arrow_schema(out)

        def run(rows: pa.Table, asked: pa.Table) -> pa.Table:
            if not rows.num_rows or not asked.num_rows:
                return schema.empty_table()
            rows = rows.take(pc.sort_indices(rows, [("id", "ascending")]))  # ties stay in order of the ids
            own, found = unit_rows(rows.column("own").to_pylist()), []
            cutoffs = np.nan_to_num(asked.column("cutoff").to_numpy().astype(float), nan=-1.0)
            step = max(1, CELLS // rows.num_rows)
            for at in range(0, asked.num_rows, step):
                some = asked.column("vector").slice(at, step).to_pylist()
                score, least = np.full((len(some), rows.num_rows), 0.5), cutoffs[at : at + step]
                for dim, (i, unit) in unit_rows(some).items():
                    if dim in own:
                        j, m = own[dim]
                        score[np.ix_(i, j)] = np.round(np.clip((1 + unit @ m.T) / 2, 0, 1), 4)
                crowded = np.flatnonzero((score >= least[:, None]).sum(axis=1) > k)
                if len(crowded):
                    least = least.copy()
                    least[crowded] = -np.partition(-score[crowded], k - 1, axis=1)[:, k - 1]
                q, row = np.nonzero(score >= least[:, None])
                value = score[q, row]
                order = np.lexsort((row, -value, q))
                q, row, value = q[order], row[order], value[order]
                start = np.searchsorted(q, np.arange(len(some)))
                use = np.arange(len(q)) - start[q] < k
                found.append((q[use] + at, row[use], value[use]))
            q, row, score = (np.concatenate(x) for x in zip(*found, strict=True))
            return pa.Table.from_arrays([asked.column("query_id").take(pa.array(q)).combine_chunks(), rows.column("id").take(pa.array(row)).combine_chunks(), pa.array(score)], schema=schema)

        return met.groupBy("segment", "qb").cogroup(pairs.groupBy("segment", "qb")).applyInArrow(run, out)


def _segments(dims: np.ndarray, sizes: np.ndarray) -> tuple[list[int], list[int]]:
    """Each shell's first segment, and over how many it is dealt: small shells of a
    dimension that lie side by side share one, a large one has its own."""
    even = max(LEAST_ROWS, -(-int(sizes.sum()) // SEGMENTS))
    first, blocks, segment, held, last = [], [], 0, 0, None
    for dim, n in zip(dims.tolist(), sizes.tolist(), strict=True):
        most = min(BLOCK_ROWS, even, max(LEAST_ROWS, BLOCK_VALUES // max(dim, 1)))
        if held and (dim != last or held + n > most):
            segment, held = segment + 1, 0
        first.append(segment)
        blocks.append(max(1, -(-n // most)))
        held, last = held + n, dim
        if blocks[-1] > 1:
            segment, held = segment + blocks[-1], 0
    return first, blocks


def _assigner(centres: dict[int, np.ndarray], schema: pa.Schema):
    """Each vector's dimension (0: it has no cosine), nearest centroid and angle to it."""

    def run(batches):
        for b in batches:
            vectors = b.column("vector").to_pylist()
            dim, cell, angle = np.zeros(len(vectors), np.int32), np.zeros(len(vectors), np.int32), np.zeros(len(vectors))
            for d, (i, unit) in unit_rows(vectors).items():
                centre = centres.get(d)
                dim[i] = d
                if centre is None:  # a dimension that the sample did not hold: one cell, never skipped
                    angle[i] = np.pi / 2
                    continue
                all_ = angles(unit, centre)
                cell[i] = all_.argmin(1)
                angle[i] = all_.min(1)
            shell = np.minimum(angle * SHELLS / np.pi, SHELLS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("id", "filepath", "vector")), pa.array(dim), pa.array(cell), pa.array(shell), pa.array(angle)], schema=schema)

    return run

"""Stored postings, cut in ranges of documents, and an exact BM25 search that skips ranges.

An index is built once for a snapshot of documents and read by every search. A
range is a few hundred documents that lie side by side (of one group, if the
documents have groups); a row of the index holds a term's postings of one range,
and the most that the term can add to a score there. Each file is ordered by
term, so a search reads only the pages of its terms, and the columns of bounds
without the postings.

A search adds up the bounds of its terms for each query and range. The few ranges
of the highest sums are scored first; the k-th best score that they hold is a
cutoff, and of all other ranges only those are read whose sum of bounds reaches
it. What is skipped cannot hold one of the k best, so the result is exact; how
much is read depends on the documents, and ``search`` can say it.
"""

from __future__ import annotations

import re
from array import array
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DataType, StructType
from pyspark.sql.window import Window as W

from lodestone.sources.scratch import Tables, discard, ship

from . import scan
from .lexical import lowered, query_terms

#: Documents of a range, characters of texts after which it ends, and what a task holds before it ends its largest.
RANGE_DOCS, RANGE_CHARS, HELD_CHARS = 512, 4 << 20, 16 << 20
#: Ranges of each query that are scored first.
FIRST = 4
#: Queries that meet a range in one group.
QUERY_BLOCK = 4096
#: Postings that are added up at once.
CELLS = 1 << 20
#: Scores are rounded to four places; bounds to none.
SLACK = 1e-4
_TOKEN = re.compile("[a-z0-9]+")


class _Range:
    """Documents of one group on the way to a range; a posting takes 8 bytes."""

    def __init__(self):
        self.ids, self.sizes, self.kinds, self.chars, self.codes, self.term, self.tf = [], [], [], 0, {}, array("i"), array("i")

    def add(self, doc_id, text: str) -> None:
        words, codes = _TOKEN.findall(text), self.codes
        counted = Counter(words)
        self.term.extend([codes.setdefault(w, len(codes)) for w in counted])
        self.tf.extend(counted.values())
        self.ids.append(doc_id)
        self.sizes.append(len(words))
        self.kinds.append(len(counted))
        self.chars += len(text)

    def rows(self, number: int, group, schema: pa.Schema) -> pa.RecordBatch:
        """One row for the range itself (no term), one for each of its terms."""
        terms = sorted(self.codes)
        rank = np.empty(len(terms), np.int64)
        rank[np.array([self.codes[t] for t in terms], np.int64)] = np.arange(len(terms))
        term = rank[np.array(self.term, np.int64)]
        order = np.argsort(term, kind="stable")
        doc = np.repeat(np.arange(len(self.ids)), self.kinds)[order]
        count = np.concatenate(([len(self.ids)], np.bincount(term, minlength=len(terms))))
        at = pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32())
        ids, size = pa.array(self.ids, schema.field("ids").type.value_type), np.array(self.sizes, np.int32)
        every = np.concatenate((np.arange(len(self.ids)), doc))
        tf = np.concatenate((np.zeros(len(self.ids), np.int32), np.array(self.tf, np.int32)[order]))
        return pa.RecordBatch.from_arrays(
            [
                pa.array([None, *terms], pa.string()), pa.array(np.full(len(count), number)), pa.array([group] * len(count), schema.field("grp").type), pa.array(count),
                pa.ListArray.from_arrays(at, ids.take(pa.array(every))), pa.ListArray.from_arrays(at, pa.array(tf)), pa.ListArray.from_arrays(at, pa.array(size[every])),
            ], schema=schema,
        )


def _cutter(schema: pa.Schema):
    def run(batches):
        held: dict = {}
        chars, number = 0, TaskContext.get().partitionId() << 33
        for b in batches:
            for doc_id, group, text in zip(*((v.as_py() for v in b.column(c)) for c in ("id", "grp", "text")), strict=True):
                own = held.setdefault(group, _Range())
                own.add(doc_id, text)
                chars += len(text)
                full = [group] if len(own.ids) >= RANGE_DOCS or own.chars >= RANGE_CHARS else []
                if not full and chars >= HELD_CHARS:
                    full = [max(held, key=lambda g: held[g].chars)]
                for g in full:
                    chars -= held[g].chars
                    yield held.pop(g).rows(number, g, schema)
                    number += 1
        for g, own in held.items():
            yield own.rows(number, g, schema)
            number += 1

    return run


def impact(tf: np.ndarray, size: np.ndarray, mean: float, k1: float, b: float) -> np.ndarray:
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * size / mean))


class Postings:
    """A stored index: terms/ (a row for each term and range), ranges/ (each range's documents)."""

    def __init__(self, spark: SparkSession, at: str):
        self.spark, self.at = spark, at
        self.rows = spark.read.parquet(f"{at}/terms")
        self.ranges = spark.read.parquet(f"{at}/ranges")
        self.stats = spark.read.parquet(f"{at}/stats").first().asDict()

    @classmethod
    def build(cls, docs: DataFrame, at: str, group: str | None = None, k1: float = 1.5, b: float = 0.75) -> Postings:
        """Index docs(id, text[, group]) into the folder ``at``; ids are unique. A document
        without an id counts in the statistics and is never found."""
        spark = docs.sparkSession
        ship(spark)
        own = lowered(docs, group).withColumnRenamed(group, "grp") if group else lowered(docs).withColumn("grp", F.lit(None).cast("string"))
        kind: DataType = own.schema["id"].dataType
        arrays = "ids array<{0}>, tf array<int>, dl array<int>".format(kind.simpleString())
        raw = StructType.fromDDL(f"term string, range long, grp {own.schema['grp'].dataType.simpleString()}, n long, {arrays}")
        own.select("id", "grp", "text").mapInArrow(_cutter(to_arrow_schema(raw)), raw).write.mode("overwrite").parquet(f"{at}/raw")
        cut = spark.read.schema(raw).parquet(f"{at}/raw")
        ranges = cut.where("term IS NULL")
        ranges.select("range", "grp", "n", "ids").write.mode("overwrite").parquet(f"{at}/ranges")
        size = F.sum(F.aggregate("dl", F.lit(0).cast("long"), lambda a, x: a + x))
        n, words = ranges.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(size, F.lit(0))).first()
        mean = words / n if n else 1.0
        # the most that a term adds within a row, without its idf
        adds = lambda tf, dl: tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / (mean or 1.0)))
        bounded = cut.where("term IS NOT NULL").withColumn("ub", F.array_max(F.zip_with("tf", "dl", adds)))
        bounded.sortWithinPartitions("term", "range").write.mode("overwrite").parquet(f"{at}/terms")
        spark.createDataFrame([(n, float(mean), k1, b)], "n_docs long, avgdl double, k1 double, b double").coalesce(1).write.mode("overwrite").parquet(f"{at}/stats")
        discard(spark, f"{at}/raw")
        return cls(spark, at)

    def search(self, queries: DataFrame, k: int, by_group: bool = False, read: list | None = None) -> DataFrame:
        """query_id, id, score[, grp] of scored documents: the k best of each query
        (and group) are among them. ``read`` gets (phase, postings read, postings of
        the queries' terms)."""
        tables = Tables(self.spark, "postings")
        terms = query_terms(queries)
        wanted = self.rows.select("term", "range", "grp", "n", "ub").join(terms.select("term").distinct(), "term", "left_semi")
        wanted = tables.keep(wanted, "wanted")
        df = wanted.groupBy("term").agg(F.sum("n").alias("df"))
        idf = F.log((self.stats["n_docs"] - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1.0)
        terms = tables.keep(terms.join(df, "term").select("query_id", "term", idf.alias("idf")), "terms")
        key = ["query_id", "grp"] if by_group else ["query_id"]
        bounds = terms.join(wanted, "term").groupBy("query_id", "range", "grp").agg(F.sum(F.col("idf") * F.col("ub")).alias("most"))
        place = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("most"), "range"))
        bounds = tables.keep(bounds.withColumn("place", place), "bounds")
        asking, n = terms.agg(F.count_distinct("query_id"), F.count("*")).first()
        blocks, own = max(1, -(-asking // QUERY_BLOCK)), None
        if asking <= scan.MOST_QUERIES and n <= scan.MOST_TERMS:
            own = terms.orderBy("query_id", "term").toArrow()  # goes to every task
        first = tables.keep(self._scored(bounds.where(F.col("place") <= FIRST), terms, k, blocks, own), "first")
        at = F.row_number().over(W.partitionBy(*key).orderBy(F.desc("score"), "id"))
        cutoff = first.withColumn("_n", at).where(F.col("_n") == k).select(*[F.col(c).alias(f"_{c}") for c in key], F.col("score").alias("cutoff"))
        same = [bounds[c].eqNullSafe(cutoff[f"_{c}"]) for c in key]
        on = same[0] & same[1] if by_group else same[0]
        rest = bounds.where(F.col("place") > FIRST).join(cutoff, on, "left").where(f"cutoff IS NULL OR most >= cutoff - {SLACK}").select("query_id", "range", "grp")
        if read is not None:
            rest = tables.keep(rest, "rest")
            every = wanted.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0]
            for phase, pairs in (("first", bounds.where(F.col("place") <= FIRST)), ("rest", rest)):
                used = pairs.join(terms, "query_id").select("range", "term").distinct().join(wanted, ["range", "term"])
                read.append((phase, used.agg(F.coalesce(F.sum("n"), F.lit(0))).first()[0], every))
        out = first.unionByName(self._scored(rest, terms, k, blocks, own))
        return out if by_group else out.drop("grp")

    def _scored(self, pairs: DataFrame, terms: DataFrame, k: int, blocks: int, own: pa.Table | None) -> DataFrame:
        """query_id, id, score, grp: the k best of each pair of a query and a range.
        The queries' terms are ``own``, or too many for that and joined to the pairs."""
        key, block = ["range", "qb"], F.pmod(F.xxhash64("query_id"), F.lit(blocks)).alias("qb")
        rows = self.rows.select("range", "term", "ids", "tf", "dl")
        anew = lambda d, cs: d.select(*[F.col(c).alias(c) for c in cs]).distinct()  # noqa: E731  # both sides come from one table
        if own is None:
            asked = pairs.join(terms.withColumnRenamed("query_id", "_q"), F.col("query_id").eqNullSafe(F.col("_q"))).select("range", block, "query_id", "grp", "term", "idf")
            held = anew(asked, [*key, "term"]).join(rows, ["range", "term"])
        else:
            asked = pairs.select("range", block, "query_id", "grp")
            named = self.spark.createDataFrame([(t,) for t in pc.unique(own.column("term")).to_pylist()], "term string")
            held = anew(asked, key).join(rows.join(F.broadcast(named), "term", "left_semi"), "range")
        out = StructType([pairs.schema["query_id"]]).add("id", self.rows.schema["ids"].dataType.elementType).add("score", "double").add(pairs.schema["grp"])
        schema, (mean, k1, b) = to_arrow_schema(out), (self.stats[c] for c in ("avgdl", "k1", "b"))

        def run(rows: pa.Table, want: pa.Table) -> pa.Table:
            rows, want = rows.combine_chunks(), want.combine_chunks()
            if not rows.num_rows or not want.num_rows:
                return schema.empty_table()
            group = want.column("grp")[0].as_py()
            if own is not None:
                want = own.filter(pc.is_in(own.column("query_id"), pc.unique(want.column("query_id")))).combine_chunks()
            lists = {c: pa.chunked_array(rows.column(c)).combine_chunks() for c in ("ids", "tf", "dl")}
            coded = lists["ids"].flatten().dictionary_encode(null_encoding="encode")
            order = pc.sort_indices(coded.dictionary)
            ids, rank = coded.dictionary.take(order), np.empty(len(coded.dictionary), np.int64)
            rank[order.to_numpy()] = np.arange(len(ids))
            doc = rank[coded.indices.to_numpy()]  # places in order of the ids
            weight = impact(lists["tf"].flatten().to_numpy(), lists["dl"].flatten().to_numpy(), mean or 1.0, k1, b)
            ends = np.cumsum(pc.list_value_length(lists["ids"]).to_numpy(zero_copy_only=False))
            begins = np.concatenate(([0], ends[:-1]))
            at = pc.index_in(want.column("term").combine_chunks(), rows.column("term").combine_chunks())
            want, place = want.filter(pc.is_valid(at)), at.drop_null().to_numpy().astype(np.int64)  # a range need not hold all terms
            asker = want.column("query_id").combine_chunks().dictionary_encode(null_encoding="encode")
            who, idf = asker.indices.to_numpy(), want.column("idf").to_numpy()
            total = np.zeros(len(asker.dictionary) * len(ids))
            size = ends[place] - begins[place]
            part = np.cumsum(size) // CELLS  # some rows at a time
            for p in np.unique(part):
                now = np.flatnonzero(part == p)
                n = size[now]
                cell = np.repeat(begins[place[now]] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                total += np.bincount(np.repeat(who[now], n) * len(ids) + doc[cell], weights=np.repeat(idf[now], n) * weight[cell], minlength=len(total))
            total = total.reshape(-1, len(ids))
            total[:, ids.is_null().to_numpy(zero_copy_only=False)] = 0
            score = np.round(total, 4)
            best = np.argsort(-np.where(total > 0, score, -1.0), axis=1, kind="stable")[:, :k]  # ties stay in order of the ids
            q, at = np.repeat(np.arange(len(best)), best.shape[1]), best.reshape(-1)
            hit = total[q, at] > 0
            q, at = q[hit], at[hit]
            group = pa.array([group] * len(q), schema.field("grp").type)
            return pa.Table.from_arrays([asker.dictionary.take(pa.array(q)), ids.take(pa.array(at)), pa.array(score[q, at]), group], schema=schema)

        return held.groupBy("range", "qb").cogroup(asked.groupBy("range", "qb")).applyInArrow(run, out)

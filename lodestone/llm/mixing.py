"""Mixing sources to target weights, in DataFrame functions only.

Capped water-filling: sources share the total by weight; those above
``epochs`` times their size are clamped there and their excess goes to the
others by weight, again until none is above. A source then takes its documents
as many whole times as fit, and one more time the documents that come first in
a seeded order until the target is reached; the last of these in part.

The seeded order needs no sort of a source: words are summed by ``BINS`` ranges
of the hash, whole ranges are in or out, and only the range where the target
ends is ordered.

Edge cases: a null text has size 0 and is taken 0 times, an empty one too; a
very long text is a document like any other, whose last time may be taken in
part, so its source ends at its target whatever its length; a null source is a
source of its own, after all others; rows that repeat are documents of their
own, and rows that tie in the seeded order (one id and size) are interchangeable:
which of them is taken in part is open, the counts are not; an empty table gives
no rows; a source without words has target 0; columns that ``carry`` does not
name are ignored, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from .quality_rules import WORD
from .storage import Scratch

BINS = 4096


def _placed(rows: DataFrame, order: list[Column], sums: dict[str, str], scratch: Scratch, name: str) -> DataFrame:
    """rows with ``_n``, each row's place in the given order from 0, and for each
    (new: old) of ``sums`` the sum of old over the rows before it.

    Ranges of the order are dealt to tasks, counted and summed; each task adds
    what lies before its range, so no task holds all rows.
    """
    own = W.partitionBy("_range").orderBy(*order)
    before = own.rowsBetween(W.unboundedPreceding, -1)
    ranged = scratch.keep(rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), name)
    totals = ranged.groupBy("_range").agg(F.count("*").alias("_rows"), *[F.sum(old).alias(f"_{new}") for new, old in sums.items()])
    earlier = W.orderBy("_range").rowsBetween(W.unboundedPreceding, -1)  # a row for each task's range
    starts = totals.select("_range", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(c) for c in ["_rows", *(f"_{new}" for new in sums)]])
    placed = ranged.select("*", (F.row_number().over(own) - 1).alias("_n"), *[F.coalesce(F.sum(old).over(before), F.lit(0)).alias(new) for new, old in sums.items()])
    placed = placed.join(F.broadcast(starts), "_range")
    return placed.select(*rows.columns, (F.col("_n") + F.col("_rows")).alias("_n"), *[(F.col(new) + F.col(f"_{new}")).alias(new) for new in sums])


def water_level(sources: DataFrame, total: int, scratch: Scratch) -> float:
    """The level L with sum(min(cap, L * weight)) = total over sources(weight, cap).

    In the order of cap / weight, those before some place are clamped; what they
    leave, shared by the others, gives a level that clamps none of these.
    """
    weights = sources.agg(F.sum("weight")).first()[0] or 0
    sums = {"held": "cap", "ahead": "weight"}
    d = _placed(sources.select("weight", "cap"), [F.col("cap") / F.col("weight"), F.col("weight")], sums, scratch, "levels")
    d = d.withColumn("level", (F.lit(total) - F.col("held")).cast("double") / (F.lit(weights) - F.col("ahead")).cast("double"))
    found = d.where("level * weight <= cap").agg(F.min_by("level", "_n")).first()[0]
    return float("inf") if found is None else found


def mix(spark: SparkSession, docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), epochs: int = 3, seed: int = 17, carry: list[str] | None = None, most_sources: int = 100_000) -> DataFrame:
    """carry (doc_id unless given), size, source_size, target, taken and repeats
    for each row of docs(doc_id, text, source).

    ``weights`` go round the sources in the order of their names. ``taken``
    counts words; ``repeats`` is taken / size, rounded.
    """
    scratch = Scratch(spark, "mix")
    carry = ["doc_id"] if carry is None else carry
    size = F.coalesce(F.regexp_count(F.col("_text"), F.lit(WORD)), F.lit(0)).cast("long")
    d = docs.select(*carry, F.col("source").cast("string").alias("_source"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("_id"), F.col("text").cast("string").alias("_text"))
    d = d.withColumn("_h", F.md5(F.concat(F.lit(f"{seed}|"), F.col("_id")))).withColumn("_bin", F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"))
    if "text" not in carry:  # without texts the rows are small; with them they are read again instead
        d = scratch.keep(d.withColumn("size", size).drop("_text"), "sized").withColumn("_text", F.lit(None).cast("string"))
        size = F.col("size")
    bins = scratch.keep(d.withColumn("size", size).groupBy("_source", "_bin").agg(F.sum("size").alias("words")), "bins")
    sources = bins.groupBy("_source").agg(F.sum("words").alias("source_size"))
    sources = _placed(sources, [F.col("_source").asc_nulls_last()], {}, scratch, "names")
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("_n") % len(weights) + 1).cast("int")).cast("long")
    sources = scratch.keep(sources.select("_source", "source_size", weight.alias("weight"), (epochs * F.col("source_size")).alias("cap")), "sources")
    total = sources.agg(F.coalesce(F.sum("source_size"), F.lit(0))).first()[0]
    level = F.lit(water_level(sources, total, scratch)) * F.col("weight")
    sources = sources.withColumn("target", F.when(level > F.col("cap"), F.col("cap").cast("double")).otherwise(level))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.select("_source", "source_size", "target", whole.alias("_whole"), (F.floor(F.col("target") + 0.5).cast("long") - whole * F.col("source_size")).alias("_rest"))
    before = F.coalesce(F.sum("words").over(W.partitionBy("_source").orderBy("_bin").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    s, b = sources.alias("s"), bins.withColumn("_before", before).alias("b")
    ends = b.join(s, F.col("b._source").eqNullSafe(F.col("s._source"))).where("_before < _rest AND _before + words >= _rest")
    ends = ends.select(F.col("b._source").alias("_e"), F.col("_bin").alias("_end"), F.col("_before").alias("_done"))
    sources = s.join(ends, F.col("s._source").eqNullSafe(F.col("_e")), "left").select("s._source", "source_size", "target", "_whole", "_rest", "_end", "_done").withColumnRenamed("_source", "_s")
    sources = scratch.keep(sources, "targets")
    if sources.count() <= most_sources:  # else the join is left to Spark
        sources = F.broadcast(sources)
    d = d.join(sources, F.col("_source").eqNullSafe(F.col("_s")))
    ordered = W.partitionBy("_source").orderBy("_h", "_id", "size").rowsBetween(W.unboundedPreceding, -1)
    at_end = d.where("_bin = _end").withColumn("size", size).drop("_text").withColumn("_sum", F.col("_done") + F.coalesce(F.sum("size").over(ordered), F.lit(0)))
    more = F.greatest(F.lit(0), F.least(F.col("size"), F.col("_rest") - F.col("_sum")))
    clear = F.when(F.col("_bin") < F.col("_end"), F.col("size")).otherwise(0)
    clear_of = d.where("NOT (_bin <=> _end)").withColumn("size", size).drop("_text")
    out = clear_of.withColumn("_more", F.coalesce(clear, F.lit(0)).cast("long")).unionByName(at_end.withColumn("_more", more.cast("long")).drop("_sum"))
    out = out.withColumn("taken", F.col("_whole") * F.col("size") + F.col("_more"))
    repeats = F.when(F.col("size") > 0, F.floor(F.col("taken") / F.col("size") + 0.5)).otherwise(0).cast("int")
    return out.select(*carry, "size", "source_size", "target", "taken", repeats.alias("repeats"))


#: The same mix in DuckDB's SQL.
SQL = r"""
WITH d AS (SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
                  md5('17|' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h, coalesce(CAST(doc_id AS VARCHAR), '') AS i FROM documents),
s0 AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
s1 AS (SELECT *, ((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1)::BIGINT AS weight, 3 * source_size AS cap FROM s0),
s2 AS (SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS held,
              sum(weight) OVER (ORDER BY cap / weight, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS free,
              sum(source_size) OVER () AS total, cap / weight AS ratio FROM s1),
s3 AS (SELECT *, (total - held)::DOUBLE / free::DOUBLE AS level FROM s2),
l AS (SELECT coalesce(arg_min(level, ratio) FILTER (WHERE level * weight <= cap), 'inf'::DOUBLE) AS level FROM s3),
s AS (SELECT source, source_size, CASE WHEN l.level * weight > cap THEN cap::DOUBLE ELSE l.level * weight END AS target FROM s1, l),
t AS (SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM s),
u AS (SELECT *, floor(target + 0.5)::BIGINT - whole * source_size AS rest FROM t),
o AS (SELECT d.doc_id, d.size, u.source_size, u.target, u.whole, u.rest,
             coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.i, d.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM d JOIN u ON d.source IS NOT DISTINCT FROM u.source)
SELECT doc_id, size, source_size, target, (whole * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM o
"""

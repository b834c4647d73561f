"""Cross-site line deduplication by distinct-site spread, in DataFrame functions only.

Every distinct line hash of a document adds its site to a HyperLogLog sketch of
that hash; sketches merge by aggregation. Lines whose estimate lies near the
threshold get an exact distinct count; lines clearly above it are boilerplate
by the sketch. Boilerplate lines are removed from every document.

A line is compared without the blanks at its ends; blank lines are never
removed.

Edge cases: a null text stays null and has no lines; a null site counts as no
site; rows that repeat change nothing, since sites count once; a document whose
every line goes keeps an empty text; an empty table gives no rows; all columns
of the input are kept, ``n_lines`` and ``n_removed`` are added (columns of
those names are replaced).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .storage import Scratch

BLANKS = " \t\r\x0b\x0c"
#: Log2 of the sketch's registers: 1.6 % standard error.
LG_K = 12
#: Share of the threshold on either side of it that is counted exactly.
MARGIN = 0.1


def _trimmed(line: Column) -> Column:
    return F.btrim(line, F.lit(BLANKS))


def boilerplate(spark: SparkSession, docs: DataFrame, scratch: Scratch, min_sites: int, site: str) -> DataFrame:
    """(h, g): two 64-bit hashes of each line seen on min_sites sites or more."""
    lines = F.array_distinct(F.transform(F.split(F.col("text").cast("string"), "\n"), _trimmed))
    each = docs.select(F.col(site).cast("string").alias("site"), F.explode(lines).alias("line")).where("line <> ''")
    each = each.select("site", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), F.col("line")).alias("g"))
    # fewer documents than the threshold cannot be on as many sites
    often = scratch.keep(each.groupBy("h", "g").agg(F.count("*").alias("c")).where(F.col("c") >= min_sites).select("h", "g"), "often")
    spread = each.join(often, ["h", "g"]).groupBy("h", "g").agg(F.hll_sketch_estimate(F.hll_sketch_agg("site", F.lit(LG_K))).alias("sites"))
    spread = scratch.keep(spread, "spread")
    low, high = min_sites * (1 - MARGIN) - 1, min_sites * (1 + MARGIN) + 1
    near = spread.where((F.col("sites") >= low) & (F.col("sites") <= high)).select("h", "g")
    exact = each.join(near, ["h", "g"]).groupBy("h", "g", "site").agg(F.lit(1).alias("one")).where("site IS NOT NULL").groupBy("h", "g").agg(F.count("*").alias("n"))
    return spread.where(F.col("sites") > high).select("h", "g").union(exact.where(F.col("n") >= min_sites).select("h", "g"))


def remove_boilerplate(spark: SparkSession, docs: DataFrame, min_sites: int = 10, site: str = "source") -> DataFrame:
    """docs with boilerplate lines removed from text, n_lines and n_removed."""
    scratch = Scratch(spark, "lines")
    columns = [c for c in docs.columns if c not in ("n_lines", "n_removed")]
    bad = scratch.keep(boilerplate(spark, docs, scratch, min_sites, site), "boilerplate")
    lines = F.array_distinct(F.transform(F.split(F.col("text").cast("string"), "\n"), _trimmed))
    each = docs.select(F.col("doc_id").alias("__id"), F.explode(lines).alias("line")).where("line <> ''")
    each = each.select("__id", F.xxhash64("line").alias("h"), F.xxhash64(F.lit(7), F.col("line")).alias("g"))
    hits = each.join(bad, ["h", "g"]).groupBy("__id").agg(F.collect_set("h").alias("__bad"))
    d = docs.select(*columns).join(hits, F.col("doc_id").eqNullSafe(F.col("__id")), "left").drop("__id")
    split = F.split(F.col("text").cast("string"), "\n")
    d = d.withColumn("__lines", split)
    kept = F.filter("__lines", lambda x: (_trimmed(x) == "") | ~F.array_contains(F.col("__bad"), F.xxhash64(_trimmed(x))))
    d = d.withColumn("__kept", F.when(F.col("__bad").isNull(), F.col("__lines")).otherwise(kept))
    text = F.when(F.col("__bad").isNull(), F.col("text").cast("string")).otherwise(F.array_join("__kept", "\n"))
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    count = F.when(F.col("text").isNull(), F.lit(0)).otherwise(size("__lines"))
    return d.select(*[text.alias("text") if c == "text" else F.col(c) for c in columns], count.cast("long").alias("n_lines"), F.when(F.col("text").isNull(), F.lit(0)).otherwise(size("__lines") - size("__kept")).cast("long").alias("n_removed"))


#: The same in DuckDB's SQL, with exact counts.
SQL = r"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM documents),
t AS (SELECT *, trim(line, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM l),
bad AS (SELECT k FROM t WHERE k <> '' GROUP BY k HAVING count(DISTINCT source) >= 10),
r AS (SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE k IN (SELECT k FROM bad)) AS n_removed,
             coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE k NOT IN (SELECT k FROM bad)), '') AS kept FROM t GROUP BY doc_id)
SELECT d.doc_id, coalesce(r.n_lines, 0)::BIGINT AS n_lines, coalesce(r.n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN d.text IS NULL THEN NULL ELSE sha256(coalesce(r.kept, '')) END AS kept_sha256
FROM documents d LEFT JOIN r ON d.doc_id = r.doc_id
"""

"""A corpus pipeline of five stages, each a step of its own.

quality rules -> line dedup -> near dedup -> mixing -> packing. Every stage
reads what its predecessor wrote, works on all of it, and returns the columns
of documents; the last returns packed pieces.

In every stage rows without an id or a source are rows like others, rows that
repeat are judged alike, ties are settled by id, an empty table gives no rows,
very long texts are handled whole, and columns beyond those of documents are
dropped first, so their names cannot clash. A table without lang, source or
n_chars is read as if they were null.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import line_dedup, mixing, near_dedup, packing, quality_rules
from lodestone.llm.storage import Scratch

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def plain(docs: DataFrame) -> DataFrame:
    """The columns of documents alone, null where the table has none."""
    kinds = {"doc_id": "long", "n_chars": "long"}
    return docs.select(*[F.col(c) if c in docs.columns else F.lit(None).cast(kinds.get(c, "string")).alias(c) for c in COLUMNS])


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules keep; a null, empty or short text goes."""
    judged = quality_rules.quality_rules(spark, plain(docs), carry=COLUMNS)
    return judged.where("kept").select(*COLUMNS)


def stage_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the lines that many sites share; no document goes, a
    null text stays null, and a text whose every line goes is empty."""
    docs = plain(docs)
    cleaned = line_dedup.remove_boilerplate(spark, docs)
    return cleaned.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(*COLUMNS)


def stage_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, 0.8); the one with the least id.

    A row without an id goes if its group has one with an id; otherwise one of
    the group stays, and so does a text of its own or without words. Rows that
    repeat (same id and text) count as one row. Rows of one id but different
    texts are different documents. Rows are told apart by a 64-bit hash of id
    and text; only hashes are grouped, texts are read again for the result.
    """
    keyed = plain(docs).select(F.xxhash64(F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias("_k"), *COLUMNS)
    scratch = Scratch(spark, "pipeline-near")
    groups = near_dedup.near_duplicates(spark, keyed.select(F.col("_k").alias("doc_id"), "text"), k=5, threshold=80)
    rows = keyed.groupBy("_k").agg(F.first("doc_id").alias("doc_id"), F.count("*").alias("times"))
    members = groups.select(F.col("doc_id").alias("_k"), "component_id").distinct().join(rows, "_k")
    least = members.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull().alias("n"), "doc_id", "_k")).alias("least"))
    judged = members.join(least, "component_id").select("_k", (F.col("_k") == F.col("least._k")).alias("stays"), (F.col("times") > 1).alias("repeats"))
    # the few that go or repeat; the rest passes without being moved
    judged = scratch.keep(judged.where("NOT stays OR repeats"), "judged")
    once = judged.where("stays").select("_k")
    single = keyed.join(judged.select("_k"), "_k", "left_anti").select(*COLUMNS)
    repeated = keyed.join(once, "_k", "left_semi").groupBy("_k").agg(F.first(F.struct(*COLUMNS)).alias("row")).select("row.*")
    return single.unionByName(repeated)


def stage_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it: a row for each repetition;
    a null or empty text is taken no times."""
    mixed = mixing.mix(spark, plain(docs), carry=COLUMNS)
    return mixed.where("repeats > 0").withColumn("_r", F.explode(F.sequence(F.lit(1), F.col("repeats")))).select(*COLUMNS)


def stage_pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of token sequences with their places; a null or empty text is one
    piece of its end id."""
    return packing.pack(spark, docs)


STAGES = [("quality rules", stage_quality), ("line dedup", stage_lines), ("near dedup", stage_near), ("mixing", stage_mix), ("packing", stage_pack)]
#: Near dedup and packing have no SQL form; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = scratch.keep(stage(spark, docs, sf_dir), str(i))
        if i > 1:
            scratch.drop(str(i - 2))
    return docs

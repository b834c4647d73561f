"""The queries of this subpackage's operators, over the tables of a folder."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, line_dedup, mixing, near_dedup, packing, pairwise_quality, pii, quality_rules, runs, simhash, suffix_dedup, tokens, topk_search
from .storage import sound


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    sound(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The contract's columns, and n_passage_words: the words that lie in a
    passage of more than 50 words which another document holds too, in bytes
    under 400 or not."""
    out = suffix_dedup.remove_repeats(spark, table(spark, sf_dir, "documents"), length=400, keep="none", passage_words=51)
    total = lambda spans: F.aggregate(spans, F.lit(0).cast("long"), lambda a, s: a + s["hi"] - s["lo"])
    return out.select("doc_id", "n_bytes", total("spans").alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), total("passages").alias("n_passage_words"))


def op2_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "embeddings")
    v = d.select(F.col("vec_id").cast("long").alias("id"), topk_search.quantised(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    return topk_search.top_k(spark, v, v.where("id % 100 = 0"), 10)


def op3_superminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(spark, table(spark, sf_dir, "documents"), k=4, threshold=80)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = tokens.token_counts(spark, table(spark, sf_dir, "documents"), "piece_bpe_32k.model")
    return out.withColumn("over_limit", F.col("n_tokens") > 4096)


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_found, found and the text with pseudonyms. The key is the
    session's spark.lodestone.pii.key; without one, that of demonstrations."""
    key = spark.conf.get("spark.lodestone.pii.key", None)
    out = pii.pseudonymise(spark, table(spark, sf_dir, "documents"), key.encode() if key else pii.DEMO_KEY)
    return out.select("doc_id", F.size("found").cast("long").alias("n_found"), "found", "text")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(spark, table(spark, sf_dir, "documents")).drop("repeats")


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_lines, n_removed and the hash of the text that is left."""
    out = line_dedup.remove_boilerplate(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(spark, table(spark, sf_dir, "documents")).drop("char_js", "word_js")


def op9_pairwise_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = pairwise_quality.train(spark, docs, labels.where(~pairwise_quality.held_out(F.col("doc_id"))))
    out = pairwise_quality.score(spark, docs, model)
    return out.select("doc_id", pairwise_quality.held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= pairwise_quality.CUT).cast("int").alias("predicted"))


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(spark, table(spark, sf_dir, "documents"))


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.reports(spark, table(spark, sf_dir, "conversations"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.digest(runs.collapse_runs(spark, table(spark, sf_dir, "documents"), before=runs.planted))


def op13_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = simhash.near_duplicates(spark, table(spark, sf_dir, "documents"))
    return out.select("doc_id", simhash.hexadecimal("fp").alias("fingerprint"), "component_id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_suffix_dedup, op2_topk_search, op3_superminhash, op4_token_counts, op5_pii, op6_mixing, op7_line_dedup, op8_quality_rules, op9_pairwise_quality, op10_packing, op11_conversation_repair, op12_periodic_runs, op13_simhash)
}
SQL: dict[str, str] = {"op11_conversation_repair": conversations.SQL, "op2_topk_search": topk_search.SQL, "op3_superminhash": near_dedup.SQL, "op6_mixing": mixing.SQL, "op7_line_dedup": line_dedup.SQL, "op8_quality_rules": quality_rules.SQL}

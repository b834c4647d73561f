"""Rank fusion, normalisation, reranking and the confidence guard."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

RRF_K = 60
#: Weights of the lexical leg, the graph leg and the other legs.
WEIGHTS = (0.4, 0.3, 0.3)


def reciprocal_rank_fusion(legs: list[tuple[DataFrame, float]], k: int = RRF_K) -> DataFrame:
    """query_id, id, score = sum of weight / (k + rank), raw_cosine.

    Legs hold query_id, id, rank (from 1), score and source. One aggregation
    over their union takes the place of outer joins.
    """
    every = None
    for leg, weight in legs:
        part = leg.select("query_id", "id", (F.lit(weight) / (k + F.col("rank"))).alias("part"), F.when(F.col("source") == "embeddings", F.col("score")).alias("cosine"))
        every = part if every is None else every.unionByName(part)
    fused = every.groupBy("query_id", "id").agg(F.sum("part").alias("raw"), F.coalesce(F.max("cosine"), F.lit(0.0)).alias("raw_cosine"))
    return fused.select("query_id", "id", F.round("raw", 4).alias("score"), F.round("raw", 12).alias("raw"), "raw_cosine", F.lit("hybrid").alias("source"))


def minmax(hits: DataFrame) -> DataFrame:
    """similarity = score scaled to 0..1 within its query (1 if all are equal);
    the score stays as rrf_score."""
    w = W.partitionBy("query_id")
    low, high = F.min("score").over(w), F.max("score").over(w)
    scaled = F.when(high == low, F.lit(1.0)).otherwise((F.col("score") - low) / (high - low))
    return hits.withColumn("similarity", F.round(scaled, 4)).withColumn("rrf_score", F.col("score"))


def ranked(hits: DataFrame, by: str = "score") -> DataFrame:
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.desc(by), F.asc_nulls_last("id"))))


def rerank(hits: DataFrame, k: int, scorer: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """The k best by rerank_score. ``scorer`` adds that column; without one the
    order stays and rerank_score is similarity."""
    scored = scorer(hits) if scorer is not None else hits.withColumn("rerank_score", F.col("similarity"))
    first = W.partitionBy("query_id").orderBy(F.desc("rerank_score"), F.desc("score"), F.asc_nulls_last("id"))
    return scored.withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= k)


def confidence_guard(hits: DataFrame, threshold: float, signal: str = "rerank_score") -> DataFrame:
    """All of a query's hits, or none if its best signal is below the threshold."""
    if threshold <= 0:
        return hits
    best = F.max(signal).over(W.partitionBy("query_id"))
    return hits.withColumn("_best", best).where(F.col("_best") >= threshold).drop("_best")


def hybrid(lexical: DataFrame, embeddings: DataFrame | None, structural: DataFrame | None, k: int = 10, scorer=None) -> DataFrame:
    """Legs of 2k each -> fusion -> normalisation over all that is fused -> the k
    best, or the best 4k (40 at least) reranked to k."""
    legs = [(lexical, WEIGHTS[0])]
    if embeddings is not None:
        legs.append((embeddings, WEIGHTS[2]))
    if structural is not None:
        legs.append((structural, WEIGHTS[2]))
    scaled = minmax(reciprocal_rank_fusion(legs))
    if scorer is not None:
        scaled = ranked(scaled, "raw").where(F.col("rank") <= max(4 * k, 40))
    return rerank(scaled, k, scorer)

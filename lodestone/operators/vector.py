"""Exact nearest-neighbour search by cosine."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import scan
from .lexical import top


def nearest(vectors: DataFrame, queries: DataFrame, k: int = 10, prefix: str | None = None, index=None) -> DataFrame:
    """The k nearest of vectors(id, vector[, filepath]) to each query(query_id, vector),
    by (1 + cosine) / 2 to four places; 0.5 where there is no cosine.

    From the stored ``index`` of these vectors (``cells.Cells``), if there is one;
    otherwise by a scan, of blocks against blocks if the queries are many."""
    if index is not None:
        return top(index.search(queries, k, prefix), k, "embeddings")
    if prefix is not None:
        vectors = vectors.where(F.col("filepath").startswith(prefix))
    asked = scan.collected(queries.select("query_id", "vector"), "vector")
    if asked is None:
        return top(scan.block_best(vectors, queries, k), k, "embeddings")
    scorer = scan.vector_scorer([v for _, v in asked])
    return top(scan.best_rows(vectors.select("id", "vector"), queries, [q for q, _ in asked], k, scorer), k, "embeddings")


def score_means(vectors: DataFrame, queries: DataFrame, same: str) -> DataFrame:
    """relevant, pairs, total: over all pairs of a vector and a query, those that
    agree in column ``same`` apart, how many there are and the sum of their scores.
    Blocks meet blocks and give sums; no pair becomes a row."""
    return scan.block_sums(vectors, queries, same).groupBy("relevant").agg(F.sum("pairs").alias("pairs"), F.sum("total").alias("total"))

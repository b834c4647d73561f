"""Routing queries to the best of several collections, and context assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as X


def route(hits: DataFrame, key: str = "project_id", by: str = "score") -> DataFrame:
    """The winning collection of each query: best top hit, ties by name."""
    best = hits.groupBy("query_id", key).agg(F.max(by).alias("best"))
    w = W.partitionBy("query_id").orderBy(F.desc("best"), key)
    return best.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def routed_search(hits: DataFrame, k: int = 10, key: str = "project_id") -> DataFrame:
    """Hits of each query's winning collection only."""
    won = route(hits, key).select("query_id", key)
    w = W.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return hits.join(won, ["query_id", key], "left_semi").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def drop_foreign(rows: DataFrame, project: str, root: str | None = None) -> DataFrame:
    """Rows of the project, or of none, which are stamped with it; rows under
    another absolute root go."""
    own = F.coalesce(F.col("project_id"), F.lit(project)) == project
    if root is not None:
        own = own & (~F.col("filepath").startswith("/") | F.col("filepath").startswith(root))
    return rows.where(own).withColumn("project_id", F.lit(project))


def assemble(hits: DataFrame, memory: DataFrame | None = None, repo_map: DataFrame | None = None, most: int = 5) -> DataFrame:
    """context of each query: its best hits, the map of 20 files, recent memory."""
    w = W.partitionBy("query_id").orderBy("rank")
    top = hits.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most)
    line = X.hit_line(F.col("_n"), F.col("function"), F.col("filepath"), F.col("similarity"), F.col("code"))
    found = top.groupBy("query_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_n", line.alias("l")))), lambda x: x["l"]), "\n").alias("hits"))
    parts = [F.concat(F.lit("## Relevant code\n"), F.col("hits"))]
    if repo_map is not None:
        files = repo_map.orderBy("filepath").limit(20).agg(F.array_join(F.array_sort(F.collect_list(F.concat_ws(": ", "filepath", "names"))), "\n").alias("map"))
        found, parts = found.crossJoin(files), [*parts, F.concat(F.lit("## Files\n"), F.col("map"))]
    if memory is not None:
        found, parts = found.crossJoin(memory.agg(F.max("text").alias("memory"))), [*parts, F.concat(F.lit("## Recent changes\n"), F.col("memory"))]
    out = found.withColumn("context", F.concat_ws("\n\n", *parts))
    return out.select("query_id", "context", X.approx_tokens(F.col("context")).alias("tokens"))

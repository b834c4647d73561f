"""Retrieval evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lodestone.functions import text as X


def suffix_matches(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """Hits (query_id, rank, id) with whether they match any gold id of their
    query: equal, or one the other's suffix, without lines. The equi-join on
    the query bounds the suffix test to its own gold."""
    h = hits.withColumn("_h", X.evaluation_id(F.col("id").cast("string")))
    g = gold.select("query_id", X.evaluation_id(F.col("gold").cast("string")).alias("_g"))
    same = F.col("_h").endswith(F.col("_g")) | F.col("_g").endswith(F.col("_h"))
    return h.join(g, "query_id", "left").groupBy("query_id", "rank", "id").agg(F.coalesce(F.bool_or(same), F.lit(False)).alias("match"))


def per_query(hits: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """recall, capped_recall, mrr and ndcg at k of each query with gold."""
    n = gold.groupBy("query_id").agg(F.count("*").alias("relevant"))
    m = suffix_matches(hits.where(F.col("rank") <= k), gold).where("match")
    found = m.groupBy("query_id").agg(F.count("*").alias("hit"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1.0)).alias("dcg"))
    ideal = F.expr(f"aggregate(sequence(1, CAST(least(relevant, {k}) AS INT)), 0D, (s, i) -> s + 1 / log2(i + 1.0D))")
    d = n.join(found, "query_id", "left")
    z = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 4)
    return d.select(
        "query_id", "relevant", z(F.col("hit") / F.col("relevant")).alias("recall"), z(F.least(F.lit(1.0), F.col("hit") / F.col("relevant"))).alias("capped_recall"),
        z(1 / F.col("first")).alias("mrr"), z(F.col("dcg") / ideal).alias("ndcg"),
    )


def compare(strategies: dict[str, DataFrame], gold: DataFrame, k: int = 10) -> DataFrame:
    """Mean metrics of each strategy."""
    every = None
    for name, hits in strategies.items():
        part = per_query(hits, gold, k).withColumn("strategy", F.lit(name))
        every = part if every is None else every.unionByName(part)
    mean = lambda c: F.round(F.avg(c), 4).alias(c)
    return every.groupBy("strategy").agg(F.count("*").alias("queries"), mean("recall"), mean("mrr"), mean("ndcg"), (F.avg("recall") >= 0.8).alias("claimable"))


def rerank_ab(results: DataFrame) -> DataFrame:
    """Rates of each arm over (arm, relevant, top1_correct, suppressed) and the verdict."""
    rate = lambda c, on: F.round(100 * F.avg(F.when(on, F.col(c).cast("double"))), 1)
    arms = results.groupBy("arm").agg(rate("top1_correct", F.col("relevant")).alias("top1_pct"), rate("suppressed", ~F.col("relevant")).alias("suppressed_pct"))
    pivot = arms.agg(*[F.max(F.when(F.col("arm") == a, F.col(c))).alias(f"{c}_{a}") for a in ("off", "on") for c in ("top1_pct", "suppressed_pct")])
    better, worse = F.col("top1_pct_on") > F.col("top1_pct_off"), F.col("top1_pct_on") < F.col("top1_pct_off")
    more, less = F.col("suppressed_pct_on") > F.col("suppressed_pct_off"), F.col("suppressed_pct_on") < F.col("suppressed_pct_off")
    return pivot.withColumn("verdict", F.when((better & ~less) | (more & ~worse), "WIN").when((worse & ~more) | (less & ~better), "LOSS").when(worse | less, "MIXED").otherwise("TIE"))


def separation_gap(scores: DataFrame) -> DataFrame:
    """Mean score of relevant and other rows (relevant, score), and their gap."""
    d = scores.agg(F.avg(F.when(F.col("relevant"), F.col("score"))).alias("a"), F.avg(F.when(~F.col("relevant"), F.col("score"))).alias("b"))
    return d.select(F.round("a", 4).alias("relevant_mean"), F.round("b", 4).alias("other_mean"), F.round(F.col("a") - F.col("b"), 4).alias("gap"))


def gap_of_means(means: DataFrame) -> DataFrame:
    """The same from (relevant, pairs, total): how many pairs there are, and their sum."""
    one = lambda on: F.sum(F.when(on, F.col("total"))) / F.sum(F.when(on & (F.col("pairs") > 0), F.col("pairs")))
    d = means.agg(one(F.col("relevant")).alias("a"), one(~F.col("relevant")).alias("b"))
    return d.select(F.round("a", 4).alias("relevant_mean"), F.round("b", 4).alias("other_mean"), F.round(F.col("a") - F.col("b"), 4).alias("gap"))


def first_hit(hits: DataFrame, wanted: DataFrame, k: int = 8) -> DataFrame:
    """hit_rank: the first of k hits (query_id, rank, filepath) whose path holds
    the wanted part; null without one."""
    ok = F.when((F.col("rank") <= k) & F.col("filepath").contains(F.col("part")), F.col("rank"))
    return wanted.join(hits, "query_id", "left").groupBy("query_id").agg(F.min(ok).alias("hit_rank"))


def profile_rates(queries: DataFrame) -> DataFrame:
    """Rates over (relevant, hit_rank, passed, tokens): top-1 and top-5 over
    relevant queries only, suppression over the others."""
    rel = F.col("relevant")
    rate = lambda c, on: F.round(100 * F.avg(F.when(on, c.cast("double"))), 1)
    return queries.agg(
        rate(F.coalesce(F.col("hit_rank") == 1, F.lit(False)), rel).alias("top1_pct"), rate(F.coalesce(F.col("hit_rank") <= 5, F.lit(False)), rel).alias("top5_pct"),
        rate(~F.col("passed"), ~rel).alias("suppressed_pct"), F.round(F.avg("tokens"), 1).alias("avg_tokens"),
    )


def campaign(engine, queries: DataFrame, gold: DataFrame, modes: tuple[str, ...] = ("bm25", "ast", "hybrid"), k: int = 10) -> DataFrame:
    """Mean metrics of an engine's search modes over the same queries."""
    return compare({m: engine.search(queries, k=k, mode=m, guard=False) for m in modes}, gold, k)

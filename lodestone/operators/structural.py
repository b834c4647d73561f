"""Block-name and reference scoring."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X

from . import scan
from .lexical import top


def structural_scores(blocks: DataFrame, queries: DataFrame) -> DataFrame:
    """query_id, id, score > 0 for blocks(id, name, text).

    100 a shared name part, 30 a shared reference, 25 a query word among the
    references' words, 5 a query word inside a longer name part, 15 if two words
    or more are all name parts. Which word lies inside which part is found once
    for the two vocabularies, not for each pair of a block and a query.
    """
    q = queries.select("query_id", F.array_distinct(X.word_tokens(F.col("query"))).alias("q"), X.identifiers(F.col("query")).alias("qi"))
    b = blocks.select("id", X.name_tokens(F.coalesce("name", F.lit(""))).alias("n"), X.identifiers(F.coalesce("text", F.lit(""))).alias("ti"))
    b = b.withColumn("tw", F.array_distinct(F.flatten(F.transform("ti", X.word_tokens))))
    parts, words = b.select("id", F.explode("n").alias("part")), q.select(F.explode("q").alias("word")).distinct()
    held = parts.select("part").distinct().join(words, F.col("part").contains(F.col("word")) & (F.col("part") != F.col("word")))
    # the words inside one part or more, inside two or more, ...: sets, to be met with the query's
    held = parts.join(held, "part").groupBy("id", "word").agg(F.count("*").cast("int").alias("c")).select("id", "word", F.explode(F.sequence(F.lit(1), F.col("c"))).alias("k"))
    held = held.groupBy("id", "k").agg(F.collect_list("word").alias("level")).groupBy("id").agg(F.collect_list("level").alias("held"))
    # of a block's words only those that any query asks for matter
    every = q.agg(F.array_distinct(F.flatten(F.collect_list("q"))).alias("vq"), F.array_distinct(F.flatten(F.collect_list("qi"))).alias("vi"))
    small = lambda a, v: F.array_intersect(a, v).alias(a)
    b = b.crossJoin(every).select("id", small("n", "vq"), small("ti", "vi"), small("tw", "vq")).join(held, "id", "left")
    size = lambda a, c: F.size(F.array_intersect(a, c))
    inside = F.coalesce(F.aggregate("held", F.lit(0), lambda s, level: s + F.size(F.array_intersect(level, "q"))), F.lit(0))
    whole = F.when((F.size("q") >= 2) & (F.size(F.array_except("q", "n")) == 0), 15).otherwise(0)
    score = 100 * size("n", "q") + 30 * size("qi", "ti") + 25 * size("q", "tw") + 5 * inside + whole
    # queries are the small side; every block is scored against each once
    # a filter below the projection would work the score out twice
    kept = F.filter(F.array(score.cast("double")), lambda x: x > 0)
    return b.crossJoin(q).select("query_id", "id", F.explode(kept).alias("score"))


def structural(blocks: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """The k best blocks(id, name, text) of each query; a block without an id is never found."""
    blocks = blocks.where("id IS NOT NULL")
    asked = scan.collected(queries.select("query_id", F.array_distinct(X.word_tokens(F.col("query"))).alias("q"), X.identifiers(F.col("query")).alias("qi")), "q", "qi")
    if asked is None:
        return top(structural_scores(blocks, queries), k, "structural")
    b = blocks.select("id", X.name_tokens(F.coalesce("name", F.lit(""))).alias("n"), X.identifiers(F.coalesce("text", F.lit(""))).alias("ti"))
    b = b.select("id", "n", "ti", F.array_distinct(F.flatten(F.transform("ti", X.word_tokens))).alias("tw"))
    scorer = scan.structural_scorer([q for _, q, _ in asked], [qi for _, _, qi in asked])
    return top(scan.best_rows(b, queries, [a[0] for a in asked], k, scorer), k, "structural")

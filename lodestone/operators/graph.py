"""Symbol-mention graph and its PageRank, factored through the names.

A block points to every other block whose name is among its words. Written out,
the edges grow with the square of the blocks that share names, so they are not:
they stay block -> name -> block. A step of PageRank sums rank by name and hands
each sum to the name's blocks, minus the share that a block which says its own
name would have given itself. What is stored is linear in the mentions, and a
step's work in the pairs of a name and a word that its blocks say.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.sources.scratch import Tables

from . import scan
from .lexical import top

#: Entries of one name above which they are dealt over tasks, and into how many shares at most.
HOT, SPREAD = 100_000, 32
#: Names, and letters in them, up to which they go to the texts.
MOST_NAMES, MOST_LETTERS = 100_000, 4 << 20
#: Entries in a task of a step.
PART_ROWS = 50_000
#: Factors under e to the minus this (1e-30) are left out.
FAINT = 69.1


def mention_edges(blocks: DataFrame) -> DataFrame:
    """src -> dst where dst's name is a keyword of src's text, for blocks(id, name, text).

    For those who want the edges themselves; ranks do not need them."""
    words = blocks.select(F.col("id").alias("src"), F.explode(X.keywords(F.col("text"))).alias("word"))
    names = blocks.select(F.col("id").alias("dst"), F.col("name").alias("word"))
    return words.join(names, "word").where("src <> dst").select("src", "dst").distinct()


def mentions(blocks: DataFrame) -> DataFrame:
    """id, name, deg, own, words of each block that points to another.

    words: its keywords that are names; deg: the blocks it points to; own: whether
    its own name is among them. A block without a name has the empty one, which
    nothing mentions. Ids are unique."""
    named = blocks.select("id", F.coalesce("name", F.lit("")).alias("name"), "text")
    size = named.where("name <> ''").groupBy(F.col("name").alias("word")).agg(F.count("*").alias("c"))
    names, letters = size.agg(F.count("*"), F.coalesce(F.sum(F.length("word")), F.lit(0))).first()
    if names <= MOST_NAMES and letters <= MOST_LETTERS:  # else every word of every text is moved to meet them
        size = F.broadcast(size)
    said = named.select("id", "name", F.explode(X.keywords(F.col("text"))).alias("word")).join(size, "word")
    own = (F.col("word") == F.col("name")).cast("long")
    out = said.groupBy("id", "name").agg((F.sum("c") - F.sum(own)).alias("deg"), (F.sum(own) > 0).alias("own"), F.collect_list("word").alias("words"))
    return out.where("deg > 0")


def out_degrees(blocks: DataFrame) -> DataFrame:
    """src, out_degree of the blocks that point to another."""
    return mentions(blocks).select(F.col("id").alias("src"), F.col("deg").alias("out_degree"))


def _factors(degree, damping: float, iterations: int):
    """How many powers of damping / degree count: those after them are under 1e-30,
    beside a rank of 0.15 / n at least, and change no double."""
    if damping <= 0:
        return F.lit(0)
    few = F.least(F.lit(iterations), F.ceil(FAINT / (F.log(degree) - math.log(damping))))
    return F.when(degree > damping, few).otherwise(iterations).cast("int")


def pagerank(blocks: DataFrame, iterations: int = 100, damping: float = 0.85, every: int = 25) -> DataFrame:
    """id, pr of blocks(id, name, text) after a fixed number of iterations; the
    mass of blocks that point nowhere is not handed on.

    With x the rank that a block of a name would have if it did not say the name
    itself, one that does, and points to g blocks, has x - damping / g * (its rank
    before). So its rank is a sum of powers of -damping / g times the x of the
    steps before, and what all blocks of a name give to a word is a sum over these x
    alone, with factors that stay the same. An entry (name, word, factors) holds
    them, whatever the number of blocks and degrees behind it; a name's row of the
    frame holds its last x, newest first, as many as its blocks need. Entries lie in
    memory dealt by name and never move; a step shuffles one sum for each task and
    name. A name with more than ``HOT`` entries is dealt in shares. The lineage is cut
    every few iterations, and older tables go.
    """
    nodes = blocks.select("id", F.coalesce("name", F.lit("")).alias("name"))
    n = nodes.count()
    if n == 0 or iterations == 0:
        return nodes.select("id", F.lit(1.0 / max(n, 1)).alias("pr"))
    tables, base = Tables(blocks.sparkSession, "pagerank"), (1 - damping) / n
    source = tables.keep(mentions(blocks), "sources")
    g = F.when(F.col("own"), F.col("deg")).otherwise(0).alias("g")
    classes = source.select("name", g, F.explode("words").alias("word"), (1 / F.col("deg")).alias("w")).groupBy("name", "g", "word").agg(F.sum("w").alias("w"))
    most = F.when(F.col("g") > 0, _factors(F.col("g"), damping, iterations)).otherwise(0)
    powers = classes.select("name", "word", "g", "w", F.explode(F.sequence(F.lit(0), most)).alias("j"))
    power = F.when(F.col("j") == 0, F.lit(1.0)).otherwise(F.pow(-damping / F.col("g"), F.col("j")))
    factors = powers.groupBy("name", "word", "j").agg(F.sum(F.col("w") * power).alias("b"))
    entries = factors.groupBy("name", "word").agg(F.transform(F.array_sort(F.collect_list(F.struct("j", "b"))), lambda x: x["b"]).alias("b"))
    entries = tables.keep(entries, "entries")
    parts = entries.groupBy("name").agg(F.least(F.lit(SPREAD), F.ceil(F.count("*") / HOT)).cast("int").alias("parts"), (F.max(F.size("b")) - 1).alias("most"))
    parts = tables.keep(parts, "parts")
    dealt = entries.join(parts, "name").withColumn("part", F.pmod(F.xxhash64("word"), "parts").cast("int"))
    held = dealt.join(parts.select(F.col("name").alias("word"), F.col("parts").alias("to")), "word", "left")
    held = held.select("name", "part", "word", F.explode(F.sequence(F.lit(0), F.coalesce("to", F.lit(1)) - 1)).alias("to"), "b", F.lit(None).cast("int").alias("most"))
    # a row for each share of a name brings its x on to the next step
    bring = parts.select("name", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), F.col("name").alias("word"), F.lit(None).cast("array<double>").alias("b"), "most").withColumn("to", F.col("part"))
    held = tables.keep(held.unionByName(bring), "held")
    # many small steps in one job: nothing to plan again between them, hot names are dealt already
    quiet = blocks.sparkSession.newSession()
    quiet.conf.set("spark.sql.adaptive.enabled", "false")
    quiet.conf.set("spark.sql.objectHashAggregate.sortBased.fallbackThreshold", "100000")
    tasks, rows = int(blocks.sparkSession.conf.get("spark.sql.shuffle.partitions")), held.count()
    quiet.conf.set("spark.sql.shuffle.partitions", str(min(tasks, max(4, rows // PART_ROWS))))
    held = tables.read("held", quiet).repartition("name", "part").persist()
    frame = held.where("most IS NOT NULL").select("name", "part", F.array(F.lit(1.0 / n)).alias("x"))
    for i in range(iterations):
        given = held.join(frame.hint("shuffle_hash"), ["name", "part"])  # a share's rows fit in its task
        terms = F.zip_with("b", F.slice("x", F.lit(1), F.size("b")), lambda b, x: b * F.coalesce(x, F.lit(0.0)))
        v = F.when(F.col("most").isNull(), F.aggregate(terms, F.lit(0.0), lambda total, term: total + term))
        given = given.select(F.col("word").alias("name"), F.col("to").alias("part"), v.alias("v"), F.when(F.col("most").isNotNull(), F.slice("x", F.lit(1), F.col("most"))).alias("x"))
        had = F.coalesce(F.get(F.collect_list("x"), F.lit(0)), F.array().cast("array<double>"))
        frame = given.groupBy("name", "part").agg(F.concat(F.array(base + damping * F.coalesce(F.sum("v"), F.lit(0.0))), had).alias("x"))
        if (i + 1) % every == 0 or i + 1 == iterations:
            frame = tables.keep(frame, f"frame-{i}", quiet)
            tables.only("sources", "held", f"frame-{i}")
    held.unpersist()
    # the shares of a name have the same x
    frame = tables.read(f"frame-{iterations - 1}").where("part = 0").select("name", "x")
    said = source.where("own").select("id", F.col("deg").alias("g"))
    ranked = nodes.join(said, "id", "left").join(frame, "name", "left")
    series = F.aggregate(F.reverse("x"), F.lit(0.0), lambda total, x: x - damping / F.col("g") * total)
    return ranked.select("id", F.coalesce(F.when(F.col("g").isNull(), F.get("x", F.lit(0))).otherwise(series), F.lit(base)).alias("pr"))


def graph_rank(blocks: DataFrame, queries: DataFrame, k: int = 10, iterations: int = 100) -> DataFrame:
    """0.7 * share of the query's keywords in the text + 0.3 * pr * n."""
    n = blocks.count()
    rank = pagerank(blocks, iterations)
    q = queries.select("query_id", X.keywords(F.col("query")).alias("qk"))
    b = blocks.select("id", X.keywords(F.col("text")).alias("tk"))
    asked = scan.collected(q, "qk")
    if asked is not None:
        lists = [t for _, t in asked]
        b = scan.asked_places(b, lists).join(rank, "id")
        return top(scan.best_rows(b, queries, [a for a, _ in asked], k, scan.share_scorer(lists, 0.7, 0.3 * n)), k, "ast_rank")
    words = lambda c: F.coalesce(c, F.array().cast("array<string>"))
    share = F.size(F.array_intersect(words("qk"), words("tk"))) / F.greatest(F.size(words("qk")), F.lit(1))
    return top(b.join(rank, "id").crossJoin(q).select("query_id", "id", F.round(0.7 * share + 0.3 * F.col("pr") * n, 4).alias("score")), k, "ast_rank")

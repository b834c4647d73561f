"""Greedy batches over ranges of parts, and reduction to one part."""

import random
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import budget


def plain(rows, most):
    out, last, batch, used = [], (), 0, 0
    for key, seq, n in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2] or 0)):
        if (key,) != last:
            last, batch, used = (key,), 0, 0
        if used and used + (n or 0) > most:
            batch, used = batch + 1, 0
        out.append((key, seq, n or 0, batch))
        used += n or 0
    return sorted(out, key=str)


@pytest.mark.parametrize("most, biggest", [(10, 14), (50, 9), (1, 3), (1000, 5)])
def test_equals_a_running_sum_that_restarts(spark, most, biggest):
    rng = random.Random(most)
    rows = [(1, i, rng.randint(0, biggest)) for i in range(400)] + [(k, i, rng.choice([0, 0, 1, biggest, None])) for k in range(2, 12) for i in range(rng.randint(1, 40))]
    rows += [(None, i, rng.randint(0, 3)) for i in range(60)] + [(20, i, 0) for i in range(50)] + [(21, i, most + 1) for i in range(50)]
    rng.shuffle(rows)
    d = spark.createDataFrame([(*r, "x") for r in rows], "key long, seq int, tokens int, batch string")
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # so that keys reach into further ranges
    try:
        out = sorted((tuple(r) for r in budget.greedy_batches(d, most).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert out == plain(rows, most)


def test_one_key_of_a_million_parts(spark):
    d = spark.range(1_000_000).select(F.lit("k").alias("key"), F.col("id").alias("seq"), (F.col("id") % 97 + 1).alias("tokens"))
    began = time.time()
    out = budget.greedy_batches(d, 6000).groupBy("batch").agg(F.sum("tokens").alias("t"), F.min("seq").alias("a"), F.max("seq").alias("b"), F.count("*").alias("n")).orderBy("batch").collect()
    assert time.time() - began < 120
    assert [r.batch for r in out] == list(range(len(out))) and out[0].a == 0 and out[-1].b == 999_999
    for r, s in zip(out, out[1:], strict=False):
        assert r.n == r.b - r.a + 1 and s.a == r.b + 1 and r.t <= 6000 < r.t + s.a % 97 + 1


def test_reduction_ends_in_one_part_or_says_so(spark):
    parts = spark.createDataFrame([(1, i, 10, f"w{i}") for i in range(300)] + [(2, 0, 5, "solo")], "key long, seq long, tokens long, text string")

    def first_word(d):
        return d.select("key", F.col("batch").cast("long").alias("seq"), F.lit(10).cast("long").alias("tokens"), F.split("text", "\n")[0].alias("text"))

    out = {r.key: r.text for r in budget.tree_reduce(parts, first_word, 20).collect()}
    assert out == {1: "w0", 2: "solo"}
    with pytest.raises(RuntimeError):
        budget.tree_reduce(parts, lambda d: first_word(d).withColumn("tokens", F.lit(100).cast("long")), 20)
    assert budget.tree_reduce(parts.limit(0), first_word, 20).collect() == []

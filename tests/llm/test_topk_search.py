import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import topk_search as T

SCHEMA = "vec_id long, embedding array<float>, label int, id string, v int"


def brute(rows, queries, k):
    out = set()
    for q, x in rows:
        if q in queries:
            scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in rows if i != q)
            out |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:k])}
    return out


def search(spark, rows, every=10, k=10):
    d = spark.createDataFrame([(i, x, 0, "clash", 1) for i, x in rows], SCHEMA)
    v = d.select(F.col("vec_id").alias("id"), T.quantised(F.col("embedding")).alias("v")).where("v IS NOT NULL")
    return {(r.query_id, r["rank"], r.vec_id, r.score) for r in T.top_k(spark, v, v.where(f"id % {every} = 0"), k).collect()}


def quant(x):
    return [int(np.floor(1024 * float(np.float32(a)))) for a in x]


def test_matches_brute_force_with_ties_and_blocks(spark, monkeypatch):
    monkeypatch.setattr(T, "BLOCK_ROWS", 40)
    monkeypatch.setattr(T, "QUERY_ROWS", 7)
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=12).round(3).tolist()) for i in range(150)]
    rows += [(150 + i, rows[3][1]) for i in range(60)]  # one vector, many times
    want = brute([(i, quant(x)) for i, x in rows], {i for i, _ in rows if i % 10 == 0}, 10)
    assert search(spark, rows) == want


def test_vectors_that_take_no_part(spark):
    rows = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (2, None), (3, [1.0, None]), (4, [float("nan"), 1.0]), (5, [float("inf"), 0.0]), (6, []), (7, [1.0]), (10, [-1.0, -1.0])]
    got = search(spark, rows, every=10, k=3)
    clean = [(0, [1.0, 2.0]), (1, [0.5, 0.5]), (6, []), (7, [1.0]), (10, [-1.0, -1.0])]
    pad = [(i, (quant(x) + [0, 0])[:2]) for i, x in clean]
    assert got == brute(pad, {0, 10}, 3)


def test_few_or_no_rows(spark):
    assert search(spark, [(0, [1.0])]) == set()
    assert search(spark, [(0, [1.0]), (1, [2.0])]) == {(0, 1, 1, 2048 * 1024)}
    empty = spark.createDataFrame([], "id long, v array<bigint>")
    assert T.top_k(spark, empty, empty).count() == 0


def test_large_components_are_exact(spark):
    big = 1 << 40
    v = spark.createDataFrame([(0, [big, 1]), (1, [3, big]), (2, [3, big - 1])], "id long, v array<bigint>")
    got = [(r.vec_id, r.score) for r in T.top_k(spark, v, v.where("id = 0"), 2).orderBy("rank").collect()]
    assert got == [(1, 3 * big + big), (2, 3 * big + big - 1)]

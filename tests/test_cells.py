"""The inverted file against a plain scan: clustered vectors, odd vectors, ties."""

import math
import random

import pytest

from lodestone.operators import cells, evaluate, scan, vector
from lodestone.operators.cells import Cells


def plain(rows, queries, k, prefix=""):
    out = set()
    for q, a in queries:
        scored = []
        for i, b, path in rows:
            if not path.startswith(prefix):
                continue
            s = 0.5
            if a and b and len(a) == len(b) and any(a) and any(b):
                cos = sum(x * y for x, y in zip(a, b, strict=True)) / math.sqrt(sum(x * x for x in a) * sum(x * x for x in b))
                s = round(min(max((1 + cos) / 2, 0), 1), 4)
            scored.append((-s, i))
        out |= {(q, i, -s, n + 1) for n, (s, i) in enumerate(sorted(scored)[:k])}
    return out


def clustered(seed, n=500, dim=8):
    rng = random.Random(seed)
    centres = [[rng.gauss(0, 1) for _ in range(dim)] for _ in range(12)]
    rows = []
    for i in range(n):
        c = rng.choice(centres)
        rows.append((3 * i, [x + rng.gauss(0, 0.15) for x in c], f"p{i % 3}/f"))
    odd = [(10_001, None, "p0/f"), (10_002, [], "p1/f"), (10_003, [0.0] * dim, "p0/f"), (10_004, [1.0, 2.0], "p2/f"), (-5, [1.0, -2.0], "p0/f")]
    rows += odd + [(20_000 + j, rows[7][1], "p0/f") for j in range(5)]
    rng.shuffle(rows)
    return rows, [(i, v) for i, v, _ in rows if i % 20 == 0] + [(50_001, None), (50_002, [0.0] * dim), (50_003, [1.0, 2.0]), (50_004, [1.0] * 3)]


@pytest.mark.parametrize("block, first", [(4096, 512), (16, 20)])
def test_equals_the_scan_and_skips(spark, tmp_path, monkeypatch, block, first):
    monkeypatch.setattr(cells, "BLOCK_ROWS", block)
    monkeypatch.setattr(cells, "BLOCK_QUERIES", block)
    monkeypatch.setattr(cells, "FIRST_ROWS", first)
    rows, queries = clustered(block)
    v = spark.createDataFrame(rows, "id long, vector array<double>, filepath string")
    q = spark.createDataFrame(queries, "query_id long, vector array<double>")
    index, read = Cells.build(v, str(tmp_path / "c")), []
    assert int(index.shells["n"].sum()) == len(rows)
    take = lambda d: {(r.query_id, r.id, r.score, r["rank"]) for r in d.collect()}
    assert take(vector.nearest(v, q, 4, index=index)) == plain(rows, queries, 4)
    assert take(vector.nearest(v, q, 4, prefix="p1/", index=index)) == plain(rows, queries, 4, "p1/")
    index.search(q.where("query_id < 10000"), 4, read=read).collect()
    scored, every = sum(r[1] for r in read), read[0][2]
    assert 0 < scored <= every and (first > 20 or scored < 0.5 * every)
    monkeypatch.setattr(scan, "MOST_QUERIES", 3)  # without an index: blocks against blocks
    monkeypatch.setattr(scan, "PAIR_ROWS", 100)
    assert take(vector.nearest(v, q, 4)) == plain(rows, queries, 4)


def test_dimensions_that_the_sample_lacks_and_no_vectors(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(cells, "SAMPLE", 1)
    rows = [(i, [float(i), 1.0] if i % 2 else [1.0, float(i), 2.0], "x") for i in range(30)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, filepath string")
    q = [(1, [3.0, 1.0]), (2, [1.0, 4.0, 2.0])]
    index = Cells.build(v.drop("filepath"), str(tmp_path / "d"))
    got = {(r.query_id, r.id, r.score, r["rank"]) for r in vector.nearest(v, spark.createDataFrame(q, "query_id long, vector array<double>"), 5, index=index).collect()}
    assert got == plain(rows, q, 5)
    none = Cells.build(v.limit(0), str(tmp_path / "e"))
    assert vector.nearest(v.limit(0), spark.createDataFrame(q, "query_id long, vector array<double>"), 5, index=none).collect() == []


def test_means_of_all_pairs_without_pairs(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(4)], rng.choice(["a", "b", None])) for i in range(60)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, label string")
    q = v.where("id % 7 = 0").withColumnRenamed("id", "query_id")
    pairs = {True: [], False: []}
    for i, a, la in rows:
        for j, b, lb in rows:
            if j % 7 == 0 and la and lb:
                ((_, _, s, _),) = plain([(i, a, "")], [(j, b)], 1)
                pairs[la == lb].append(s)
    monkeypatch.setattr(scan, "PAIR_ROWS", 13)
    r = evaluate.gap_of_means(vector.score_means(v, q, "label")).first()
    a, b = (sum(pairs[x]) / len(pairs[x]) for x in (True, False))
    assert (r.relevant_mean, r.other_mean, r.gap) == (round(a, 4), round(b, 4), round(a - b, 4))


def test_groups_over_a_union_stay_whole(spark):
    """Two ranked frames, dealt by the query, are put together and ranked again."""
    from pyspark.sql import functions as F
    from pyspark.sql.window import Window as W

    from lodestone.sources.scratch import sound

    sound(spark)
    assert spark.conf.get("spark.sql.unionOutputPartitioning") == "false"
    rng = random.Random(3)
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(500)], "id long, vector array<double>")
    q = v.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    both = vector.nearest(v.where("id % 2 = 0"), q, 2).unionByName(vector.nearest(v.where("id % 2 <> 0"), q, 2))
    arms = None
    for less in (0.0, 0.05):
        w = W.partitionBy("query_id").orderBy(F.desc("s"), "id")
        best = both.where("id <> query_id").withColumn("s", F.col("score") - less * (F.col("id") % 2)).withColumn("r", F.row_number().over(w)).where("r = 1").select(F.lit(less).alias("arm"), "query_id")
        arms = best if arms is None else arms.unionByName(best)
    assert {r["count"] for r in arms.groupBy("arm", "query_id").count().collect()} == {1} and arms.count() == 50


def test_a_query_goes_to_a_segment_once_however_many_shells_it_holds(spark, tmp_path, monkeypatch):
    """Random directions: bounds skip nothing, and what is moved must not grow with queries times shells."""
    monkeypatch.setattr(cells, "BLOCK_ROWS", 200)
    rng = random.Random(5)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)], "p") for i in range(600)]
    v = spark.createDataFrame(rows, "id long, vector array<double>, filepath string")
    index = Cells.build(v, str(tmp_path / "s"))
    asked = spark.createDataFrame([(i, x, None) for i, x, _ in rows[:30]], "query_id long, vector array<double>, cutoff double")
    assert len(index.shells) > 20 and index._pairs(asked, 4, 1, False).count() <= 30 * 6
    assert not (tmp_path / "s" / "raw").exists()


@pytest.mark.parametrize("n, dim, most", [(1_000, 64, 8), (100_000, 64, 70), (1_500_000, 64, 70), (600_000, 1024, 300)])
def test_segments_stay_as_many_while_vectors_grow(n, dim, most):
    """A query goes to each segment: their number must not grow with the table, nor a segment beyond what a task holds."""
    rng = random.Random(n)
    sizes = [rng.randint(1, 40) for _ in range(n // 25)] + [n // 5]
    first, blocks = cells._segments(cells.np.full(len(sizes), dim), cells.np.array(sizes))
    held = {}
    for s, b, size in zip(first, blocks, sizes, strict=True):
        for i in range(b):
            held[s + i] = held.get(s + i, 0) + size / b
    assert len(held) <= most and max(held.values()) * dim <= 1 << 22

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from lodestone.llm import pairwise_quality as P

SCHEMA = "doc_id long, text string, score string, quality string"


def docs(n=600, seed=8):
    rng = random.Random(seed)
    words = ["the", "of", "and", "house", "river", "walked", "garden", "window", "stone", "évite", "morning", "quiet"]
    out, labels = [], []
    for i in range(n):
        w = [rng.choice(words) for _ in range(rng.randint(20, 200))]
        good = i % 3 > 0
        if good:
            text = ". ".join(" ".join(w[j : j + 9]).capitalize() for j in range(0, len(w), 9)) + "."
        else:
            text = [lambda: " ".join(x + rng.choice(["###", "&&&"]) for x in w), lambda: " ".join([w[0]] * 40), lambda: " ".join(w).upper() + "!!"][i // 3 % 3]()
        out.append((i, text))
        labels.append((i, int(good)))
    return out, labels


def test_held_out_accuracy(spark):
    rows, labels = docs()
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    lab = spark.createDataFrame(labels, "doc_id long, quality int")
    model = P.train(spark, d, lab.where(~P.held_out(F.col("doc_id"))))
    out = {r.doc_id: r.score for r in P.score(spark, d, model).collect()}
    held = [(i, q) for i, q in labels if zlib.crc32(str(i).encode()) % 4 == 2]
    assert len(held) > 100
    assert np.mean([(out[i] >= P.CUT) == bool(q) for i, q in held]) > 0.97
    again = P.train(spark, d.repartition(5), lab.where(~P.held_out(F.col("doc_id"))))
    assert np.allclose(again["w"], model["w"]) and again["cut"] == model["cut"]


def test_odd_rows(spark):
    rows, labels = docs(60)
    rows = [*rows, (900, None), (901, ""), (902, " \n"), (903, "w" * 200_000), (904, "one"), rows[0], (None, "no id")]
    d = spark.createDataFrame([(i, t, "x", "y") for i, t in rows], SCHEMA)
    lab = spark.createDataFrame([*labels, (5000, 1), (None, 0), (901, None), (0, 0)], "doc_id long, quality int")
    out = P.score(spark, d, P.train(spark, d, lab)).collect()
    assert len(out) == len(rows) and all(0 <= r.score <= 1 for r in out)
    assert len({r.score for r in out if r.doc_id == 0}) == 1


def test_one_kind_or_nothing_to_learn_from(spark):
    d = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    for labels in ([(1, 1)], []):
        model = P.train(spark, d, spark.createDataFrame(labels, "doc_id long, quality int"))
        assert model is None and {r.score for r in P.score(spark, d, model).collect()} == {0.5}
    assert P.score(spark, d.limit(0), None).count() == 0


def test_words_alone_can_tell(spark):
    """Texts of one shape that differ in their words only."""
    rng = random.Random(4)
    good, poor = ["river", "garden", "window", "stone"], ["casino", "jackpo", "winner", "pills"]
    rows = [(i, " ".join(rng.choice((good if i % 2 else poor) + ["house", "morning"]) for _ in range(60))) for i in range(400)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    model = P.train(spark, d, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, quality int"))
    out = {r.doc_id: r.score for r in P.score(spark, d, model).collect()}
    assert np.mean([(out[i] >= P.CUT) == bool(i % 2) for i in range(200, 400)]) > 0.98


def test_fit_orders_by_preference():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 4))
    y = (x @ np.array([2.0, -1.0, 0.0, 0.5]) + rng.normal(size=500) * 0.1 > 0).astype(int)
    m = P.fit(x, y, pairs=20_000)
    assert m["accuracy"] > 0.95 and m["w"][0] > 0 > m["w"][1]

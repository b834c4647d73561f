"""Exact entries of sorted values, and parse results that are kept by content."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import metrics
from lodestone.plans.engine import Engine
from lodestone.plans.profiles import Settings
from lodestone.sources import parsing
from lodestone.sources.store import BlockStore


@pytest.mark.parametrize("accuracy", [10_000, 100])
def test_entries_are_exact(spark, accuracy):
    rng = random.Random(accuracy)
    rows = [(k, rng.choice([float(rng.randint(0, 40)), rng.gauss(0, 9), None])) for k in ("a", "b", None) for _ in range(4000)] + [("c", 1.0)] * 900 + [("d", 5.0), ("e", None)]
    d = spark.createDataFrame(rows, "k string, value double")
    held = {}
    for k, v in rows:
        if v is not None:
            held.setdefault(k, []).append(v)
    want = {(k, len(v), sorted(v)[len(v) // 2], sorted(v)[len(v) * 95 // 100], sorted(v)[0], sorted(v)[-1]) for k, v in held.items()}
    n = F.col("count")
    out = metrics.entries_at(d, "k", "value", {"m": F.floor(n / 2), "h": F.floor(n * 95 / 100), "first": n - n, "last": n - 1}, accuracy)
    assert {(r.k, r["count"], r.m, r.h, r.first, r.last) for r in out.select("k", "count", "m", "h", F.col("first").alias("first"), "last").collect()} == want


def test_cold_and_warm(spark):
    rows = [("s", q, t, float(10 * q + t)) for q in range(5) for t in range(4)] + [("s", None, 0, 7.0), ("s", None, 1, 8.0), ("s", 9, 0, None)]
    d = spark.createDataFrame(rows, "kind string, query long, t long, value double")
    out = {(r.kind, r.phase): (r["count"], r.p50, r.p95) for r in metrics.cold_and_warm(d, "kind", "query", ["t"]).collect()}
    cold, warm = sorted([0, 10, 20, 30, 40, 7]), sorted([10 * q + t for q in range(5) for t in (1, 2, 3)] + [8])
    assert out == {("s", "cold"): (6, cold[2], cold[4]), ("s", "warm"): (16, warm[7], warm[14])}


def test_unseen_texts_only_are_parsed(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for name, text in (("a.py", "def one(x):\n    return x\n"), ("b.py", "def two(x):\n    return x\n"), ("copy.py", "def one(x):\n    return x\n"), ("bad.py", "def broken(:\n")):
        (root / name).write_text(text)
    engine = Engine(spark, BlockStore(spark, str(tmp_path / "store")), Settings(profile="python"))
    engine.index_tree(str(root), "p")
    assert engine.parsed == 3  # the copy is one of the others
    first = {(r.id, r.code) for r in engine.store.read("p").collect()}
    assert {i.split(":")[0] for i, _ in first} == {"a.py", "b.py", "bad.py", "copy.py"}
    engine.index_tree(str(root), "p")
    assert engine.parsed == 0 and {(r.id, r.code) for r in engine.store.read("p").collect()} == first
    engine.index_tree(str(root), "other")  # another project shares them
    assert engine.parsed == 0 and engine.store.count("other") == len(first)
    (root / "b.py").write_text("def three(x):\n    return x\n")
    engine.index_tree(str(root), "p")
    assert engine.parsed == 1 and "three" in {r.function for r in engine.store.read("p").collect()}


def test_null_texts_and_equal_paths(spark, tmp_path):
    d = spark.createDataFrame([("x.py", "def a(): pass"), ("x.py", "def b(): pass"), ("y.py", None), ("z.js", "def a(): pass")], "filepath string, text string")
    done, n = parsing.parse_unseen(d, str(tmp_path / "k"))
    got = sorted((r.filepath, tuple(f.name for f in r.functions), r.error) for r in done.collect())
    plain = sorted((r.filepath, tuple(f.name for f in r.functions), r.error) for r in parsing.parse_files(d).collect())
    assert got == plain and n == 4
    assert parsing.parse_unseen(d, str(tmp_path / "k"))[1] == 0
    assert parsing.parse_unseen(d.limit(0), str(tmp_path / "empty"))[0].collect() == []

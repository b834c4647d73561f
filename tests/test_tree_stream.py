"""A tree's changes as a stream, deletions included; store metadata that stays small."""

import json
import os
import time

import pytest

from lodestone.sources import listing
from lodestone.sources.store import BlockStore, MemoryStore
from lodestone.streaming import watch

BLOCK = "id string, filepath string, function string, code string, line_start int, line_end int, project_id string"


def block(i, f="a.py", code="x", p="p1"):
    return (i, f, "f", code, 1, 2, p)


def put(root, name, text):
    at = root / name
    at.parent.mkdir(parents=True, exist_ok=True)
    at.write_text(text)
    os.utime(at, ns=(put.clock, put.clock))
    put.clock += 10**9


put.clock = 1_700_000_000 * 10**9


def test_added_modified_deleted_and_restart(spark, tmp_path):
    root, state = tmp_path / "tree", str(tmp_path / "state")
    for name, text in (("a.py", "def a(): pass"), ("sub/b.py", "def b(): pass"), ("c.txt", "no"), ("skip/d.py", "def d(): pass")):
        put(root, name, text)
    store = BlockStore(spark, str(tmp_path / "store"))

    def parse(d):
        return d.selectExpr("filepath AS id", "filepath", "'f' AS function", "text AS code", "1 AS line_start", "1 AS line_end", "'p' AS project_id")

    def run():
        """Each run is a stream of its own, going on from the checkpoint."""
        stream = listing.tree_changes(spark, str(root), state, ["*.py"], ["skip/**"])
        q = watch.maintain(stream, store, parse, str(tmp_path / "checkpoint"), project="p")
        assert q.awaitTermination(180)
        return {r.filepath: r.code for r in store.read().collect()}

    assert run() == {"a.py": "def a(): pass", "sub/b.py": "def b(): pass"}
    os.remove(root / "a.py")
    put(root, "sub/b.py", "def b2(): pass")
    put(root, "e.py", "def e(): pass")
    assert run() == {"sub/b.py": "def b2(): pass", "e.py": "def e(): pass"}
    versions = store.versions()
    assert run() == {"sub/b.py": "def b2(): pass", "e.py": "def e(): pass"} and store.versions() == versions  # nothing changed
    assert len([f for f in os.listdir(state) if f.endswith(".parquet")]) <= 2  # listings behind the stream went


def test_differences_of_listings(tmp_path):
    root = tmp_path / "t"
    put(root, "x/one", "1")
    put(root, "two", "2")
    r = listing._Reader({"path": str(root), "state": str(tmp_path / "s")})
    first = r.latestOffset()
    assert first == {"listing": 1} and r.latestOffset() == first
    os.remove(root / "two")
    put(root, "x/one", "11")
    put(root, "three", "é")
    second = r.latestOffset()
    rows = lambda a, b: [(p, t, c) for part in r.partitions(a, b) for p, t, c, _ in r.read(part)]
    assert rows(first, second) == [("three", "é", "added"), ("two", None, "deleted"), ("x/one", "11", "modified")]
    assert rows(r.initialOffset(), second) == [("three", "é", "added"), ("x/one", "11", "added")]
    os.remove(root / "three")
    assert rows(first, second)[0] == ("three", None, "deleted")  # went after it was listed
    r.commit(second)
    assert r._numbers() == [2] and rows(second, second) == []


@pytest.mark.parametrize("kind", ["parquet", "memory"])
def test_changes_without_a_project(spark, tmp_path, kind):
    store = BlockStore(spark, str(tmp_path / "s")) if kind == "parquet" else MemoryStore(spark)
    frame = lambda *rows: spark.createDataFrame(list(rows), BLOCK)
    feed = spark.createDataFrame([("a.py", "modified"), ("b.py", "deleted")], "filepath string, change string")
    store.upsert(frame(block("1"), block("2", "b.py"), block("3", "c.py")))
    store.apply_changes(frame(block("9", code="new")), feed, None)
    assert {(r.id, r.code, r.project_id) for r in store.read().collect()} == {("9", "new", "p1"), ("3", "x", "p1")}
    store.upsert(frame(block("1", p="p2")))
    with pytest.raises(ValueError):
        store.apply_changes(frame(block("9")), feed, None)
    store.apply_changes(frame(block("7", p="p2")), feed, "p2")
    assert {(r.project_id, r.id) for r in store.read().collect()} == {("p1", "9"), ("p1", "3"), ("p2", "7")}


def test_manifests_stay_small_and_old_versions_go(spark, tmp_path):
    store = BlockStore(spark, str(tmp_path / "s"))
    frame = lambda *rows: spark.createDataFrame(list(rows), BLOCK)
    store.upsert(frame(*(block("1", p=f"p{i}") for i in range(20))))
    folders = store.manifest()["folders"]
    for n in range(2, 1001):  # as 999 further writes would: a manifest each
        store._publish(n - 1, {"current": f"v={n}", "folders": folders, "schema": 3, "meta": {}})
    held = tmp_path / "s" / "manifests"
    assert len(store.versions()) == 1000 and max(os.path.getsize(held / f) for f in os.listdir(held)) < 10_000
    began = time.time()
    assert store.snapshot() == "v=1000" and time.time() - began < 10
    store.upsert(frame(block("1", code="new", p="p0")))
    store.restore("v=2")
    assert store.snapshot() == "v=2" and store.read("p0").first().code == "x"
    assert len(store.retain(2, grace=0)) == 998
    assert store.versions() == ["v=2", "v=1000", "v=1001"] and store.count() == 20
    store.restore("v=1001")
    assert store.read("p0").first().code == "new" and store.count() == 20
    store.retain(1, grace=0)
    assert store.versions() == ["v=1001"] and store.count() == 20
    store.upsert(frame(block("2", p="p0")))
    assert store.snapshot() == "v=1004" and store.count("p0") == 2
    assert json.loads((held / "000001004.json").read_text())["folders"].keys() == folders.keys()

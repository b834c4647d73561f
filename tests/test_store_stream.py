import datetime as dt

import pytest
from pyspark.sql import functions as F

from lodestone.operators import caches, memory, metrics
from lodestone.sources import files, parsing
from lodestone.sources.store import BlockStore
from lodestone.streaming import watch

BLOCK = "id string, filepath string, function string, code string, line_start int, line_end int, project_id string"


def block(i, f="a.py", code="x", p="p1"):
    return (i, f, "f", code, 1, 2, p)


@pytest.fixture
def store(spark, tmp_path):
    return BlockStore(spark, str(tmp_path / "store"))


def test_upsert_delete_versions(spark, store):
    frame = lambda *rows: spark.createDataFrame(list(rows), BLOCK)
    assert store.count() == 0 and store.snapshot() is None and not store.is_stale()
    v1 = store.upsert(frame(block("1"), block("2", "b.py"), block("1", code="y", p="p2")))
    store.upsert(frame(block("2", "b.py", "new"), block("3", "c.py")))
    assert {(r.project_id, r.id, r.code) for r in store.read().collect()} == {("p1", "1", "x"), ("p1", "2", "new"), ("p1", "3", "x"), ("p2", "1", "y")}
    store.delete_files(frame(block("_", "a.py")), "p1")
    assert {(r.project_id, r.id) for r in store.read().collect()} == {("p1", "2"), ("p1", "3"), ("p2", "1")}
    store.restore(v1)
    assert store.count("p1") == 2 and store.count() == 3 and len(store.versions()) == 3
    store.clear("p1")
    assert store.count("p1") == 0 and store.count() == 1
    with pytest.raises(ValueError):
        store.restore("v=99")


def test_change_feed(spark):
    old = spark.createDataFrame([("a", "1"), ("b", "1"), ("c", "1")], "filepath string, text string")
    new = spark.createDataFrame([("a", "1"), ("b", "2"), ("d", "1")], "filepath string, text string")
    assert {(r.filepath, r.change) for r in files.changes(old, new).collect()} == {("b", "modified"), ("c", "deleted"), ("d", "added")}


def test_debounce_in_batch_and_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    rows = [("a", t0 + dt.timedelta(milliseconds=m)) for m in (0, 200, 400, 2000)] + [("b", t0), ("z", t0 + dt.timedelta(hours=1))]
    d = spark.createDataFrame(rows, "filepath string, ts timestamp")
    want = {(r.filepath, r.events) for r in watch.debounce(d).collect()}
    assert want == {("a", 3), ("a", 1), ("b", 1), ("z", 1)}
    d.write.parquet(str(tmp_path / "in"))
    s = watch.debounce(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")))
    q = s.writeStream.format("memory").queryName("bursts").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert {(r.filepath, r.events) for r in spark.table("bursts").collect()} == {("a", 3), ("a", 1), ("b", 1)}  # z still waits


def test_index_follows_a_stream(spark, store, tmp_path):
    t = dt.datetime(2024, 1, 1)
    schema = "filepath string, text string, change string, ts timestamp"
    spark.createDataFrame([("a.py", "def one():\n    pass\n", "added", t), ("b.py", "def two():\n    pass\n", "added", t)], schema).write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    parse = lambda d: parsing.blocks(parsing.parse_files(d)).drop("method").withColumn("project_id", F.lit("p"))
    watch.maintain(stream(), store, parse, str(tmp_path / "cp")).awaitTermination(120)
    assert {r.function for r in store.read().collect()} == {"one", "two"}
    spark.createDataFrame([("a.py", "\n\ndef uno():\n    pass\n", "modified", t), ("b.py", None, "deleted", t)], schema).write.mode("append").parquet(str(tmp_path / "in"))
    watch.maintain(stream(), store, parse, str(tmp_path / "cp")).awaitTermination(120)
    assert [(r.function, r.line_start) for r in store.read().collect()] == [("uno", 3)]


def test_caches(spark):
    t = dt.datetime(2024, 1, 1)
    at = lambda s: t + dt.timedelta(seconds=s)
    rows = [("k", at(0), 1), ("k", at(5), 2), ("k", at(10), 3), ("k", at(11), 4), ("k", at(100), 5), ("j", at(1), 6)]
    out = {r.event_id: r.hit for r in caches.replay(spark.createDataFrame(rows, "key string, ts timestamp, event_id long"), 10).collect()}
    assert out == {1: False, 2: True, 3: True, 4: False, 5: False, 6: False}
    e = spark.createDataFrame([("a", 1, at(0)), ("b", 2, at(50))], "key string, value int, ts timestamp")
    assert [r.key for r in caches.unexpired(e, F.lit(at(60)), 30).collect()] == ["b"]
    assert [r.key for r in caches.evict(e, 1).collect()] == ["b"]


def test_ttl_cache_stream(spark, tmp_path):
    t = dt.datetime(2024, 1, 1)
    rows = [("k", t + dt.timedelta(seconds=s), str(s)) for s in (0, 5, 20)] + [("j", t, "x")]
    d = spark.createDataFrame(rows, "key string, ts timestamp, value string")
    d.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    s = watch.cached(spark.readStream.schema(d.schema).parquet(str(tmp_path / "in")), 10)
    q = s.writeStream.format("memory").queryName("hits").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.key, r.hit, r.value) for r in spark.table("hits").collect()) == [("j", False, "x"), ("k", False, "0"), ("k", False, "20"), ("k", True, "0")]


def test_memory_log(spark):
    t = dt.datetime(2024, 1, 1, 10, 30)
    log = spark.createDataFrame([(1, t + dt.timedelta(minutes=i), i, f"note {i}\nmore") for i in range(12)], "log_id long, ts timestamp, seq long, note string")
    lines = memory.entry(log)
    assert lines.orderBy("seq").first().line == "[2024-01-01 10:30] note 0 more"
    assert memory.rotate(log, 3).count() == 3
    assert memory.tail(lines, 2).first().text.split("\n")[1] == "[2024-01-01 10:41] note 11 more"
    assert memory.tail(lines, 5, 1).first().text == "[202"
    out = memory.compact(log, 10).orderBy("seq").collect()
    assert len(out) == 3 and "10 entries" in out[0].note


def test_percentiles_take_lower_places(spark):
    d = spark.createDataFrame([("a", float(x)) for x in range(1, 11)] + [("a", 1.0)], "k string, value double")
    r = metrics.latency_summary(d, "k").first()
    assert (r["count"], r.p50, r.p95, r.min, r.max) == (11, 5.0, 9.0, 1.0, 10.0)


def test_file_stream(spark, tmp_path):
    (tmp_path / "in" / "sub").mkdir(parents=True)
    (tmp_path / "in" / "sub" / "a.py").write_text("x = 1")
    (tmp_path / "in" / "b.md").write_text("no")
    q = watch.file_stream(spark, str(tmp_path / "in"), "*.py").writeStream.format("memory").queryName("seen").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.filepath.endswith("in/sub/a.py"), r.text) for r in spark.table("seen").collect()] == [(True, "x = 1")]


def test_a_delta_leaves_other_projects(spark, store):
    frame = lambda *rows: spark.createDataFrame(list(rows), BLOCK)
    store.upsert(frame(block("1"), block("2", "b.py"), block("1", code="other", p="p2"), block("3", "c.py", p="p 3/ü")))
    before = store._folders()
    feed = lambda *rows: spark.createDataFrame(list(rows), "filepath string, change string")
    with pytest.raises(ValueError):
        store.apply_changes(frame(block("9")), feed(("a.py", "modified")))
    store.apply_changes(frame(block("9")), feed(("a.py", "modified"), ("b.py", "deleted")), "p1")
    assert {(r.project_id, r.id) for r in store.read().collect()} == {("p1", "9"), ("p2", "1"), ("p 3/ü", "3")}
    after = store._folders()
    assert after["p2"] == before["p2"] and after["p 3/ü"] == before["p 3/ü"] and after["p1"] != before["p1"]  # only p1 was written
    named = spark.createDataFrame([("a.py", "deleted", "p2")], "filepath string, change string, project_id string")
    store.apply_changes(frame(block("x")).limit(0), named)
    assert store.projects() == ["p 3/ü", "p1"] and store.read("p 3/ü").count() == 1


def test_two_writers_of_one_version(spark, store):
    from lodestone.sources.store import ConcurrentWrite

    rows = spark.createDataFrame([block("1")], BLOCK)
    store.upsert(rows)
    base = store._number()
    store.upsert(spark.createDataFrame([block("2")], BLOCK))
    with pytest.raises(ConcurrentWrite):
        store._commit(store._stored(rows), ["p1"], base)
    assert store.count() == 2


def test_bytes_that_are_no_text(spark, tmp_path):
    (tmp_path / "good.py").write_text("def fine():\n    return 1\n")
    (tmp_path / "bad.py").write_bytes(b"def odd():\n    return '\xff\xfe'\n")
    rows = files.read_files(spark, str(tmp_path), ["*.py"])
    found = {r.function: r.code for r in parsing.blocks(parsing.parse_files(rows)).collect()}
    assert set(found) == {"fine", "odd"} and "\ufffd" in found["odd"]
    stream = watch.file_stream(spark, str(tmp_path), "*.py")
    q = stream.writeStream.format("memory").queryName("bytes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted("\ufffd" in r.text for r in spark.table("bytes").collect()) == [False, True]

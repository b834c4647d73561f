"""Notices that come due by timers, over a restart from the checkpoint."""

import datetime as dt
import time

from lodestone.streaming import periodic


def test_told_once_an_interval_over_a_restart(spark, tmp_path):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    schema, told = "key string, ts timestamp, note string", []
    t = dt.datetime(2024, 1, 1)
    put = lambda *rows: spark.createDataFrame([(k, t + dt.timedelta(seconds=s), n) for k, s, n in rows], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    def start():
        stream = periodic.due(spark.readStream.schema(schema).parquet(str(tmp_path / "in")), 8)
        return periodic.act(stream, lambda b: told.extend((r.key, r.at, r.notices, r.note) for r in b.collect()), str(tmp_path / "cp"), "500 milliseconds")

    def until(enough, q):
        began = time.time()
        while not enough() and time.time() - began < 150:
            assert q.exception() is None
            time.sleep(0.5)

    put(("a", 1, "one"), ("a", 2, "two"), ("b", 1, "other"))
    q = start()
    until(lambda: len(told) >= 2, q)
    assert {(k, n, note) for k, _, n, note in told} == {("a", 2, "two"), ("b", 1, "other")}  # the first are told at once
    put(("a", 3, "three"), ("a", 5, "five"), ("a", 4, "four"))
    seen = q.lastProgress["batchId"] if q.lastProgress else 0
    until(lambda: any(p["numInputRows"] == 3 and p["batchId"] > seen for p in q.recentProgress[-20:]) or len(told) > 2, q)
    q.stop()
    q = start()  # the timer is in the checkpoint
    until(lambda: sum(n for k, _, n, _ in told if k == "a") >= 5, q)
    q.stop()
    a = [(at, n, note) for k, at, n, note in told if k == "a"]
    assert [(n, note) for _, n, note in a] == [(2, "two"), (3, "five")]
    assert a[1][0] - a[0][0] >= dt.timedelta(seconds=8)
    assert sum(k == "b" for k, *_ in told) == 1

import http.server
import json
import threading
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import models
from lodestone.operators import evaluate, lexical, scan, structural, vector
from lodestone.plans.engine import Engine
from lodestone.plans.jobs import Clock, Jobs, install_hook, record_changes
from lodestone.plans.profiles import Settings
from lodestone.plans.service import Service
from lodestone.sources import state
from lodestone.sources.store import BlockStore, MemoryStore, open_store
from lodestone.sources.vcs import Repository

BLOCK = "id string, filepath string, function string, code string, line_start int, line_end int, project_id string"


def rows(spark, *found):
    return spark.createDataFrame([(i, f, n, c, 1, 2, p) for i, f, n, c, p in found], BLOCK)


def some_blocks(spark):
    return rows(
        spark, ("1", "auth.py", "login", "def login(user):\n    return check_password(user)", "p1"), ("2", "auth.py", "logout", "def logout(user):\n    drop_session(user)", "p1"),
        ("3", "net.py", "fetch", "def fetch(url):\n    return get(url)", "p1"), ("4", "auth.py", "login", "def login(): password password password", "p2"), ("5", "old.py", "legacy", "def legacy(): password", None),
    )


@pytest.mark.parametrize("kind", ["parquet", "memory"])
def test_both_stores(spark, tmp_path, kind):
    s = open_store(spark, str(tmp_path / "s"), kind)
    assert isinstance(s, BlockStore if kind == "parquet" else MemoryStore) and s.count() == 0 and s.snapshot() is None
    s.upsert(some_blocks(spark))
    assert s.projects() == ["", "p1", "p2"] and s.count("p1") == 3
    feed = spark.createDataFrame([("auth.py", "modified")], "filepath string, change string")
    s.apply_changes(rows(spark, ("6", "auth.py", "enter", "x", None)), feed, "p1")
    assert {r.id for r in s.read(["p1", "p2"]).collect()} == {"3", "4", "6"}
    s.delete_files(feed, "p1")
    assert {r.id for r in s.read("p1").collect()} == {"3"}
    s.clear("p2")
    assert s.count() == 2
    s.clear()
    assert s.count() == 0
    with pytest.raises(ValueError):
        open_store(spark, "x", "other")


def test_isolation_routing_and_snapshots(spark, tmp_path):
    store = BlockStore(spark, str(tmp_path / "s"))
    store.upsert(some_blocks(spark))
    e = Engine(spark, store, Settings(profile="iac"))
    q = spark.createDataFrame([(1, "password login"), (2, "fetch url")], "query_id long, query string")
    mine = {(r.query_id, r.id) for r in e.search(q, "p1").collect()}
    assert (1, "1") in mine and (1, "5") in mine and not {i for _, i in mine} & {"4"}  # blocks of no project count as its own
    won = {(r.query_id, r.project_id): r.id for r in e.route(q, 2).collect()}
    assert won[2, "p1"] == "3" and {p for _, p in won if _ == 1} == {"p2"}
    first = e._blocks("p1")
    assert e._blocks("p1") is first
    store.upsert(rows(spark, ("7", "new.py", "fresh", "def fresh(): unheard_word", "p1")))
    found = e.search(spark.createDataFrame([(1, "unheard_word")], "query_id long, query string"), "p1")
    assert [r.id for r in found.collect()] == ["7"]


def test_fused_search_and_campaign(spark, tmp_path):
    store = BlockStore(spark, str(tmp_path / "s"))
    embed = models.embedder(lambda: models.hashed_embedder(32))
    store.upsert(embed(some_blocks(spark).where("id <> '5'").unionByName(rows(spark, ("8", "doc.py", "manual", "", "p1")))))
    e = Engine(spark, store, Settings(profile="python", least_cosine=0.0), embed)
    q = spark.createDataFrame([(1, "login password"), (2, "fetch url")], "query_id long, query string")
    out = e.fused(q, 3, "p1").collect()
    assert {(r.query_id, r.id) for r in out if r.rank == 1} >= {(2, "3")} and all(r.rerank_score is None for r in out)
    plain = Engine(spark, store, Settings(profile="iac")).fused(q, 3, "p1").collect()
    assert {r.similarity for r in plain} == {0.5}
    assert {r.id for r in e.fused(q, 3, "p1", prefix="net").collect()} == {"3"}
    gold = spark.createDataFrame([(1, "1"), (2, "3")], "query_id long, gold string")
    got = {r.strategy: r.recall for r in evaluate.campaign(Engine(spark, store, Settings(profile="iac")), q, gold).collect()}
    assert set(got) == {"bm25", "ast", "hybrid"} and got["hybrid"] == 1.0


def test_scan_and_join_agree(spark, monkeypatch):
    """The one-pass ranking against the joins that larger sets of queries take."""
    import random

    rng = random.Random(2)
    words = ["Alpha", "beta_1", "gamma", "delta", "eps", "zeta", "eta9", "theta", "über", "x.y"]
    texts = [" ".join(rng.choice(words) for _ in range(rng.randint(0, 30))) + rng.choice(["\n", " ", "\nvar.alpha_beta "]) + rng.choice(words) for _ in range(60)]
    d = spark.createDataFrame([(i, t, rng.choice(words) + "." + rng.choice(words)) for i, t in enumerate([*texts, None, ""])], "id long, text string, name string")
    q = spark.createDataFrame([(i, " ".join(rng.choice([*words, "alpha_b", "gam"]) for _ in range(rng.randint(0, 6)))) for i in range(9)], "query_id long, query string")
    v = spark.createDataFrame([(i, [rng.gauss(0, 1) for _ in range(rng.choice([4, 4, 3]))]) for i in range(40)] + [(90, []), (91, None), (92, [0.0] * 4)], "id long, vector array<double>")
    vq = v.where("id < 6").withColumnRenamed("id", "query_id")
    ways = lambda: [lexical.bm25(d, q, 5), lexical.grep(d, q, 5), structural.structural(d, q, 5), vector.nearest(v, vq, 7)]
    rows_of = lambda f: sorted((r.query_id, r["rank"], r.id, round(r.score, 6)) for r in f.collect())
    scanned = [rows_of(f) for f in ways()]
    monkeypatch.setattr(scan, "MOST_QUERIES", 1)
    assert [rows_of(f) for f in ways()] == scanned and all(scanned)
    monkeypatch.undo()
    monkeypatch.setattr(scan, "QUERY_BLOCK", 2)
    monkeypatch.setattr(scan, "ROW_BLOCK", 7)
    assert [rows_of(f) for f in ways()] == scanned
    best = scan.Best(2, __import__("pyarrow").schema([("query_id", "int64"), ("id", "int64"), ("score", "float64")]))
    best.most = 3
    import pyarrow as pa

    for i in range(10):
        best.add([pa.array([0, 1]), pa.array([i, i]), pa.array([float(i % 3), 1.0])])
    assert best.result().to_pylist() == [{"query_id": 0, "id": 2, "score": 2.0}, {"query_id": 0, "id": 5, "score": 2.0}, {"query_id": 1, "id": 0, "score": 1.0}, {"query_id": 1, "id": 1, "score": 1.0}]


def test_nearest_pairs_in_blocks(spark, monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    x = rng.normal(size=(50, 5)).round(1)
    x[7] = x[3]
    v = spark.createDataFrame([(i, x[i].tolist()) for i in range(50)] + [(80, []), (81, [0.0] * 5)], "id long, vector array<double>")
    monkeypatch.setattr(scan, "PAIR_ROWS", 9)
    monkeypatch.setattr(scan, "PAIR_QUERIES", 11)
    got = scan.nearest_pairs(v, v.withColumnRenamed("id", "query_id"), 1, 6, larger_id=True)
    best = {r.query_id: r.id for r in got.groupBy("query_id").agg(F.max_by("id", F.struct("cos", "id")).alias("id")).collect()}
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    assert best == {i: max((round(float(u[i] @ u[j]), 6), j) for j in range(50))[1] for i in range(50)}


def test_cache_is_bounded_and_long_work_is_split(spark, tmp_path):
    store = BlockStore(spark, str(tmp_path / "s"))
    store.upsert(some_blocks(spark))
    s = Service(Engine(spark, store, Settings(profile="iac")), "p1", str(tmp_path / "cache"), cache_entries=3)
    assert s.cache_get("q0") == "CACHE_MISS"
    for i in range(8):
        s.cache_set(f"q{i}", f"value {i}", ttl_seconds=1000 + i)
    assert s.cache_get("q7") == "value 7" and s.cache_get("q0") == "CACHE_MISS"
    assert len(s._generations()) == 1 and s._entries().count() == 3
    seen = []

    def generate(d):
        seen.append(1)
        return d.withColumn("answer", F.concat(F.lit("<"), F.substring("text", 1, 6), F.lit(">")))

    work = spark.createDataFrame([(0, "abcd" * 9000, True)], "key long, text string, has_instruction boolean")
    out = s._map_reduce(work, "sum up", generate)
    assert out.startswith("<") and out.endswith(">") and len(seen) >= 2  # chunks, then their answers


def test_jobs_by_priority(spark):
    jobs, done = Jobs(spark, workers=1), []
    gate = threading.Event()
    jobs.submit(lambda: gate.wait(10), 0)
    time.sleep(0.3)
    for p in (2, 1, 0):
        jobs.submit(lambda p=p: done.append(p), p)
    jobs.submit(lambda: 1 / 0, 1)
    gate.set()
    jobs.drain()
    jobs.close()
    assert done == [0, 1, 2] and isinstance(jobs.errors[0], ZeroDivisionError)


def test_busy_cluster_makes_background_wait(spark, monkeypatch):
    levels = iter([1.0, 1.0])
    monkeypatch.setattr(Jobs, "busy", lambda self: next(levels, 0.0))
    jobs, done = Jobs(spark, workers=1, wait=0.05), []
    jobs.submit(lambda: done.append("back"), 2)
    jobs.submit(lambda: done.append("front"), 0)
    jobs.drain()
    jobs.close()
    assert done == ["front", "back"]


def test_clock_hook_and_memory(spark, tmp_path):
    calls, failures = [], []

    def job():
        calls.append(1)
        raise OSError("no")

    clock = Clock(0.02, job, failures.append)
    time.sleep(0.3)
    clock.stop()
    assert len(calls) > 1 and len(failures) == len(calls)
    assert install_hook(str(tmp_path), "tool memory") and not install_hook(str(tmp_path), "other")
    assert (tmp_path / ".git/hooks/post-commit").read_text() == "#!/bin/sh\ntool memory 2>/dev/null\n"
    log = state.EventLog(spark, str(tmp_path / "log"))
    assert record_changes(spark, Repository(str(tmp_path)), log) == "No significant changes."
    assert [r.category for r in log.read().collect()] == ["memory"]


def test_index_location(tmp_path):
    root = str(tmp_path)
    assert state.index_location(root) == state.index_location(root, "in_project") == f"{root}/.lodestone"
    assert state.index_location(root, "native", "/home/x").startswith("/home/x/.cache/lodestone/")
    assert state.index_location("/mnt/c/repo", home="/home/x") == state.index_location("/mnt/c/repo", "native", "/home/x")
    with pytest.raises(ValueError):
        state.index_location(root, "elsewhere")


def test_remote_model():
    class Answer(http.server.BaseHTTPRequestHandler):
        def do_POST(self):  # noqa: N802
            body = json.loads(self.rfile.read(int(self.headers["Content-Length"])))
            self.send_response(500 if "bad" in body["prompt"] else 200)
            self.end_headers()
            self.wfile.write(json.dumps({"response": f"{body['model']}: {body['prompt']}"}).encode())

        def log_message(self, *a):
            pass

    server = http.server.ThreadingHTTPServer(("127.0.0.1", 0), Answer)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    ask = models.remote(f"http://127.0.0.1:{server.server_port}/", "small", timeout=5)()
    assert ask(["one", "bad", "two"]) == ["small: one", "", "small: two"]
    server.shutdown()
    assert models.remote("http://127.0.0.1:9/", "x", timeout=0.2)()(["p"]) == [""]

import datetime as dt
import subprocess

import pytest
from pyspark.sql import functions as F

from lodestone.__main__ import main
from lodestone.functions import models
from lodestone.functions import text as X
from lodestone.operators import fusion
from lodestone.plans.engine import Engine
from lodestone.plans.profiles import Settings
from lodestone.plans.service import MISS, Service
from lodestone.sources import state
from lodestone.sources.store import BlockStore
from lodestone.sources.vcs import Repository


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = tmp_path_factory.mktemp("repo")
    git = lambda *a: subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@example.com", *a], cwd=root, check=True, capture_output=True)
    git("init", "-q")
    (root / "auth.py").write_text("def login_user(name):\n    return name\n")
    (root / "old.py").write_text("def old_thing():\n    return 'some longer text to be found as a rename'\n")
    git("add", ".")
    git("commit", "-qm", "one")
    (root / "auth.py").write_text("def login_user(name):\n    return name.lower()\n")
    git("mv", "old.py", "new.py")
    git("add", ".")
    git("commit", "-qm", "two")
    return root


@pytest.fixture(scope="module")
def service(spark, tree, tmp_path_factory):
    at = tmp_path_factory.mktemp("svc")
    e = Engine(spark, BlockStore(spark, str(at / "store")), Settings(profile="python", least_cosine=0.5), models.embedder(lambda: models.hashed_embedder(32)))
    s = Service(e, "p", str(at / "cache"))
    assert Service(e).binding() == "unbound" and "No project" in Service(e).search_code("x")
    e.index_tree(str(tree), "p")
    return s


def test_tools(service):
    assert "login_user" in service.search_code("login_user", 2)
    assert "login_user" in service.assemble_context("login_user")
    assert "Unknown" in service.set_profile("x") and "python" in service.set_profile("python")
    assert "login_user" in service.orchestrate("login_user")
    done = service.orchestrate("login_user", "count", lambda d: d.select(F.length("prompt").cast("string").alias("answer")))
    assert done.isdigit()
    assert service.classify("rename the variable") == "SIMPLE" and service.classify("design a cache") == "COMPLEX"
    assert service.status()["p"]["files"] == 2 and service.binding() == "single"
    assert Service(service.engine).binding() == "workspace" and "login_user" in Service(service.engine).search_code("login_user")


def test_cache_tools(service):
    assert service.cache_get("where is login") == MISS
    assert service.cache_set("where is login", "auth.py") == "cached"
    assert service.cache_get("  Where IS login ") == "auth.py"
    assert service.cache_get("login where is") == "auth.py"  # the same words
    assert service.cache_get("other things entirely") == MISS


def test_session_budget(service):
    service.remaining = 3
    assert service.emit("x" * 100) == "x" * 12 and service.emit("y") == ""
    service.reset_session()
    assert service.remaining == 36_000


def test_vcs(spark, tree, tmp_path):
    r = Repository(str(tree))
    first = subprocess.run(["git", "rev-parse", "HEAD~1"], cwd=tree, capture_output=True, text=True).stdout.strip()
    assert {(x.filepath, x.change) for x in r.changed(spark, first).collect()} == {("auth.py", "modified"), ("old.py", "deleted"), ("new.py", "modified")}
    assert r.behind(first) == 1 and r.behind("nonsense") == -1 and len(r.commit()) == 40
    assert "auth.py" in r.diff(spark).select(X.diff_summary(F.col("diff"))).first()[0]
    assert r.freshness(first, quick=1)["reindex"] == "quick"
    none = Repository(str(tmp_path))
    assert none.commit() == "" and none.changed(spark, "x").count() == 0 and none.diff(spark, True).first().diff == ""


def test_state(spark, tmp_path):
    log = state.EventLog(spark, str(tmp_path / "log"), state.USAGE)
    t = dt.datetime(2024, 5, 1)
    log.append(spark.createDataFrame([(i, t - dt.timedelta(days=i * 40), 100, 25) for i in range(4)], "event_id long, ts timestamp_ntz, original long, compressed long"))
    assert {r.event_id for r in log.retained(F.lit(t)).collect()} == {0, 1, 2}
    s = state.load_settings('{"profile": "iac", "exclude": ["x/**"]}')
    assert s.spec.name == "iac" and "x/**" in s.exclude and len(s.exclude) == 5
    assert state.load_settings(state.dump_settings(s)) == s
    for bad in ('{"nope": 1}', '{"profile": "nope"}'):
        with pytest.raises(ValueError):
            state.load_settings(bad)
    (tmp_path / "m.md").write_text("# memory\n[2024-01-02 03:04] first\nloose\n[2024-01-03 00:00] second")
    assert [(r.ts, r.note) for r in state.memory_lines(spark, str(tmp_path / "m.md")).orderBy("seq").collect()] == [(dt.datetime(2024, 1, 2, 3, 4), "first"), (dt.datetime(2024, 1, 3), "second")]
    (tmp_path / "d.json").write_text('{"a": {"b": 1}}')
    assert state.read_json(spark, str(tmp_path / "d.json"), "a struct<b:int>").first().a.b == 1
    q, g = state.evaluation_queries(spark, [("x", {"a", "b"}), ("y", {"c"})])
    assert q.count() == 2 and g.count() == 3


def test_model_hooks(spark):
    hits = spark.createDataFrame([(0, "a", 0.9, 0.9), (0, "b", 0.1, 0.1)], "query_id long, id string, score double, similarity double")
    texts = spark.createDataFrame([("a", "nothing here"), ("b", "red fox " + "x" * 5000)], "id string, text string")
    queries = spark.createDataFrame([(0, "red fox")], "query_id long, query string")
    out = fusion.rerank(hits, 1, models.reranker(lambda: models.overlap_scores, texts, queries)).collect()
    assert [(r.id, r.rerank_score) for r in out] == [("b", 1.0)]
    d = spark.createDataFrame([("Score: 7", 0.1), ("no", 0.3), ("99", 0.2), (None, 0.5)], "a string, s double")
    assert [r[0] for r in d.select(F.coalesce(models.answer_score(F.col("a"), F.col("s")), F.col("s"))).collect()] == [0.7, 0.3, 1.0, 0.5]
    count = models.exact_tokens(lambda: lambda t: len(t.split()))
    assert [r[0] for r in spark.createDataFrame([("a b",), ("",), (None,)], "t string").select(count("t")).collect()] == [2, 0, 0]
    names = spark.createDataFrame([("coder:3b",), ("coder:7b",), ("other:9b",)], "name string")
    assert models.choose_model(names, 8000, "x", "coder") == "coder:7b" and models.choose_model(names.where("name = 'other:9b'"), None, "x", "coder") == "x"
    assert models.same_model("a:latest", "a")


def test_command_line(spark, tree, tmp_path, capsys):
    base = ["--store", str(tmp_path / "s"), "--project", "p", "--profile", "python"]
    for args, said in ((["reindex", str(tree)], "v=1 2"), (["search", "login_user"], "login_user"), (["status"], '"files": 2'), (["census", str(tree)], ".py 2"), (["versions"], "v=1"), (["classify", "fix typo"], "SIMPLE")):
        assert main([*base, *args], spark) == 0
        assert said in capsys.readouterr().out


def test_upkeep_commands(spark, tree, tmp_path, capsys):
    store, root = ["--store", str(tmp_path / "store"), "--project", "p"], str(tree)
    run = lambda *a: (main([*store, "--profile", "python", *a], spark), capsys.readouterr().out)
    assert run("init", root)[1].strip().endswith("settings.json")
    assert '"profile": "python"' in run("config", root)[1]
    assert "python 2" in run("dry-run", root)[1]
    assert run("reindex", root)[0] == 0
    code, out = run("doctor", root)
    assert code == 0 and "FAIL" not in out
    names = lambda: {r.function for r in BlockStore(spark, store[1]).read("p").collect()}
    assert names() == {"login_user", "old_thing"}
    old = spark.createDataFrame([("x", "old.py", "gone", "x", 1, 2, "p"), ("y", "auth.py", "stale", "x", 1, 2, "p"), ("z", "auth.py", "other", "x", 1, 2, "q")], "id string, filepath string, function string, code string, line_start int, line_end int, project_id string")
    BlockStore(spark, store[1]).upsert(old)
    assert run("janitor", root, "HEAD~1")[0] == 0  # old.py became new.py, auth.py changed
    assert names() == {"login_user", "old_thing"} and BlockStore(spark, store[1]).count("q") == 1
    assert run("run", root)[1].strip() == "2"
    log = str(tmp_path / "log")
    assert "auth.py" in run("memory", root, log)[1]
    assert '"category": "memory"' in run("dashboard", log)[1]

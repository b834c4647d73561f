"""The memory log's append, and contexts that hold a map of the files."""

import datetime as dt
import os

from lodestone.plans.engine import Engine
from lodestone.plans.profiles import Settings
from lodestone.sources.state import MemoryLog
from lodestone.sources.store import BlockStore, MemoryStore


def test_append_rotates_and_compacts(spark, tmp_path):
    log = MemoryLog(spark, str(tmp_path / "m"), most=4, limit=3)
    t = dt.datetime(2024, 1, 1)
    notes = lambda *rows: spark.createDataFrame([(a, t + dt.timedelta(minutes=m), n) for a, m, n in rows], "log_id string, ts timestamp_ntz, note string")
    assert log.read().count() == 0
    log.append(notes(("a", 1, "one"), ("b", 1, "other")))
    log.append(notes(("a", 2, "two")))
    assert {(r.log_id, r.note) for r in log.read().collect()} == {("a", "one"), ("a", "two"), ("b", "other")}
    log.append(notes(*(("a", 3 + i, f"n{i}") for i in range(5))))
    held = [r.note for r in log.read().where("log_id = 'a'").orderBy("ts", "seq").collect()]
    assert len(held) == 2 and held[0].startswith("[COMPACTED]") and held[1] == "n4"  # four are kept, three of them became one
    assert log.tail(1).where("log_id = 'b'").first().text == "[2024-01-01 00:01] other"
    assert len([f for f in os.listdir(tmp_path / "m") if f.startswith("g=")]) == 2


def test_contexts_hold_the_files(spark, tmp_path):
    root = tmp_path / "tree"
    root.mkdir()
    for name in ("alpha", "beta"):
        (root / f"{name}.py").write_text(f"def {name}_login(x):\n    return x\n")
    for store in (BlockStore(spark, str(tmp_path / "s")), MemoryStore(spark)):
        engine = Engine(spark, store, Settings(profile="python"))
        engine.index_tree(str(root), "p")
        assert {(r.filepath, r.names) for r in engine.repo_map("p").collect()} == {("alpha.py", "alpha_login"), ("beta.py", "beta_login")}
        assert engine.repo_map("other") is None
        text = engine.assemble(spark.createDataFrame([(1, "alpha_login")], "query_id long, query string"), "p").first().context
        assert "alpha.py: alpha_login" in text and "beta.py: beta_login" in text and text.index("Relevant") < text.index("Files")

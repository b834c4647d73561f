from lodestone.plans.engine import Engine
from lodestone.plans.profiles import Settings
from lodestone.sources import files
from lodestone.sources.store import BlockStore

import pytest


def test_several_roots_each_file_once(spark, tmp_path):
    for name in ("app/a.py", "app/sub/b.py", "lib/c.py", "lib/tests/d.py", "other/e.py", "f.py", "application/g.py"):
        at = tmp_path / "t" / name
        at.parent.mkdir(parents=True, exist_ok=True)
        at.write_text(f"def {at.stem}_fn(x):\n    return x\n")
    root = str(tmp_path / "t")
    read = lambda roots, ex=(): sorted(r.filepath for r in files.read_files(spark, root, ["*.py"], list(ex), source_roots=roots).select("filepath").collect())
    assert read(["app", "lib"], ["**/tests/**"]) == ["app/a.py", "app/sub/b.py", "lib/c.py"]
    assert read(["app", "app/sub", "./app/", "missing"]) == ["app/a.py", "app/sub/b.py"]
    assert read(["."]) == read(None) == read([".", "app"]) and len(read(None)) == 7
    assert read(["missing"]) == []
    with pytest.raises(ValueError):
        read(["../x"])
    engine = Engine(spark, BlockStore(spark, str(tmp_path / "s")), Settings(profile="python", source_roots=["lib"], exclude=[]))
    engine.index_tree(root, "p")
    assert {r.filepath for r in engine.store.read("p").select("filepath").collect()} <= {"lib/c.py", "lib/tests/d.py"} and engine.store.count("p")

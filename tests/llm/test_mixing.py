import random

import duckdb
import pytest

from lodestone.llm import mixing as M
from lodestone.llm.storage import Scratch

SCHEMA = "doc_id long, text string, source string, size string, target int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, s, "x", 1) for i, t, s in rows], SCHEMA)


def docs():
    out = []
    for i in range(300):
        out.append((i, " ".join(["w"] * (1 + i * 7 % 40)), "big"))
    for i in range(300, 340):
        out.append((i, " ".join(["w"] * (5 + i % 9)), "mid"))
    out += [(400, "a b c", "tiny"), (401, None, "void"), (402, "x y", None), (403, "", None), (404, "x \x0b y", "Ä"), (405, " ".join(["w"] * 5000), "mid")]
    return out + [out[0], (None, "one two", "mid")]


def expected_targets(rows, weights=(1, 2, 3), epochs=3):
    size = {}
    for _, t, s in rows:
        size[s] = size.get(s, 0) + len((t or "").split())
    names = sorted((s for s in size if s is not None)) + ([None] if None in size else [])
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, held = sum(size.values()), set()
    while True:
        free = sum(weight[s] for s in names if s not in held)
        left = total - sum(epochs * size[s] for s in held)
        target = {s: epochs * size[s] if s in held else left * weight[s] / free for s in names}
        over = {s for s in names if s not in held and target[s] > epochs * size[s]}
        if not over:
            return size, target
        held |= over


def test_targets_and_words_taken(spark):
    rows = docs()
    out = M.mix(spark, frame(spark, rows), carry=["doc_id", "source"]).collect()
    assert len(out) == len(rows)
    size, target = expected_targets(rows)
    taken = {}
    for r in out:
        assert r.source_size == size[r.source] and r.target == pytest.approx(target[r.source])
        assert 0 <= r.taken <= 3 * r.size
        taken[r.source] = taken.get(r.source, 0) + r.taken
    for s in size:
        assert abs(taken[s] - target[s]) <= 0.5 + 1e-6
    again = M.mix(spark, frame(spark, rows).repartition(3), carry=["doc_id", "source"]).collect()
    assert sorted(map(str, again)) == sorted(map(str, out))


def test_water_level_of_many_sources(spark):
    rng = random.Random(8)
    for _ in range(4):
        sources = [(rng.choice([1, 2, 3]), rng.choice([0, 3, 30, 300, 3000])) for _ in range(60)]
        total = sum(c for _, c in sources) // 3
        level = M.water_level(spark.createDataFrame(sources, "weight long, cap long").repartition(5), total, Scratch(spark, "test"))
        assert sum(min(c, level * w) for w, c in sources) == pytest.approx(total)


@pytest.mark.parametrize("carry", [["doc_id"], ["doc_id", "text"]])
def test_sql_says_the_same(spark, carry):
    rows = [r for r in docs() if r[0] is not None]
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, source VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?, ?)", rows)
    want = sorted(map(str, c.execute(M.SQL).fetchall()))
    got = sorted(str((r.doc_id, r.size, r.source_size, r.target, r.taken)) for r in M.mix(spark, frame(spark, rows), carry=carry).collect())
    assert got == want


def test_ties_and_long_texts(spark):
    """Rows that tie share what is left; a long text ends its source in part."""
    rows = [(1, "a b c d", "s")] * 5 + [(2, " ".join(["w"] * 3000), "t"), (3, "x", "t")]
    out = M.mix(spark, frame(spark, rows), carry=["doc_id", "source"]).collect()
    size, target = expected_targets(rows)
    taken = {s: sum(r.taken for r in out if r.source == s) for s in size}
    assert all(abs(taken[s] - target[s]) <= 0.5 + 1e-6 for s in size) and all(r.taken <= 3 * r.size for r in out)
    again = M.mix(spark, frame(spark, rows).repartition(4), carry=["doc_id", "source"]).collect()
    assert sorted(map(str, out)) == sorted(map(str, again))


def test_nothing_to_mix(spark):
    assert M.mix(spark, frame(spark, docs()).limit(0)).count() == 0
    only = M.mix(spark, frame(spark, [(1, None, "a"), (2, "", None)])).collect()
    assert {(r.size, r.target, r.taken) for r in only} == {(0, 0.0, 0)}

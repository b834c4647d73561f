"""The pipeline against brute-force versions of its stages."""

import collections
import hashlib
import random

import pytest

from lodestone.llm import quality_rules

from .test_line_dedup import brute as lines_brute
from .test_near_dedup import brute as near_brute
from .test_packing import check as packing_check
from .test_quality_rules import base

pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    rng = random.Random(11)
    words = ["the", "of", "and", "house", "river", "walked", "garden", "to", "in", "is", "window", "stone", "bird", "cloud", "evening", "letter"]
    prose = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(n // 9)) + "."
    rows = []
    for i in range(120):
        text = prose(rng.randint(40, 300))
        if i % 3 == 0:
            text += "\nAccept all cookies of this site"
        rows.append([i, text, "en", f"site{i % 16}", 0])
    for i in range(120, 140):  # near copies
        w = rows[7][1].split(" ")
        w[rng.randrange(len(w))] = "changed"
        rows.append([i, " ".join(w), "en", f"site{i % 16}", 0])
    rows += [[200, "junk### " * 60, "en", "site1", 0], [201, None, None, None, None], [202, "", "en", "site2", 0], [203, prose(100).upper() + "!!", "en", "site3", 0], [204, rows[3][1], "en", "site4", 0]]
    return [tuple([i, t, x, s, len(t or "")]) for i, t, x, s, _ in rows]


def mix_brute(rows):
    size, out = collections.Counter(), []
    for _, t, s in rows:
        size[s] += len((t or "").split())
    names = sorted(s for s in size if s is not None) + [s for s in size if s is None]
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    held, total = set(), sum(size.values())
    while True:
        level = (total - sum(3 * size[s] for s in held)) / sum(weight[s] for s in names if s not in held)
        over = {s for s in names if s not in held and level * weight[s] > 3 * size[s]}
        if not over:
            break
        held |= over
    for s in names:
        target = 3 * size[s] if s in held else level * weight[s]
        whole = int(target // size[s]) if size[s] else 0
        rest, done = int(target + 0.5) - whole * size[s], 0
        for _, i, n in sorted((hashlib.md5(f"17|{i}".encode()).hexdigest(), i, len((t or "").split())) for i, t, x in rows if x == s):
            taken = whole * n + max(0, min(n, rest - done))
            done += n
            out += [i] * (int(taken / n + 0.5) if n else 0)
    return collections.Counter(out)


@pytest.fixture(scope="module")
def table(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("pipe")
    spark.createDataFrame(corpus(), SCHEMA).repartition(3).write.parquet(str(at / "documents.parquet"))
    return str(at)


def test_stages_against_brute_force(spark, table):
    docs = spark.read.parquet(f"{table}/documents.parquet")
    names = [n for n, _ in pipeline.STAGES]
    stage = dict(pipeline.STAGES)
    at = {}
    for n in names:
        docs = stage[n](spark, docs, table).cache()
        at[n] = docs
        if n != names[-1]:
            assert docs.columns == pipeline.COLUMNS
    text = lambda d: {r.doc_id: r.text for r in d.collect()}
    rows = corpus()
    kept = text(at["quality rules"])
    verdict = {r.doc_id: r.kept for r in quality_rules.quality_rules(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert set(kept) == {i for i, t, *_ in rows if verdict[i]} and not any(base(t)[-1] for t in kept.values())
    assert set(range(140)) <= set(kept) and not {200, 201, 202, 203} & set(kept)
    want = lines_brute([(i, t, s) for i, t, _, s, _ in rows if i in kept], 10)
    lines = text(at["line dedup"])
    assert lines == {i: t for i, t, _, _ in want} and "cookies" not in "".join(lines.values())
    near = text(at["near dedup"])
    assert set(near) == {d for d, _, _, ok in near_brute(list(lines.items()), 5, 80) if ok}
    source = {i: s for i, _, _, s, _ in rows}
    mixed = at["mixing"].collect()
    assert collections.Counter(r.doc_id for r in mixed) == mix_brute([(i, t, source[i]) for i, t in near.items()])
    padding, _ = packing_check(at["packing"].collect(), [(r.doc_id, r.text) for r in mixed], 2048)
    assert padding < 0.1


def test_run_gives_the_stages_result(spark, table):
    out = pipeline.run(spark, table)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    docs = spark.read.parquet(f"{table}/documents.parquet")
    for _, f in pipeline.STAGES:
        docs = f(spark, docs, table).cache()
    key = lambda d: sorted(map(str, d.select("doc_id", "start", "length", "ids_crc32").collect()))
    assert key(out) == key(docs)


def test_empty_table(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_near_dedup_keeps_one_row_of_each_group(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    near = a.replace("a39", "changed")
    rows = [(4, a), (4, a), (4, a), (9, near), (None, a), (None, b), (None, b), (None, b + " more"), (None, "x y"), (None, ""), (5, ""), (6, ""), (4, c), (7, None)]
    d = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA).repartition(3)
    out = pipeline.stage_near(spark, d, "")
    got = sorted(((r.doc_id, r.text) for r in out.collect()), key=str)
    unowned = [r for r in got if r[0] is None and (r[1] or "").startswith("b0")]
    assert out.columns == pipeline.COLUMNS and len(unowned) == 1  # b and its near copy: one of them
    assert [r for r in got if r not in unowned] == sorted([(4, a), (None, "x y"), (None, ""), (5, ""), (6, ""), (4, c), (7, None)], key=str)


def test_odd_tables(spark, tmp_path):
    """Long texts, clashing names, nulls in every column, and columns that are missing."""
    rng = random.Random(5)
    prose = lambda n: " ".join(rng.choice(["the", "of", "river", "house", "and", "garden", "walked", "to", "stone"]) + "." * (i % 9 == 8) for i in range(n))
    clean = [(i, prose(rng.randint(60, 200)), "en", "s", None, "x", 1, 2.0, True) for i in range(30)]
    odd = [(50, prose(60_000), "en", None, None, "x", 1, 2.0, None), (51, None, None, None, None, None, None, None, None), (None, prose(90), None, "t", None, "y", 1, 2.0, True), clean[3], (52, "", "en", "s", 0, "x", 1, 2.0, True)]
    d = spark.createDataFrame(clean + odd, "doc_id long, text string, lang string, source string, n_chars long, rep string, taken int, size double, kept boolean").repartition(2)
    d.write.parquet(str(tmp_path / "a" / "documents.parquet"))
    out = pipeline.run(spark, str(tmp_path / "a"))
    found = {r.doc_id for r in out.collect()}
    assert 50 in found and None in found and not {51, 52} & found
    longest = out.where("doc_id = 50").agg({"length": "sum", "doc_tokens": "max"}).first()
    assert longest[0] % longest[1] == 0 and longest[1] > 60_000  # every id of the long text is packed
    d.select("doc_id", "text").write.parquet(str(tmp_path / "b" / "documents.parquet"))
    assert {r.doc_id for r in pipeline.run(spark, str(tmp_path / "b")).collect()} >= {0, 1, 50}

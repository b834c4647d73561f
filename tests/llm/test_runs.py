import hashlib
import random
import re
import time
import zlib

import numpy as np
import pytest

from lodestone.llm import runs as R

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(w, times=4, least=6):
    """Every maximal stretch of every period; an interval keeps its smallest."""
    n, best = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and w[j] == w[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, times * q):
                best.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in best.items())


def plain_row(doc_id, text):
    w = WORD.findall(text or "")
    n = len(w)
    if doc_id is not None and n:
        h = zlib.crc32(str(doc_id).encode())
        g = h // 10
        if h % 10 == 0:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = plain_runs(w)
    gone = {i for s, size, q in found for i in range(s + q, s + size)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
    lines = "".join(f"{s},{size},{q}\n" for s, size, q in found)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    milli = best and 1000 * best[1] // best[2]
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    return (doc_id, len(found), *(best or (None, None, None)), milli, sha(lines), sha(kept))


def texts(rng, count):
    for _ in range(count):
        w = [rng.choice("abc") for _ in range(rng.randint(0, 30))] if rng.random() < 0.5 else []
        while rng.random() < 0.75:
            unit = [rng.choice("abÄ") for _ in range(rng.randint(1, 7))]
            times = rng.randint(1, 9)
            w += (unit * times)[: rng.randint(1, len(unit) * times)]
            w += [rng.choice("abcd") for _ in range(rng.randint(0, 5))]
        yield w


def test_kernel_matches_brute_force():
    rng = random.Random(3)
    for _ in range(60):
        some = list(texts(rng, 12))
        ids = np.array([ord(x) for w in some for x in w], np.int64)
        begin = np.concatenate(([0], np.cumsum([len(w) for w in some])))
        start, length, period = R.find_runs(ids, begin)
        want = [(s + int(begin[t]), n, q) for t, w in enumerate(some) for s, n, q in plain_runs(w)]
        assert list(zip(start.tolist(), length.tolist(), period.tolist(), strict=True)) == want


def test_one_long_run_takes_no_square_time():
    began = time.time()
    for unit in (1, 7):
        start, length, period = R.find_runs(np.arange(60_000) % unit, np.array([0, 60_000]))
        assert (start.tolist(), length.tolist(), period.tolist()) == ([0], [60_000], [unit])
    assert time.time() - began < 30
    with pytest.raises(ValueError):
        R.find_runs(np.zeros(9, np.int64), np.array([0, 9]), times=3)


def test_query_matches_brute_force(spark, monkeypatch):
    rng = random.Random(5)
    rows = [(i, rng.choice([" ", "\n", "\x0b\t"]).join(w)) for i, w in enumerate(texts(rng, 250))]
    rows += [(700, None), (701, ""), (702, " \n"), (None, "x y z"), (None, "go " * 9), (3, rows[3][1]), (3, rows[3][1]), (703, "a b " * 8), (704, "é é " * 6), (705, " ".join(f"w{i % 700}" for i in range(20_000)))]
    monkeypatch.setattr(R, "SLICE", 3000)
    d = spark.createDataFrame([(*r, 7, "x") for r in rows], "doc_id long, text string, n int, best string")
    found = R.collapse_runs(spark, d, before=R.planted, carry=("n",))
    assert {r.n for r in found.select("n").collect()} == {7}
    out = R.digest(found)
    assert out.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted((plain_row(*r) for r in rows), key=str)
    assert sum(r[1] for r in (plain_row(*r) for r in rows)) > 100


def test_empty_table_and_plain_use(spark):
    assert R.digest(R.collapse_runs(spark, spark.createDataFrame([], "doc_id long, text string"))).collect() == []
    (r,) = R.collapse_runs(spark, spark.createDataFrame([(1, "so it is no no no no no no and on")], "doc_id long, text string")).collect()
    assert r.collapsed == "so it is no and on" and [tuple(x) for x in r.runs] == [(3, 6, 1)]
    with pytest.raises(ValueError):
        R.collapse_runs(spark, spark.createDataFrame([(1, "a", 2)], "doc_id long, text string, runs int"), carry=("runs",))

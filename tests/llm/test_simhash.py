import random
import re

import numpy as np
import pytest
import xxhash

from lodestone.llm import simhash as S

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_fingerprint(text):
    w = [re.sub("[A-Z]", lambda m: m[0].lower(), x) for x in WORD.findall(text or "")]
    grams = [w[i : i + 3] for i in range(len(w) - 2)] or ([w] if w else [])
    hs = [xxhash.xxh64(" ".join(g).encode(), seed=42).intdigest() for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute(prints):
    """Least id reachable for [(id, fingerprint)]."""
    up = list(range(len(prints)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints[:i]):
            if bin(a ^ b).count("1") <= 3:
                x, y = root(i), root(j)
                up[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(prints):
        if d is not None:
            least[root(i)] = min(least.get(root(i), d), d)
    return sorted(((d, f"{f:016x}", least.get(root(i))) for i, (d, f) in enumerate(prints)), key=str)


def result(spark, rows, **more):
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, fp string, comp int")
    out = S.near_duplicates(spark, d, **more)
    return sorted(((r.doc_id, r.f, r.component_id) for r in out.select("doc_id", S.hexadecimal("fp").alias("f"), "component_id").collect()), key=str)


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcÄd") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    rows = []
    for _ in range(8):
        base = [rng.choice(words) for _ in range(rng.randint(60, 200))]
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randint(0, 2)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append("\x0b".join(w).upper() if rng.random() < 0.2 else " \n".join(w))
    rows = [(5 * i + 2, t) for i, t in enumerate(rows)]
    return rows + [(901, None), (900, ""), (902, " \t"), (903, "one two"), (904, "ONE two"), (905, "one"), (907, "   x"), (3, rows[0][1]), (3, rows[0][1]), (None, rows[20][1]), (None, "alone here with no id at all")]


@pytest.mark.parametrize("parts, hot", [((2,), 4096), ((3,), 3), ((4,), 2), (S.PARTS, 4096)])
def test_matches_brute_force(spark, monkeypatch, parts, hot):
    monkeypatch.setattr(S, "HOT", hot)
    rows = corpus(len(parts) + parts[0])
    assert result(spark, rows, parts=parts) == brute([(d, plain_fingerprint(t)) for d, t in rows])


def test_links_without_pivots(spark, monkeypatch):
    """The search alone: every text's fingerprint is put in by hand, near ones in chains and balls."""
    rng = random.Random(4)
    prints = []
    for _ in range(6):
        base = rng.getrandbits(64) & 0xFFFF0000FFFFFFFF  # a part whose values all agree
        for _ in range(40):
            prints.append(base ^ sum(1 << b for b in rng.sample(range(64), rng.randint(0, 4))))
    table = {str(i): p for i, p in enumerate(prints)}
    for parts in (2, 3, 4):
        grouped = S.group_bits(np.eye(64) * 10, 20, parts)
        assert sorted(b for g in grouped for b in g) == list(range(64))
        histograms = [[np.bincount(S.part_values(S._bits(np.array(prints, np.uint64)), p).astype(int), minlength=1 << len(p)) for p in S.halves(g)] for g in grouped]
        plan = S.Plan(grouped, histograms, len(prints))
        bits = S._bits(np.array(prints, np.uint64))
        limits, cost = plan.thresholds(bits)
        assert (limits.sum(1) == 3 - parts + 1).all() and limits.min() >= -1
        # no other thresholds are cheaper
        costs = plan.costs(bits)
        ways = [()]
        for _ in range(parts):
            ways = [w + (t,) for w in ways for t in range(-1, 4)]
        for r in (0, 99):
            assert cost[r] == pytest.approx(min(sum(costs[i][r, t + 1] for i, t in enumerate(w)) for w in ways if sum(w) == 4 - parts))
        index = {}
        for i, g in enumerate(grouped):
            for at, v in enumerate(S.part_values(bits, g)):
                index.setdefault((i, int(v)), []).append(at)
        found = {(int(q), d) for i, at, keys in plan.probes(np.array(prints, np.uint64)) for q, key in zip(at, keys, strict=True) for d in index.get((i, int(key)), [])}
        for a in range(len(table)):
            for b in range(len(table)):
                if bin(prints[a] ^ prints[b]).count("1") <= 3:
                    assert (a, b) in found


def test_long_text_in_chunks_empty_table_and_near_counts(spark, monkeypatch):
    monkeypatch.setattr(S, "CHUNK", 7)
    text = " ".join(f"W{i % 91}" for i in range(5000))
    assert S.fingerprint(text) == plain_fingerprint(text)
    assert result(spark, []) == []
    h = np.arange(16)
    near = S.near_counts(h)
    for v in range(16):
        for d in range(4):
            assert near[v, d] == sum(h[u] for u in range(16) if bin(u ^ v).count("1") == d)

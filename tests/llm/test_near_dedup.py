import random
import re

import numpy as np
import pytest

from lodestone.llm import kernels as K
from lodestone.llm import near_dedup as N

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOW = {c: c + 32 for c in range(65, 91)}


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOW))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, threshold):
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= threshold * len(sets[i] | sets[j]):
                a, b = root(i), root(j)
                up[max(a, b)] = min(a, b)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[root(i)] = min(least.get(root(i), d), d)
    return {(d, len(sets[i]), least[root(i)], d == least[root(i)]) for i, (d, _) in enumerate(rows)}


def corpus(seed, edits=12):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdefgÄ") for _ in range(rng.randint(1, 8))) for _ in range(500)]
    text = lambda n: [rng.choice(words) for _ in range(n)]
    rows = []
    for _ in range(20):
        rows.append(text(rng.randint(1, 120)))
    for _ in range(3):
        base = text(90)
        for _ in range(25):
            w = list(base)
            for _ in range(rng.randint(0, edits)):
                w[rng.randrange(len(w))] = rng.choice(words)
            rows.append(w)
    out = [(7 * i + 3, "  ".join(w).upper() if i % 5 == 0 else "\t".join(w)) for i, w in enumerate(rows)]
    return out + [(1000, None), (1001, ""), (1002, "\x0b "), (1003, "one two"), (1004, "One TWO"), (1005, "one two three four"), (900, out[0][1])]


@pytest.mark.parametrize("k, block, rounds", [(4, 128, 3), (5, 4, 1)])
def test_matches_brute_force(spark, monkeypatch, k, block, rounds):
    monkeypatch.setattr(N, "BLOCK", block)
    monkeypatch.setattr(N, "PIVOT_ROUNDS", rounds)  # more is left to the blocks
    rows = corpus(k)
    d = spark.createDataFrame([(i, t, "x", 5) for i, t in rows], "doc_id long, text string, component_id string, n int")
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(spark, d, k, 80).collect()}
    assert out == brute(rows, k, 80)


def test_repeated_rows_missing_ids_and_empty(spark):
    t = "the same eight words as in another row"
    d = spark.createDataFrame([(4, t), (4, t), (None, t), (9, t), (None, "x y")], "doc_id long, text string")
    out = sorted(((r.doc_id or -1, r.component_id, r.kept) for r in N.near_duplicates(spark, d).collect()), key=str)
    assert out == sorted([(4, 4, True), (4, 4, True), (-1, 4, False), (9, 4, False), (-1, None, False)], key=str)
    assert N.near_duplicates(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_superminhash_estimates_similarity():
    rng = np.random.default_rng(1)
    for n, share in ((20, 0.5), (300, 0.8), (3000, 0.6)):
        pool = np.sort(rng.integers(0, 1 << K.HASH_BITS, 2 * n, dtype=np.uint64))
        both = int(share * n)
        a, b = np.sort(pool[:n]), np.sort(pool[n - both : 2 * n - both])
        sig = K.superminhash(np.concatenate([a, b]), np.array([0, len(a), len(a) + len(b)]), 150)
        assert np.isfinite(sig).all()
        assert abs((sig[0] == sig[1]).mean() - both / (2 * n - both)) < 0.13
    assert np.isinf(K.superminhash(np.zeros(0, np.uint64), np.array([0, 0]), 10)).all()


def test_components_of_a_chain(spark):
    rng = random.Random(2)
    links = [(i + 1, i) for i in range(60)] + [(101, 100), (102, 101), (200, 100)]
    rng.shuffle(links)
    got = {r.node: r.comp for r in N.components(spark.createDataFrame(links, "a long, b long").repartition(4), N.Scratch(spark, "t"), "c").collect()}
    assert got == {i: 0 for i in range(61)} | {i: 100 for i in (100, 101, 102, 200)}


def test_long_texts_near_the_threshold(spark, monkeypatch):
    """Sets far above the sketch, on either side of the threshold, left to the blocks."""
    monkeypatch.setattr(N, "BLOCK", 8)
    monkeypatch.setattr(N, "PIVOT_ROUNDS", 1)
    rng = random.Random(17)
    base = [f"w{rng.randrange(4000)}" for _ in range(2500)]
    rows = []
    for i in range(48):  # an edit touches k shingles, so some 140 edits part two texts
        w = list(base)
        for at in rng.sample(range(len(w)), rng.randint(20, 90)):
            w[at] = f"x{rng.randrange(10**6)}"
        rows.append((i, " ".join(w)))
    rows.append((90, " ".join(base * 12)))  # 30,000 words
    out = {(r.doc_id, r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(spark, spark.createDataFrame(rows, "doc_id long, text string"), 5, 80).collect()}
    assert out == brute(rows, 5, 80)

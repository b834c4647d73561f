import hashlib
import random

import numpy as np
import pytest

from lodestone.llm import suffix_dedup as S

SCHEMA = "doc_id long, text string, n_bytes string, spans int"


def brute(rows, length, keep):
    """Rows in order of doc_id -> removed flags of each, by every window."""
    seen = {}
    data = [(t or "").encode() for _, t in rows]
    for r, b in enumerate(data):
        for s in range(len(b) - length + 1):
            seen.setdefault(b[s : s + length], []).append((r, s))
    flags = [np.zeros(len(b), bool) for b in data]
    for places in seen.values():
        for r, s in places[1 if keep == "first" else 0 :] if len(places) > 1 else []:
            flags[r][s : s + length] = True
    return data, flags


def corpus(seed):
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, base = text(40), text(120)
    docs = [text(rng.randint(0, 150)) for _ in range(25)] + [text(20) + passage + text(30) for _ in range(6)]
    for _ in range(8):  # near copies
        w = base.split()
        for _ in range(3):
            w[rng.randrange(len(w))] = rng.choice(words)
        docs.append(" ".join(w))
    docs += ["be " * 400, "x" * 900, (text(30) + " ") * 6, text(60)]
    docs += [docs[-1], None, "", "short"]
    return list(enumerate(docs))


@pytest.mark.parametrize("keep", ["none", "first"])
@pytest.mark.parametrize("crowd", [256, 2])
def test_matches_brute_force(spark, monkeypatch, keep, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)  # 2: nearly all groups are crowds
    rows = corpus(crowd)
    out = {r.doc_id: r for r in S.remove_repeats(spark, spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA), 100, keep).collect()}
    data, flags = brute(rows, 100, keep)
    for (i, _), b, f in zip(rows, data, flags, strict=True):
        kept = bytes(np.frombuffer(b, np.uint8)[~f])
        assert out[i].n_bytes == len(b)
        assert bytes(out[i].kept) == kept, i
        assert sum(s.hi - s.lo for s in out[i].spans) == f.sum()


def passages_brute(rows, n):
    """Words that lie in a run of n words which another text holds too."""
    words, seen = [(t or "").split() for _, t in rows], {}
    for r, w in enumerate(words):
        for s in range(len(w) - n + 1):
            seen.setdefault(tuple(w[s : s + n]), []).append((r, s))
    flags = [np.zeros(len(w), bool) for w in words]
    for places in seen.values():
        if len({r for r, _ in places}) > 1:
            for r, s in places:
                flags[r][s : s + n] = True
    return flags


@pytest.mark.parametrize("crowd", [256, 2])
def test_passages_match_brute_force(spark, monkeypatch, crowd):
    monkeypatch.setattr(S, "CROWD", crowd)
    rows = corpus(crowd)
    half = " ".join(rows[3][1].split()[:30])
    rows += [(len(rows) + i, t) for i, t in enumerate([half + "  \n" + half + " tail", "be " * 30, rows[30][1] + " " + rows[31][1] + " " + rows[30][1]])]
    d = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], SCHEMA)
    out = {r.doc_id: r for r in S.remove_repeats(spark, d, 100, "none", passage_words=20).collect()}
    for (i, _), f in zip(rows, passages_brute(rows, 20), strict=True):
        got = np.zeros(len(f), bool)
        for s in out[i].passages:
            got[s.lo : s.hi] = True
        assert (got == f).all(), i


@pytest.mark.parametrize("stretch", [700, 1000])
def test_stretches_of_long_texts(spark, monkeypatch, stretch):
    monkeypatch.setattr(S, "STRETCH", stretch)
    monkeypatch.setattr(S, "SLICE", 500)  # texts above it are slices of their own, in stretches
    rows = corpus(9)
    long = " ".join(t for _, t in rows[:12])
    rows += [(len(rows), long), (len(rows) + 1, "start " + long[500:] + " end")]
    out = {r.doc_id: r for r in S.remove_repeats(spark, spark.createDataFrame(rows, "doc_id long, text string"), 100, "none", passage_words=20).collect()}
    data, flags = brute(rows, 100, "none")
    for (i, _), b, f, p in zip(rows, data, flags, passages_brute(rows, 20), strict=True):
        assert bytes(out[i].kept) == bytes(np.frombuffer(b, np.uint8)[~f]), i
        assert sum(s.hi - s.lo for s in out[i].passages) == p.sum(), i


def test_repeated_rows_and_missing_ids(spark):
    text = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(10))
    other = " ".join(hashlib.md5(str(i).encode()).hexdigest() for i in range(50, 60))
    d = spark.createDataFrame([(1, text), (1, text), (None, other), (5, other), (6, "a")], "doc_id long, text string")
    out = sorted((r.doc_id or 0, r.n_bytes, len(r.kept)) for r in S.remove_repeats(spark, d, 100, "none").collect())
    assert out == [(0, len(other), 0), (1, len(text), 0), (1, len(text), 0), (5, len(other), 0), (6, 1, 1)]


def test_empty_table(spark):
    assert S.remove_repeats(spark, spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_longest_previous_factors():
    rng = random.Random(3)
    buf = np.frombuffer(bytes(rng.choice(b"ab") for _ in range(400)) + b"abcdefghij" * 9, np.uint8)
    length, n = 24, len(buf) - 24 + 1
    lpf, other = S.longest_previous_factors(buf, np.arange(n), length)

    def lcp(i, j):
        k = 0
        while k < length and buf[i + k] == buf[j + k]:
            k += 1
        return k

    for j in range(0, n, 7):
        assert lpf[j] == max([lcp(i, j) for i in range(j)], default=0)
        assert other[j] == max(lcp(i, j) for i in range(n) if i != j)


def test_bad_arguments(spark):
    with pytest.raises(ValueError):
        S.remove_repeats(spark, spark.createDataFrame([], "doc_id long, text string"), keep="last")

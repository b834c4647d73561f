import collections
import random
import re

from lodestone.llm import quality_rules as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, n_words string, kept int"


def base(text):
    t = text or ""
    w = WORD.findall(t)
    g = collections.Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
    cover = {j for i in range(len(w) - 7) if g[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in t.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(cover), len(w) < 20 or 100 * len(cover) > 30 * len(w)


def docs():
    rng = random.Random(6)
    words = ["the", "of", "and", "house", "river", "walked", "garden", "to", "in", "is", "window", "stone", "évite"]
    prose = lambda n: ". ".join(" ".join(rng.choice(words) for _ in range(9)).capitalize() for _ in range(n // 9)) + "."
    out = [(i, prose(rng.randint(30, 400)), "en") for i in range(40)]
    out += [(100, " ".join(rng.choice(words) + rng.choice(["###", "&&&", "%%%"]) for _ in range(150)), "en"), (101, (prose(300)).upper() + "!!", "en"), (102, " | ".join(rng.choice(words) for _ in range(200)), "en")]
    out += [(103, "one two three four five six seven eight nine " * 12, "en"), (104, None, "en"), (105, "", None), (106, "a", "xx"), (107, "x\x0by z q \x85", "fr"), (108, "same line\nsame line\n \nsame line", "de")]
    out += [(109, prose(40) + "\n" + prose(40), None), (110, "w " * 7, "en"), (111, "w " * 8, "en"), (112, "w " * 9, "en"), (113, " ".join(str(i) for i in range(30_000)), "en")]
    return [*out, out[0], out[0], (None, out[1][1], "en")]


def test_counts_match_brute_force_and_junk_goes(spark):
    rows = docs()
    d = spark.createDataFrame([(i, t, x, "c", 1) for i, t, x in rows], SCHEMA)
    out = Q.quality_rules(spark, d).collect()
    assert len(out) == len(rows)
    text = {i: t for i, t, _ in rows}
    for r in out:
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == base(text[r.doc_id]), r.doc_id
        assert 0 <= r.char_js <= 1 and 0 <= r.word_js <= 1
        assert not (r.base_failed and r.kept)
    kept = {r.doc_id: r.kept for r in out}
    assert all(kept[i] for i in range(40)) and not any(kept[i] for i in (100, 101, 102, 103, 104, 105, 106))


def test_distance_against_its_formula(spark):
    import numpy as np

    def js(p, q):
        p, q = np.array(p) / sum(p), np.array(q) / sum(q)
        m = (p + q) / 2
        kl = lambda a: sum(x * np.log2(x / y) for x, y in zip(a, m, strict=True) if x > 0)
        return float(np.sqrt((kl(p) + kl(q)) / 2))

    pairs = [([1, 2, 3], [3, 2, 1]), ([1, 0, 0], [0, 0, 1]), ([5, 5, 5], [1, 1, 1])]
    d = spark.createDataFrame([([float(x) for x in p], [float(x) for x in q]) for p, q in pairs], "p array<double>, q array<double>")
    got = [r[0] for r in d.select(Q._js("p", "q")).collect()]
    assert np.allclose(got, [js(p, q) for p, q in pairs], atol=1e-7)


def test_empty_table(spark):
    assert Q.quality_rules(spark, spark.createDataFrame([], SCHEMA)).count() == 0

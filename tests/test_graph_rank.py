import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import graph
from lodestone.plans import catalog


def test_a_chain_needs_more_than_ten_steps(spark, tmp_path):
    """Thirty hosts, each naming the next: mass takes thirty steps to arrive."""
    names = ["h" + chr(97 + i // 6) + chr(97 + i % 6) for i in range(30)]
    rows = [(i, f"https://{names[i]}.example.com/", names[i + 1] if i < 29 else "end") for i in range(30)]
    spark.createDataFrame(rows, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame([(1, "end")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    pr = [0.15 / 30]
    for _ in range(29):
        pr.append(0.15 / 30 + 0.85 * pr[-1])
    q = catalog.queries()
    out = {r.id: r.pr for r in q["pagerank"](spark, str(tmp_path)).collect()}
    assert all(abs(out[i] - pr[i]) < 1e-7 for i in range(30))
    best = q["graph_rank_topk"](spark, str(tmp_path)).where("rank = 1").first()
    assert (best.id, best.score) == (29, round(0.7 + 0.3 * pr[29] * 30, 4))


def plain_ranks(rows, steps):
    edges = {(a, b) for a, _, text in rows for b, name, _ in rows if a != b and name and name in (text or "").split()}
    deg = {a: sum(e[0] == a for e in edges) for a, _, _ in rows}
    pr = {a: 1 / len(rows) for a, _, _ in rows}
    for _ in range(steps):
        now = dict.fromkeys(pr, 0.15 / len(rows))
        for a, b in edges:
            now[b] += 0.85 * pr[a] / deg[a]
        pr = now
    return pr, {a: n for a, n in deg.items() if n}


@pytest.mark.parametrize("hot, spread", [(100_000, 32), (2, 3)])
def test_factored_graph_equals_the_edges(spark, monkeypatch, hot, spread):
    """Names that blocks share, that blocks say themselves, that only one has, and none."""
    monkeypatch.setattr(graph, "HOT", hot)
    monkeypatch.setattr(graph, "SPREAD", spread)
    rng = random.Random(hot)
    names = ["main", "init", "run", "get", "set_", "x1", "lone", None, ""]
    rows = []
    for i in range(90):
        name = rng.choices(names, [9, 4, 3, 2, 2, 2, 0.2, 1, 1])[0]
        said = rng.choices([*(n for n in names if n), "other", "words"], k=rng.randint(0, 6))
        rows.append((i, name, None if rng.random() < 0.05 else " ".join(said + ([name] if name and rng.random() < 0.5 else []))))
    blocks = spark.createDataFrame(rows, "id long, name string, text string")
    want, degrees = plain_ranks(rows, 12)
    assert {r.src: r.out_degree for r in graph.out_degrees(blocks).collect()} == degrees
    edges = graph.mention_edges(blocks).groupBy("src").count()
    assert {r.src: r["count"] for r in edges.collect()} == degrees
    got = {r.id: r.pr for r in graph.pagerank(blocks, 12, every=5).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_what_is_stored_is_linear_in_mentions(spark):
    """Each of many blocks of a few names says them all: the edges would be quadratic."""
    rows = [(i, f"n{i % 5}", " ".join(f"n{j}" for j in range(5))) for i in range(2000)]
    blocks = spark.createDataFrame(rows, "id long, name string, text string")
    assert graph.mentions(blocks).select(F.sum(F.size("words"))).first()[0] == 5 * 2000
    got = {round(r.pr, 12) for r in graph.pagerank(blocks, 20).collect()}
    assert got == {round(1 / 2000, 12)}


def test_no_blocks_and_no_steps(spark):
    empty = spark.createDataFrame([], "id long, name string, text string")
    assert graph.pagerank(empty).collect() == []
    two = spark.createDataFrame([(1, "a", "b"), (2, "b", "a")], "id long, name string, text string")
    assert [r.pr for r in graph.pagerank(two, 0).collect()] == [0.5, 0.5]


def test_a_step_works_on_pairs_of_names_whatever_the_degrees(spark, monkeypatch):
    """Blocks that say their own name with very many degrees: a step must not hold a row, or bring on a value, for each."""
    rng = random.Random(7)
    names, rows = [f"n{i}" for i in range(8)], []
    for i, name in enumerate(name for k, name in enumerate(names) for _ in range(2**k)):
        rows.append((i, name, " ".join({name, *rng.sample(names, rng.randint(0, 6))})))
    rows.append((len(rows), "alone", "alone n0"))  # one block points to n0 only: the slowest series
    blocks = spark.createDataFrame(rows, "id long, name string, text string")
    assert graph.mentions(blocks).select("name", "deg").distinct().count() > 100
    kept, keep = {}, graph.Tables.keep

    def seen(self, frame, step, *session):
        out = keep(self, frame, step, *session)
        kept[step] = [r.asDict() for r in out.collect()]
        return out

    monkeypatch.setattr(graph.Tables, "keep", seen)
    got = {r.id: r.pr for r in graph.pagerank(blocks, 30, every=10).collect()}
    assert len(kept["held"]) <= 9 * 9 + 9 and sum(len(v) for r in kept["frame-29"] for v in r.values() if isinstance(v, list)) <= 9 * 31
    want, _ = plain_ranks(rows, 30)
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-12 for i in want)


def test_words_that_nobody_asks_for_do_not_move(spark, monkeypatch):
    """Texts of many words meet the names, and then the ranks, by those that are names or are asked for."""
    rows = [(i, f"n{i % 5}", None if i == 7 else " ".join([f"w{i}_{j}" for j in range(50)] + [f"n{i % 3}"] + ["query"] * (i % 4 == 0))) for i in range(40)]
    blocks = spark.createDataFrame(rows, "id long, name string, text string")
    queries = spark.createDataFrame([(1, "query n2"), (2, "w3_1"), (3, None), (4, "of nothing")], "query_id long, query string")
    seen, best_rows = [], graph.scan.best_rows
    monkeypatch.setattr(graph.scan, "best_rows", lambda rows, *a, **b: seen.append(rows) or best_rows(rows, *a, **b))
    got = {(r.query_id, r["rank"], r.id, r.score) for r in graph.graph_rank(blocks, queries, 6, 5).collect()}
    assert max(len(r.tk or ()) for r in seen[0].collect()) == 2 and seen[0].count() == 40
    assert "SortMergeJoin" not in graph.mentions(blocks)._jdf.queryExecution().executedPlan().toString()
    pr, _ = plain_ranks(rows, 5)
    want = set()
    for q, words in ((1, {"query", "n2"}), (2, {"w3_1"}), (3, set()), (4, {"of", "nothing"})):
        scored = sorted((-round(0.7 * len(words & set((t or "").split())) / max(len(words), 1) + 0.3 * pr[i] * 40, 4), i) for i, _, t in rows)
        want |= {(q, n + 1, i, -s) for n, (s, i) in enumerate(scored[:6])}
    assert got == want
    monkeypatch.setattr(graph, "MOST_NAMES", 0)
    monkeypatch.setattr(graph.scan, "MOST_QUERIES", 0)
    assert got == {(r.query_id, r["rank"], r.id, r.score) for r in graph.graph_rank(blocks, queries, 6, 5).collect()}

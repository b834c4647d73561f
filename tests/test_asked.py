"""A generator as reranker, and the cache of answers in front of the search."""

from lodestone.functions import models
from lodestone.operators import fusion
from lodestone.plans.engine import Engine
from lodestone.plans.profiles import Settings
from lodestone.sources.store import BlockStore

BLOCK = "id string, filepath string, function string, code string, line_start int, line_end int, project_id string"


def test_a_generator_scores_the_first_candidates(spark):
    hits = spark.createDataFrame([(1, f"d{i:02d}", 1 - i / 20, 1 - i / 20) for i in range(14)] + [(2, "d00", 0.3, 0.3)], "query_id long, id string, similarity double, score double")
    texts = spark.createDataFrame([(f"d{i:02d}", ("x" * 790 + f"n{i:02d}") + "y" * 5000) for i in range(13)] + [("d13", None)], "id string, text string")
    queries = spark.createDataFrame([(1, "which?"), (2, None)], "query_id long, query string")

    def load():
        def model(prompts):
            assert all(len(p) < 1100 and "yyyyyyyy" not in p for p in prompts)  # 800 characters of text
            place = [int(p[p.index("xn") + 2 :][:2]) if "which?" in p and "xn" in p else 99 for p in prompts]
            return ["none" if n == 3 else f"I say {n + 2} of 10" if n < 99 else "-" for n in place]

        return model

    out = {(r.query_id, r.id): r.rerank_score for r in models.asking_reranker(load, texts, queries)(hits).collect()}
    assert len(out) == 15 and out[1, "d00"] == 0.2 and out[1, "d08"] == 1.0 and out[1, "d09"] == 1.0  # 11 counts as 10
    assert out[1, "d03"] == round(1 - 3 / 20, 4)  # no number: its similarity
    assert out[1, "d10"] == 0.5 and out[1, "d13"] == 0.35 and out[2, "d00"] == 0.3  # beyond the first ten, or no answer
    best = fusion.rerank(hits.where("query_id = 1"), 3, models.asking_reranker(load, texts, queries)).orderBy("rank").collect()
    assert [r.id for r in best] == ["d08", "d09", "d07"]


def test_only_new_texts_are_searched(spark, tmp_path):
    store = BlockStore(spark, str(tmp_path / "s"))
    rows = [(f"{i}", f"f{i}.py", f"name{i}", f"def name{i}(): return {'apple' if i % 2 else 'pear'} {i}", 1, 2, "p") for i in range(6)]
    store.upsert(spark.createDataFrame(rows, BLOCK))
    engine = Engine(spark, store, Settings(profile="python"))
    ask = lambda *qs: spark.createDataFrame(list(qs), "query_id long, query string")
    take = lambda d: {(r.query_id, r["rank"], r.id, r.score) for r in d.collect()}
    first = take(engine.cached_search(ask((1, "apple"), (2, "pear"), (3, "apple")), "p", 3))
    assert engine.searched == 2 and first == take(engine.search(ask((1, "apple"), (2, "pear"), (3, "apple")), "p", 3))
    other = Engine(spark, BlockStore(spark, store.path), Settings(profile="python"))  # another session
    assert {r[1:] for r in take(other.cached_search(ask((9, "pear")), "p", 3))} == {r[1:] for r in first if r[0] == 2} and other.searched == 0
    assert take(engine.cached_search(ask((1, "apple"), (4, "nothing here")), "p", 3)) == {r for r in first if r[0] == 1} and engine.searched == 1
    engine.cached_search(ask((4, "nothing here")), "p", 3)
    assert engine.searched == 0  # that there is nothing is an answer
    store.upsert(spark.createDataFrame([("9", "g.py", "name9", "apple apple apple apple", 1, 2, "p")], BLOCK))
    again = take(engine.cached_search(ask((1, "apple")), "p", 9))  # a new snapshot
    assert "9" in {r[2] for r in again} and engine.searched == 1 and again == take(engine.search(ask((1, "apple")), "p", 9))
    assert engine.cached_search(ask().limit(0), "p", 2).collect() == []

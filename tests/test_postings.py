"""Stored postings against a plain BM25, and lines to blocks in a large file."""

import math
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from lodestone.operators import lexical, postings
from lodestone.operators.postings import Postings
from lodestone.sources import scratch


def plain(docs, queries, k1=1.5, b=0.75):
    words = {i: re.findall("[a-z0-9]+", (t or "").lower()) for i, t, _ in docs}
    mean = sum(map(len, words.values())) / max(len(docs), 1)
    df = {}
    for own in words.values():
        for t in set(own):
            df[t] = df.get(t, 0) + 1
    out = {}
    for q, text in queries:
        for i, own in words.items():
            s = 0.0
            for t in set(re.findall("[a-z0-9]+", text.lower())):
                tf = own.count(t)
                if tf:
                    s += math.log((len(docs) - df[t] + 0.5) / (df[t] + 0.5) + 1) * tf * (k1 + 1) / (tf + k1 * (1 - b + b * len(own) / mean))
            if s > 0:
                out[q, i] = round(s, 4)
    return out


def best(scores, k, group=None):
    by = {}
    for (q, i), s in scores.items():
        by.setdefault((q, group[i] if group else None), []).append((-s, i))
    return {(q, g, i, -s) for (q, g), own in by.items() for s, i in sorted(own)[:k]}


def corpus(seed, n=400):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)]
    docs = [(7 * i, None if i % 97 == 5 else " ".join(rng.choices(words, [1 / (j + 1) for j in range(200)], k=rng.randint(0, 60))).title(), rng.choice(["a", "b", None])) for i in range(n)]
    queries = [(j, " ".join(rng.choices(words, k=rng.randint(1, 6)))) for j in range(25)] + [(100, "absent words"), (101, "")] + [(102, docs[3][1] or "w1")]
    return docs, queries


@pytest.mark.parametrize("block", [4096, 3])
def test_equals_the_scan_and_skips(spark, tmp_path, monkeypatch, block):
    monkeypatch.setattr(postings, "RANGE_DOCS", 8)
    monkeypatch.setattr(postings, "QUERY_BLOCK", block)
    monkeypatch.setattr(postings, "CELLS", 50)
    docs, queries = corpus(block)
    d = spark.createDataFrame(docs, "id long, text string, source string")
    q = spark.createDataFrame(queries, "query_id long, query string")
    index = Postings.build(d, str(tmp_path / "i"), "source")
    assert index.stats["n_docs"] == len(docs) and index.ranges.agg(F.sum("n")).first()[0] == len(docs)
    scores, group, read = plain(docs, queries), {i: g for i, _, g in docs}, []
    rows = index.search(q, 3, read=read).collect()
    got = best({(r.query_id, r.id): r.score for r in rows}, 3)
    assert got == best(scores, 3)
    assert [r[0] for r in read] == ["first", "rest"] and 0 < sum(r[1] for r in read) <= read[0][2]
    rows = index.search(q, 2, by_group=True).collect()
    assert best({(r.query_id, r.id): r.score for r in rows}, 2, group) == best(scores, 2, group)
    whole = lexical.bm25(d, q, 5, index=index).select("query_id", "id", "score", "rank").collect()
    assert sorted(whole) == sorted(lexical.bm25(d, q, 5).select("query_id", "id", "score", "rank").collect())


def test_a_rare_passage_lets_ranges_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(postings, "RANGE_DOCS", 10)
    docs = [(i, f"common words here w{i % 7}", None) for i in range(600)] + [(9000 + i, "a rare passage of common words", None) for i in range(3)]
    d = spark.createDataFrame(docs, "id long, text string, source string").coalesce(2)
    index, read = Postings.build(d, str(tmp_path / "i")), []
    rows = index.search(spark.createDataFrame([(1, "rare passage common")], "query_id long, query string"), 3, read=read).collect()
    assert {i for _, _, i, _ in best({(r.query_id, r.id): r.score for r in rows}, 3)} == {9000, 9001, 9002}
    assert sum(r[1] for r in read) < 0.2 * read[0][2]


def test_empty_documents_and_string_ids(spark, tmp_path):
    q = spark.createDataFrame([(1, "a b")], "query_id long, query string")
    index = Postings.build(spark.createDataFrame([], "id string, text string"), str(tmp_path / "e"))
    assert index.search(q, 3).collect() == []
    index = Postings.build(spark.createDataFrame([("x", "a"), ("y", None), ("z", "")], "id string, text string"), str(tmp_path / "s"))
    assert [(r.query_id, r.id) for r in index.search(q, 3).collect()] == [(1, "x")]


def test_index_is_built_once_a_snapshot(spark, tmp_path):
    at, calls = str(tmp_path / "k"), []

    def build(to):
        calls.append(to)
        spark.range(3).write.parquet(to)

    assert scratch.built(spark, at, build) == scratch.built(spark, at, build) == at and len(calls) == 1
    first = scratch.signature(spark, at)
    assert first == scratch.signature(spark, at)
    spark.range(1).write.mode("append").parquet(at)
    assert scratch.signature(spark, at) != first


def test_lines_meet_blocks_in_one_large_file(spark):
    """A million lines and a hundred thousand blocks of one file, and a class around them."""
    blocks = spark.range(100_000).select(F.lit("f").alias("filepath"), F.concat(F.lit("b"), "id").alias("id"), (F.col("id") * 10 + 1).alias("line_start"), (F.col("id") * 10 + 8).alias("line_end"), F.lit(False).alias("method"))
    around = spark.createDataFrame([("f", "class", 1, 1_000_000, True), ("g", "other", 1, 5, False), ("f", "bad", 9, 3, False)], blocks.schema)
    hits = spark.range(1, 1_000_001).select(F.lit(1).alias("query_id"), F.lit("f").alias("filepath"), F.col("id").alias("line"))
    began = time.time()
    got = lexical.map_lines(hits, blocks.unionByName(around)).groupBy("id").count().groupBy("count").agg(F.count("*").alias("n"), F.max("id").alias("one")).collect()
    assert {(r["count"], r.n, r.one) for r in got} == {(8, 100_000, "b99999"), (200_000, 1, "class")}
    assert time.time() - began < 120


def test_terms_that_go_to_every_task_or_are_joined_give_the_same(spark, tmp_path, monkeypatch):
    docs, queries = corpus(9, 60)
    monkeypatch.setattr(postings, "RANGE_DOCS", 8)
    index = Postings.build(spark.createDataFrame(docs, "id long, text string, source string"), str(tmp_path / "j"), "source")
    assert not (tmp_path / "j" / "raw").exists()  # the index lies on disk once
    q, take = spark.createDataFrame(queries, "query_id long, query string"), lambda d: {tuple(r) for r in d.collect()}
    sent = take(index.search(q, 3, by_group=True))
    monkeypatch.setattr(postings.scan, "MOST_TERMS", 0)
    assert sent and sent == take(index.search(q, 3, by_group=True))

"""Counts of hit lines: many in one document, blocks of files, roundings of contexts."""

import duckdb
import pytest
from pyspark.sql import functions as F

from lodestone.functions import text as X
from lodestone.operators import lexical, scan

QUERIES = [(1, "where is alpha"), (2, "beta gamma"), (3, None), (4, "the of")]


@pytest.fixture
def queries(spark):
    return spark.createDataFrame(QUERIES, "query_id long, query string")


def test_more_than_255_like_lines_in_a_document(spark, queries):
    docs = spark.createDataFrame([(1, "alpha\n" * 643), (2, "xbeta_x\nAlpha gamma\nnone"), (3, None)], "id long, text string")
    got = {(r.query_id, r.id, r.score) for r in lexical.grep(docs, queries, 5).collect()}
    assert got == {(1, 1, 643.0), (1, 2, 1.0), (2, 2, 2.0)}


def test_counts_of_lines_are_those_of_hit_rows(spark, queries, monkeypatch):
    docs = spark.createDataFrame([(i, "\n".join(f"{'alpha' if (i + j) % 3 else 'x'} {'beta' if j % 4 == i % 4 else ''}" for j in range(300)), ) for i in range(9)] + [(None, "gamma"), (20, None)], "id long, text string")
    monkeypatch.setattr(lexical, "line_hits", None)  # no row for a line
    got = {tuple(r) for r in lexical.line_counts(docs, queries).collect()}
    monkeypatch.undo()
    assert {q for q, *_ in got} == {1, 2}
    monkeypatch.setattr(scan, "MOST_QUERIES", 0)
    assert got == {tuple(r) for r in lexical.line_counts(docs, queries).collect()}


def test_blocks_counted_in_one_pass_like_rows_of_lines(spark, queries, monkeypatch):
    files = spark.createDataFrame([(f"f{i}", "\n".join(["alpha", "beta", "Alpha beta", "none"][(i + j) % 4] for j in range(700))) for i in range(4)] + [("n", None), ("bare", "alpha")], "filepath string, text string")
    blocks = files.where("text IS NOT NULL AND filepath <> 'bare'").select("filepath", F.explode(F.sequence(F.lit(0), F.lit(72))).alias("b"))  # the last ones lie behind the end
    blocks = blocks.select(F.concat_ws(":", "filepath", "b").alias("id"), "filepath", (F.col("b") * 10 + 1).alias("line_start"), (F.col("b") * 10 + 8 + F.col("b") % 5).alias("line_end"), F.lit(False).alias("method"))
    blocks = blocks.unionByName(spark.createDataFrame([("f0:class", "f0", 1, 700, True), ("f1:bad", "f1", 9, 3, False), ("f2:null", "f2", 5, 30, None), ("n:1", "n", 1, 2, False)], blocks.schema.simpleString()[7:-1].replace(":", " ")))
    monkeypatch.setattr(lexical, "map_lines", None)
    got = [{(r.query_id, r.id, r.score, r["rank"]) for r in lexical.grep_blocks(files, blocks, queries, k).collect()} for k in (5, 500)]
    monkeypatch.undo()
    assert max(s for _, _, s, _ in got[1]) > 15  # the class has what lies between
    monkeypatch.setattr(scan, "MOST_QUERIES", 0)
    assert got == [{(r.query_id, r.id, r.score, r["rank"]) for r in lexical.grep_blocks(files, blocks, queries, k).collect()} for k in (5, 500)]


def test_hit_lines_round_like_sql(spark):
    """0.5005 and the like lie below the tie as binary numbers."""
    d = spark.range(10_001).select((F.col("id") / 10_000).alias("s"))
    line = X.hit_line(F.lit(1), F.lit("f"), F.lit("p"), F.col("s"), F.lit("c"))
    got = [r.l for r in d.orderBy("s").select(line.alias("l")).collect()]
    want = duckdb.execute("SELECT '1. f (p) ' || printf('%.3f', round(x / 10000.0::DOUBLE, 3)) || chr(10) || 'c' FROM range(10001) t(x) ORDER BY x").fetchall()
    assert got == [w for (w,) in want]

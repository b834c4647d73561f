"""The registered queries against their SQL on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.llm import queries
from lodestone.llm.storage import Scratch, clean

DIR = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_sql_says_the_same(spark, name):
    c = duckdb.connect()
    for t in ("documents", "embeddings", "labels", "conversations"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    out = queries.QUERIES[name](spark, DIR)
    want = c.execute(queries.SQL[name])
    names = [x[0] for x in want.description]
    assert sorted(names) == sorted(out.columns)
    assert sorted(str([r[n] for n in names]) for r in out.collect()) == sorted(str(list(r)) for r in want.fetchall())


def test_every_operator_is_registered():
    assert [n.split("_")[0] for n in queries.QUERIES] == [f"op{i}" for i in range(1, 14)]


def test_scratch_tables_can_be_cleaned(spark):
    s = Scratch(spark, "t")
    assert s.keep(spark.range(3), "x").count() == 3
    at = s.at
    clean(spark)
    assert not os.path.exists(at.removeprefix("file:")) and not Scratch.made

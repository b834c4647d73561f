"""Every registered query against its DuckDB oracle on the smallest tables."""

import os

import duckdb
import pytest

from lodestone.plans import catalog

DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
QUERIES, SQL = catalog.queries(), catalog.oracle_sql()
pytestmark = pytest.mark.skipif(not os.path.isdir(DIR), reason="needs the test tables")


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    return c


def plain(v):
    return round(v, 6) if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    out = QUERIES[name](spark, DIR)
    rows = out.collect()
    if name not in SQL:
        assert rows
        return
    rel = duck.execute(SQL[name])
    names = [c[0] for c in rel.description]
    assert sorted(names) == sorted(out.columns)
    want = sorted(str([plain(dict(zip(names, r, strict=True))[c]) for c in sorted(names)]) for r in rel.fetchall())
    assert sorted(str([plain(r[c]) for c in sorted(names)]) for r in rows) == want


def test_flagship(spark):
    assert catalog.flagship(spark, DIR).count() > 0


def test_entry_module_registers_all():
    import __spark_entry__ as entry

    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())
    assert set(entry.oracle_sql()) <= set(entry.queries())

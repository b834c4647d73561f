"""The registered fusions, where a document or a query has no id."""

import duckdb
import pytest

from lodestone.operators import scan
from lodestone.operators.postings import Postings
from lodestone.plans import catalog

TEXTS = ["alpha beta", "alpha\nalpha", "beta gamma", "gamma", "alpha beta gamma", None]
DOCS = [(i, t, f"s{i % 2}.alpha.txt", "en") for i, t in enumerate(TEXTS)] + [(None, "alpha\nbeta", "s0.alpha.txt", "en")]
ASKED = [(0, "where is alpha"), (1, "beta gamma"), (2, "of the"), (None, "alpha beta")]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("nulls")
    spark.createDataFrame(DOCS, "doc_id long, text string, source string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(ASKED, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, float(i), float(i * i % 7)], i % 2) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["hybrid_topk", "minmax_normalise", "rrf_fusion"])
def test_null_ids_like_sql(spark, tables, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, str(tables)).select(*columns).collect()
    assert got and sorted(map(str, map(tuple, got))) == sorted(map(str, want.fetchall()))


def test_index_without_ids(spark, tmp_path, monkeypatch):
    docs = spark.createDataFrame([d[:2] for d in DOCS], "id long, text string")
    index, asked = Postings.build(docs, str(tmp_path / "index")), spark.createDataFrame(ASKED, "query_id long, query string")
    sent = sorted(map(str, index.search(asked, 10).collect()))
    assert len(sent) == 3 + 4 + 4  # documents with an id that hold a word of the query
    monkeypatch.setattr(scan, "MOST_QUERIES", 0)
    assert sorted(map(str, index.search(asked, 10).collect())) == sent

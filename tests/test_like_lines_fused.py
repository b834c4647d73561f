"""The registered fusions, where a document holds more than 255 lines that the same queries match."""

import duckdb
import pytest

from lodestone.plans import catalog

TEXTS = ["alpha\n" * 643, "alpha beta\n" * 256 + "gamma", "beta\n" * 255, "var.alpha x\nbeta", "none", None]
ASKED = ["where is alpha", "beta gamma", "alpha beta", "of the", "var.alpha"]


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    at = tmp_path_factory.mktemp("fused")
    spark.createDataFrame([(i, t, f"s{i % 2}.txt", "en") for i, t in enumerate(TEXTS)], "doc_id long, text string, source string, lang string").write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(list(enumerate(ASKED)), "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([(i, [1.0, float(i), float(i * i % 7)], i % 2) for i in range(5)], "vec_id long, embedding array<float>, label int").write.parquet(f"{at}/embeddings.parquet")
    return at


@pytest.mark.parametrize("name", ["hybrid_topk", "minmax_normalise", "rrf_fusion"])
def test_fused_like_sql(spark, tables, name):
    db = duckdb.connect()
    for t in ("documents", "benchmark", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{tables}/{t}.parquet/*.parquet')")
    want = db.execute(catalog.oracle_sql()[name])
    columns = [c[0] for c in want.description]
    got = catalog.queries()[name](spark, str(tables)).select(*columns).collect()
    assert got and sorted(map(tuple, got)) == sorted(want.fetchall())

"""The registered queries of the retrieval operators, with their oracles."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import catalog_rules, catalog_search, catalog_tables, catalog_text

_PARTS = (catalog_search, catalog_text, catalog_tables, catalog_rules)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog_search.hybrid_topk(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: f for part in _PARTS for name, f in part.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for part in _PARTS for name, sql in part.SQL.items()}

"""All core queries by name, with their SQL. Every module below adds its own entries."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lakeweave.plans import building, lake, listings, packed, records, relevance, samples, search

MODULES = (packed, lake, search, samples, records, building, relevance, listings)
FLAGSHIP = "tiered_rerank"


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {name: query for module in MODULES for name, query in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: sql for module in MODULES for name, sql in module.SQL.items()}

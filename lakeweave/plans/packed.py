"""Queries over fields that hold several values."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import unpack
from lakeweave.runtime import table


def p3_found(spark: SparkSession, root: str) -> DataFrame:
    return unpack.packed_authors(table(spark, root, "abebooks"))


def p3_values(spark: SparkSession, root: str) -> DataFrame:
    """Every value of every listing with how it was written and what was wrong with it."""
    single = unpack.latest_field(table(spark, root, "abebooks"), "listing_id", "authors", "loaded_at")
    return unpack.unpack(single, "authors", ("listing_id",), "author")


def p3_report(spark: SparkSession, root: str) -> DataFrame:
    return p3_values(spark, root).groupBy("kind", "flag").agg(F.count("*").alias("n_values"), F.countDistinct("listing_id").alias("n_listings"))


QUERIES = {"p3_found": p3_found, "p3_values": p3_values, "p3_report": p3_report}
SQL: dict[str, str] = {}

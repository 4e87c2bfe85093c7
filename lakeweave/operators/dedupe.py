"""Winners among repeated records, content classes, components, set audits."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.text import batched
from lakeweave.runtime import settle


def winner(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    return df.withColumn("__r", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter("__r = 1").drop("__r")


def winners_and_losers(df: DataFrame, by: list[str], order: list[Column]) -> DataFrame:
    """Every row with its place among the rows of its key; place 1 is kept, the others are an audit."""
    return df.withColumn("place", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))


_nfc = batched(lambda x: unicodedata.normalize("NFC", x.replace("\r\n", "\n").replace("\r", "\n")))


def content_digest(c: Column) -> Column:
    """SHA-256 of a text in NFC with one kind of line end; plain ASCII without returns is hashed as it is."""
    needs = c.rlike(r"[^\x00-\x7F]") | c.contains("\r")
    return F.sha2(F.when(needs, _nfc(F.when(needs, c))).otherwise(c), 256)


def aliases(assets: DataFrame, key: str, kind: str, content: str) -> DataFrame:
    """(key, canonical): the smallest key of equal content within a kind.

    Digests are aggregated with map-side combine and joined back; a content that a third of all
    assets share is one row of the smaller side, and adaptive execution splits the larger one."""
    d = assets.filter(F.col(content).isNotNull()).select(key, kind, content_digest(F.col(content)).alias("digest")).distinct()
    least = d.groupBy(kind, "digest").agg(F.min(key).alias("canonical"), F.count("*").alias("copies"))
    return d.join(least, [kind, "digest"]).select(key, kind, "canonical", "copies")


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of string edges (a, b) by smallest label with pointer jumping; every round is
    written to the shared folder."""
    e = settle(edges.filter("a is not null and b is not null").select("a", "b").unionByName(edges.filter("a is not null and b is not null").select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = settle(e.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("component")))
    for _ in range(rounds):
        near = e.join(label.select(F.col("node").alias("b"), "component"), "b").groupBy(F.col("a").alias("node")).agg(F.min("component").alias("seen"))
        low = label.join(near, "node", "left").select("node", F.least("component", F.coalesce("seen", "component")).alias("component"), F.col("component").alias("old"))
        jump = low.join(low.select(F.col("node").alias("component"), F.col("component").alias("root")), "component", "left")
        new = settle(jump.select("node", F.least("component", F.coalesce("root", "component")).alias("component"), "old"))
        if new.filter("component <> old").isEmpty():
            return new.select("node", "component")
        label = new.select("node", "component")
    raise RuntimeError(f"labels did not settle in {rounds} rounds")


def torn_keys(df: DataFrame, key: str, split: str) -> DataFrame:
    """Keys that stand in more than one split."""
    return df.filter(F.col(key).isNotNull() & F.col(split).isNotNull()).groupBy(key).agg(F.min(split).alias("first_split"), F.max(split).alias("last_split"), F.count("*").alias("n")).filter("first_split <> last_split")


def dangling(df: DataFrame, key: str, keys: DataFrame, other: str) -> DataFrame:
    """Rows whose key is not among the other side's keys."""
    return df.filter(F.col(key).isNotNull()).join(keys.select(F.col(other).alias(key)).distinct(), key, "left_anti")

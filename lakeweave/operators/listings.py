"""Book listings: grouping into tables, joins judged by the books they meet, listings of a detail page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.books import context_key, matching_key
from lakeweave.functions.text import bare_url, normalize, text_key


def by_value(df: DataFrame, value: str, least: int, tail: str = "tail") -> DataFrame:
    """Adds ``part``: the row's value, or ``tail`` for values of fewer than ``least`` rows and for null."""
    n = df.groupBy(value).agg(F.count("*").alias("__n")).filter(F.col("__n") >= least).select(F.col(value).alias("__v"))
    return df.join(n, F.col(value) == F.col("__v"), "left").withColumn("part", F.coalesce("__v", F.lit(tail))).drop("__v")


def judged_pairs(queries: DataFrame, targets: DataFrame, key) -> DataFrame:
    """(query, target, row, other, status, adds): rows of queries (query, row, book, title, join) and of
    targets (target, other, book, title, join, added) that meet on ``key`` of the join value, each judged:
    the same book, another of the same title, or a different one."""
    keyed = lambda df, drop: df.withColumn("__k", key(F.col("join"))).filter("__k <> ''").withColumn("__t", text_key("title")).drop("join", "title", *drop)
    q, t = keyed(queries, []), keyed(targets, []).withColumnsRenamed({"book": "__book", "__t": "__title"})
    status = F.when(F.col("book") == F.col("__book"), "same_book").when(F.col("__t") == F.col("__title"), "same_title").otherwise("different_book")
    return q.join(t, "__k").select("query", "target", "row", "other", status.alias("status"), (F.coalesce(F.col("added").cast("string"), F.lit("")) != "").alias("adds"))


def judged_joins(pairs: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, target, status, reason): a join is negative if it meets a different book or does not add
    to every query row, unjudged if it rests on equal titles, else positive."""
    size = queries.groupBy("query").agg(F.countDistinct("row").alias("rows"))
    per = pairs.groupBy("query", "target").agg(F.max(F.col("status") == "different_book").alias("wrong"), F.max(F.col("status") == "same_title").alias("unsure"), F.countDistinct(F.when(F.col("adds"), F.col("row"))).alias("covered"))
    reason = F.when(F.col("wrong"), "different_book").when(F.col("covered") < F.col("rows"), "incomplete").when(F.col("unsure"), "same_title").otherwise("complete")
    status = F.when(F.col("wrong") | (F.col("covered") < F.col("rows")), "negative").when(F.col("unsure"), "unjudged").otherwise("positive")
    return per.join(size, "query").select("query", "target", status.alias("status"), reason.alias("reason"))


def author_joins(queries: DataFrame, targets: DataFrame) -> DataFrame:
    return judged_pairs(queries, targets, matching_key)


def context_shortcuts(queries: DataFrame, targets: DataFrame, column: str, least: int = 2) -> DataFrame:
    """(query, target): targets that the visible context column alone joins usefully: at least ``least``
    query rows gain a value and no different book is met."""
    pairs = judged_pairs(queries, targets, lambda c: context_key(c, F.lit(column)))
    per = pairs.groupBy("query", "target").agg(F.max(F.col("status") == "different_book").alias("wrong"), F.countDistinct(F.when(F.col("adds"), F.col("row"))).alias("useful"))
    return per.filter(~F.col("wrong") & (F.col("useful") >= least)).select("query", "target")


def detail_listing(book: DataFrame, listings: DataFrame, key: str) -> DataFrame:
    """(key, method, listings): which listings of a book its detail page describes, by the first test that
    finds any: the seller's address, the seller's name, title and authors; else none."""
    own = book.select(key, bare_url("seller_url").alias("u"), normalize("seller_name").alias("s"), normalize("title").alias("t"), normalize("authors").alias("a"))
    card = listings.select(key, "listing_id", bare_url("seller_url").alias("lu"), normalize("seller_name").alias("ls"), normalize("title").alias("lt"), normalize("authors").alias("la"))
    j = own.join(card, key, "left")
    tests = [("seller_url", F.col("u") == F.col("lu")), ("seller_name", (F.col("s") != "") & (F.col("s") == F.col("ls"))), ("title_authors", (F.col("t") != "") & (F.col("t") == F.col("lt")) & (F.col("a") == F.col("la")))]
    hits = lambda test: F.array_sort(F.collect_set(F.when(test, F.col("listing_id"))))
    g = j.groupBy(key).agg(*[hits(test).alias(name) for name, test in tests])
    method, found = F.lit("none"), F.array().cast(g.schema[tests[0][0]].dataType)
    for name, _ in reversed(tests):
        some = F.size(name) > 0
        method, found = F.when(some, name).otherwise(method), F.when(some, F.col(name)).otherwise(found)
    return g.select(key, method.alias("method"), found.alias("listings"))


def first_rows(df: DataFrame, by: str, order: str, rows: int) -> DataFrame:
    """Views of the first ``rows`` rows per key, as queries show them; adds ``row``."""
    place: Column = F.row_number().over(Window.partitionBy(by).orderBy(order))
    return df.withColumn("row", place).filter(F.col("row") <= rows)

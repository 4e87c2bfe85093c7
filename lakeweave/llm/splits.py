"""Train, dev and test anew so that related records stay together.

Components come from hash-to-min: every node keeps a cluster, sends its members to the cluster's
smallest node and that node to its members, until nothing changes. Clusters are rows (node, member),
never arrays, so no node's cluster has to fit anywhere. Components are then assigned by weighted
rendezvous hashing: the split with the largest -weight / ln(u) of its own hash u wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.runtime import settle

SPLITS = (("train", 0.8), ("dev", 0.1), ("test", 0.1))


def hash_to_min(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component) of undirected string edges (a, b); the component is its smallest node.

    Nodes without an edge do not occur in ``edges`` and are their own component. Self loops give a
    component of one node. Null ends are left out. Every round is cut by a written table.
    """
    e = edges.filter("a is not null and b is not null")
    pairs = settle(
        e.select(F.col("a").alias("v"), F.col("b").alias("u"))
        .unionByName(e.select(F.col("b").alias("v"), F.col("a").alias("u")))
        .unionByName(e.select(F.col("a").alias("v"), F.col("a").alias("u")))
        .unionByName(e.select(F.col("b").alias("v"), F.col("b").alias("u")))
        .distinct()
    )
    before = None
    for _ in range(rounds):
        least = pairs.groupBy("v").agg(F.min("u").alias("m"))
        sent = pairs.join(least, "v")
        pairs = settle(
            sent.select(F.col("m").alias("v"), "u").unionByName(sent.select(F.col("u").alias("v"), F.col("m").alias("u"))).distinct()
        )
        now = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first())
        if now == before:
            break
        before = now
    else:
        raise RuntimeError(f"hash-to-min did not settle in {rounds} rounds")
    return pairs.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("component"))


def page_key(title: Column) -> Column:
    """A page title without case, underscores and blanks; null if nothing is left."""
    key = F.regexp_replace(F.lower(title), r"(?U)[_\s​﻿­]+", "")
    return F.when(key != "", key)


def split_label(split: Column) -> Column:
    """The split without case and blanks; null or blank is none."""
    label = F.regexp_replace(F.lower(split), r"(?U)\s+", "")
    return F.when(label != "", label)


def source_components(tables: DataFrame) -> DataFrame:
    """(source_table_id, component) of every delivered source table.

    A source is first reduced to its smallest page, so hash-to-min runs on pages only, over the few
    sources that were delivered under several pages; a page with a third of all tables is one node.
    """
    seen = tables.select("source_table_id", page_key(F.col("pgtitle")).alias("page")).filter("source_table_id is not null").distinct()
    first = seen.groupBy("source_table_id").agg(F.min("page").alias("page0"), F.max("page").alias("page9"))
    several = first.filter("page0 <> page9").select("source_table_id", "page0")
    edges = seen.join(several, "source_table_id").filter("page is not null and page <> page0").select(F.col("page0").alias("a"), F.col("page").alias("b")).distinct()
    component = hash_to_min(edges)
    return first.join(component, F.col("page0") == F.col("node"), "left").select(
        "source_table_id",
        F.when(F.col("page0").isNull(), F.concat(F.lit("s:"), "source_table_id")).otherwise(F.concat(F.lit("p:"), F.coalesce("component", "page0"))).alias("component"),
    )


def view_components(views: DataFrame, tables: DataFrame) -> DataFrame:
    """Distinct (table_id, source_table_id, split, component); a dangling source is its own group,
    a view without source stands alone."""
    own = views.select("table_id", "source_table_id", split_label(F.col("split")).alias("split")).distinct()
    joined = own.join(source_components(tables), "source_table_id", "left")
    alone = F.when(F.col("source_table_id").isNotNull(), F.concat(F.lit("s:"), "source_table_id")).otherwise(F.concat(F.lit("v:"), "table_id"))
    return joined.select("table_id", "source_table_id", "split", F.coalesce("component", alone).alias("component"))


def rendezvous(component: Column, splits=SPLITS, seed: str = "0") -> Column:
    """Weighted rendezvous hashing: a split of the given weights, the same on every run."""
    scored = []
    for name, weight in splits:
        digits = F.substring(F.md5(F.concat(F.lit(f"{seed}|{name}|"), component)), 1, 13)
        u = (F.conv(digits, 16, 10).cast("double") + 0.5) / float(16**13)
        scored.append(F.struct((F.lit(-float(weight)) / F.log(u)).alias("score"), F.lit(name).alias("name")))
    return F.sort_array(F.array(*scored), asc=False)[0]["name"]


def torn_views(views: DataFrame, tables: DataFrame) -> DataFrame:
    """Views with a split and a source whose group holds two or more different splits."""
    known = settle(view_components(views, tables).filter("split is not null and source_table_id is not null"))
    torn = known.groupBy("component").agg(F.min("split").alias("a"), F.max("split").alias("z")).filter("a <> z").select("component")
    return known.join(torn, "component", "left_semi").select("table_id").distinct()


def assign_splits(views: DataFrame, tables: DataFrame, splits=SPLITS, seed: str = "0") -> DataFrame:
    """Every view with its new split; views of one group always get the same one.

    Views of null key are left out; a view delivered under several sources keeps the smallest
    group's split. Empty inputs give no rows.
    """
    known = view_components(views, tables).filter("table_id is not null")
    return known.groupBy("table_id").agg(F.min("component").alias("component")).select("table_id", "component", rendezvous(F.col("component"), splits, seed).alias("new_split"))


def split_shares(assigned: DataFrame) -> DataFrame:
    """Per new split: its views, their share of all, its groups and the views of its largest group,
    so that a group too large for the wanted proportions is seen."""
    groups = assigned.groupBy("new_split", "component").agg(F.count("*").alias("n"))
    per = groups.groupBy("new_split").agg(F.sum("n").alias("n_views"), F.count("*").alias("n_groups"), F.max("n").alias("largest_group"))
    total = per.agg(F.sum("n_views").alias("total"))
    return per.join(F.broadcast(total)).select("new_split", "n_views", (F.col("n_views") / F.col("total")).alias("share"), "n_groups", "largest_group")

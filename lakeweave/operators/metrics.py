"""Ranking metrics and their statistics."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.operators.ranking import running_sum

CUTOFFS = (5, 10, 20)


def rank_metrics(ranked: DataFrame, gold: DataFrame, cutoffs: tuple[int, ...] = CUTOFFS) -> DataFrame:
    """Per query recall, precision and binary nDCG at the cutoffs; queries without a hit score 0.

    ``ranked`` (query_id, target_id, rank), ``gold`` (query_id, target_id); both distinct.
    """
    size = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hit = ranked.join(gold, ["query_id", "target_id"], "left_semi")
    aggs = []
    for k in cutoffs:
        inside = F.col("rank") <= k
        aggs += [F.count_if(inside).alias(f"h{k}"), F.sum(F.when(inside, 1 / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias(f"d{k}")]
    per = size.join(hit.groupBy("query_id").agg(*aggs), "query_id", "left")
    out = [F.col("query_id"), F.col("n_gold")]
    for k in cutoffs:
        ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.lit(k), F.col("n_gold")).cast("int")), F.lit(0.0), lambda s, i: s + 1 / F.log2(i + 1))
        h, d = F.coalesce(f"h{k}", F.lit(0)), F.coalesce(f"d{k}", F.lit(0.0))
        out += [F.round(h / F.col("n_gold"), 6).alias(f"recall_{k}"), F.round(h / k, 6).alias(f"precision_{k}"), F.round(d / ideal, 6).alias(f"ndcg_{k}")]
    return per.select(*out)


def graded_metrics(ranked: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Mean recall, graded nDCG (2^rel - 1) and reciprocal rank over all queries with judgments."""
    gain = F.pow(F.lit(2.0), F.col("rel")) - 1
    ideal_rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("rel"), "target_id"))
    ideal = qrels.withColumn("i", ideal_rank).groupBy("query_id").agg(F.sum(F.when(F.col("i") <= k, gain / F.log2(F.col("i") + 1))).alias("ideal"), F.count_if(F.col("rel") > 0).alias("n"))
    got = ranked.join(qrels.filter("rel > 0"), ["query_id", "target_id"]).groupBy("query_id").agg(
        F.sum(F.when(F.col("rank") <= k, gain / F.log2(F.col("rank") + 1)).otherwise(0.0)).alias("dcg"), F.count_if(F.col("rank") <= k).alias("h"), F.min("rank").alias("first")
    )
    j = ideal.join(got, "query_id", "left")
    z = lambda c: F.coalesce(F.col(c), F.lit(0))
    return j.agg(
        F.count("*").alias("queries"),
        F.round(F.avg(z("h") / F.col("n")), 6).alias("recall"),
        F.round(F.avg(z("dcg") / F.col("ideal")), 6).alias("ndcg"),
        F.round(F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))), 6).alias("mrr"),
    )


def by_segment(per_query: DataFrame, segment: str, metrics: list[str]) -> DataFrame:
    """Means overall and per segment in one aggregation."""
    means = per_query.rollup(segment).agg(F.grouping(segment).alias("g"), F.count("*").alias("queries"), *[F.round(F.avg(m), 6).alias(m) for m in metrics])
    return means.select(F.when(F.col("g") == 1, "overall").otherwise(F.col(segment)).alias("segment"), "queries", *metrics)


def auc(df: DataFrame, score: str, positive: str) -> DataFrame:
    """Rank AUC with average ranks for ties. Scores are counted first, so ties cost one row, and ranked
    by ranges, so no task sorts them all."""
    n = df.groupBy(score).agg(F.count("*").alias("n"), F.count_if(positive).alias("p"))
    ranked = running_sum(n, [score], F.col("n"), "upto").withColumn("avg_rank", F.col("upto") - (F.col("n") - 1) / 2)
    s = ranked.agg(F.sum(F.col("p") * F.col("avg_rank")).alias("r"), F.sum("p").alias("p"), F.sum(F.col("n") - F.col("p")).alias("q"))
    return s.select(F.round((F.col("r") - F.col("p") * (F.col("p") + 1) / 2) / (F.col("p") * F.col("q")), 6).alias("auc"), F.col("p").alias("positives"), F.col("q").alias("negatives"))


def group_bootstrap(deltas: DataFrame, group: str, delta: str, replicates: int = 10_000, seed: int = 7) -> DataFrame:
    """Mean difference with a 95 % interval; whole groups are drawn.

    Groups are reduced to their sum and size first. Every group draws its own number of copies for each
    replicate, Poisson with mean one, from its own seed; a task adds these up for its groups and leaves
    one row of sums, so the groups are never brought together and the result does not depend on how
    they are spread."""
    sums = deltas.groupBy(F.col(group).cast("string").alias("g")).agg(F.sum(delta).cast("double").alias("s"), F.count(delta).alias("n"))
    wins = deltas.agg(F.count_if(F.col(delta) > 1e-12).alias("w"), F.count_if(F.col(delta) < -1e-12).alias("l"), F.count_if(F.abs(delta) <= 1e-12).alias("t"))

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total, size = np.zeros(replicates), np.zeros(replicates)
        for pdf in batches:
            for h, s, n in zip(pdf["h"].tolist(), pdf["s"].tolist(), pdf["n"].tolist(), strict=True):
                copies = np.random.default_rng([seed, h & 0xFFFFFFFF, (h >> 32) & 0xFFFFFFFF]).poisson(1.0, replicates)
                total += copies * s
                size += copies * n
        yield pd.DataFrame({"total": [total], "size": [size]})

    parts = sums.select(F.xxhash64("g").alias("h"), "s", "n").mapInPandas(draw, "total array<double>, size array<double>")
    each = parts.select(F.posexplode(F.arrays_zip("total", "size")).alias("i", "x")).groupBy("i").agg(F.try_divide(F.sum("x.total"), F.sum("x.size")).alias("mean"))
    bounds = each.filter("mean is not null").agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    mean = sums.agg(F.try_divide(F.sum("s"), F.sum("n")).alias("delta")).filter("delta is not null")
    return mean.crossJoin(bounds).select("delta", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")).crossJoin(wins)


def unmatched(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys of one side only: an empty result proves that two populations are the same."""
    a, b = left.select(key).distinct().withColumn("l", F.lit(1)), right.select(key).distinct().withColumn("r", F.lit(1))
    return a.join(b, key, "full_outer").filter("l is null or r is null").select(key, F.when(F.col("l").isNull(), "right").otherwise("left").alias("side"))


def paired_contrast(method: DataFrame, reference: DataFrame, group: str, metrics: list[str], replicates: int = 10_000, seed: int = 7) -> DataFrame:
    """(metric, delta, low, high, w, l, t): differences of two evaluations of the same queries, (query_id,
    group, metrics...), with bootstrap intervals over whole groups. Populations that are not the same,
    with each query once and under one group, raise."""
    keys = ["query_id", group]
    for side in (method, reference):
        if not side.groupBy("query_id").count().filter("count > 1").isEmpty():
            raise ValueError("a query occurs twice")
    place = F.to_json(F.struct(*keys))
    if not unmatched(method.select(place.alias("k")), reference.select(place.alias("k")), "k").isEmpty():
        raise ValueError("the evaluations cover different queries")
    both = method.select(*keys, *[F.col(m).alias(f"__{m}") for m in metrics]).join(reference.select("query_id", *metrics), "query_id")
    out = None
    for m in metrics:
        one = group_bootstrap(both.select(group, (F.col(f"__{m}") - F.col(m)).alias("d")), group, "d", replicates, seed).withColumn("metric", F.lit(m))
        out = one if out is None else out.unionByName(one)
    return out.select("metric", "delta", "low", "high", "w", "l", "t")

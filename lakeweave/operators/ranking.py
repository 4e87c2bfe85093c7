"""Rankings: stable top k, fusion, tiers, admission, caps, interleaving, softmax over groups."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def top_k(df: DataFrame, by: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of every group. Spark limits each task's rows before the shuffle."""
    return df.withColumn(rank, F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col(rank) <= k)


def rrf(df: DataFrame, by: str, item: str, first: str, second: str, constant: int = 60) -> DataFrame:
    """Reciprocal-rank fusion of two ranks; ties keep the first ranking, then the smaller item."""
    score = F.round(1 / (constant + F.col(first)) + F.coalesce(1 / (constant + F.col(second)), F.lit(0.0)), 12)
    order = Window.partitionBy(by).orderBy(F.desc("score"), first, item)
    return df.withColumn("score", score).withColumn("fused_rank", F.row_number().over(order))


def tier_order(df: DataFrame, by: str, item: str, bridge: str, vis_idf: str, vis_row: str, first: str) -> DataFrame:
    """Bridged items first by bridge score, then visibly matching ones by weighted score, then the rest.

    The tier looks at the raw scores, the order within it at the rounded ones."""
    tier = F.when(F.col(bridge) > 0, 1).when(F.col(vis_idf) > 0, 2).otherwise(3)
    out = df.withColumn("tier", tier)
    order = Window.partitionBy(by).orderBy(
        "tier",
        F.when(F.col("tier") == 1, -F.round(bridge, 8)).when(F.col("tier") == 2, -F.round(vis_idf, 12)),
        F.when(F.col("tier") == 2, -F.round(vis_row, 8)),
        first,
        item,
    )
    return out.withColumn("tier_rank", F.row_number().over(order))


def log_softmax(df: DataFrame, by: list[str], value: str, out: str) -> DataFrame:
    w = Window.partitionBy(*by)
    top = F.max(value).over(w)
    return df.withColumn("__m", top).withColumn(out, F.col(value) - F.col("__m") - F.log(F.sum(F.exp(F.col(value) - F.col("__m"))).over(w))).drop("__m")


def log_sum_exp(df: DataFrame, by: list[str], value: str, out: str, mean: bool = False) -> DataFrame:
    """Log of the sum (or mean) of exponentials per group, shifted by the group's maximum. Two
    aggregations with map-side combine; no window over a hot group."""
    top = df.groupBy(*by).agg(F.max(value).alias("__m"))
    s = df.join(top, by).groupBy(*by).agg(F.first("__m").alias("__m"), F.sum(F.exp(F.col(value) - F.col("__m"))).alias("__s"), F.count(value).alias("__n"))
    total = F.col("__m") + F.log("__s")
    return s.select(*by, (total - F.log("__n") if mean else total).alias(out))


def cap_then_cut(df: DataFrame, by: str, inner: str, order: list[Column], cap: int, budget: int) -> DataFrame:
    """At most ``cap`` rows per inner group, then the first ``budget`` of each group."""
    capped = top_k(df, [by, inner], order, cap, "inner_rank")
    return top_k(capped, [by], order, budget, "rank")


def round_robin(df: DataFrame, within: list[str], lane: str, order: list[Column], out: str = "position") -> DataFrame:
    """Interleaves the lanes of a block: the first of each lane, then the second of each."""
    turn = df.withColumn("turn", F.row_number().over(Window.partitionBy(*within, lane).orderBy(*order)))
    first = turn.withColumn("__lane_first", F.min(F.when(F.col("turn") == 1, F.struct(*order))).over(Window.partitionBy(*within, lane)))
    return first.withColumn(out, F.row_number().over(Window.partitionBy(*within).orderBy("turn", "__lane_first"))).drop("__lane_first")


def descending(df: DataFrame, by: str, position: str, score: str) -> DataFrame:
    """Rows whose score exceeds the one before them: an empty result proves a ranked list."""
    return df.withColumn("__p", F.lag(score).over(Window.partitionBy(by).orderBy(position))).filter(F.col(score) > F.col("__p")).drop("__p")


def windows(length: Column, size: int, overlap: int) -> Column:
    """Begin and end of overlapping windows of ``size`` over ``length`` tokens."""
    step = size - overlap
    n = F.greatest(F.lit(1), F.ceil((length - overlap) / step)).cast("int")
    return F.when(length > 0, F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct((i * step).cast("int").alias("begin"), F.least(i * step + size, length).cast("int").alias("end")))).otherwise(F.array().cast("array<struct<begin:int,end:int>>"))


def peak_span(scores: list[float], budget: int) -> tuple[int, int]:
    """A span around the highest score, grown towards its stronger neighbour up to ``budget``."""
    if not scores:
        return (0, 0)
    a = b = max(range(len(scores)), key=lambda i: (scores[i], -i))
    while b - a + 1 < min(budget, len(scores)):
        left = scores[a - 1] if a else -math.inf
        right = scores[b + 1] if b + 1 < len(scores) else -math.inf
        if left >= right:
            a -= 1
        else:
            b += 1
    return (a, b + 1)


def in_ranges(df: DataFrame, order: list[str]) -> DataFrame:
    """The rows cut into ranges of ``order``, numbered in ``__range``; equal rows share a range."""
    from lakeweave.runtime import settle

    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return settle(df.repartitionByRange(n, *order).withColumn("__range", F.spark_partition_id()))


def running_sum(df: DataFrame, order: list[str], value: Column, name: str) -> DataFrame:
    """Adds the sum of ``value`` over all rows up to each row of the whole frame, equal rows counted in
    their order. Ranges are summed apart; only one sum per range is ordered in one place."""
    ranged = in_ranges(df.withColumn("__value", value), order)
    sums = ranged.groupBy("__range").agg(F.sum("__value").alias("__part"))
    before = Window.orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("__range", F.coalesce(F.sum("__part").over(before), F.lit(0)).alias("__before"))
    own = F.sum("__value").over(Window.partitionBy("__range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.withColumn("__own", own).join(F.broadcast(offsets), "__range").withColumn(name, F.col("__before") + F.col("__own")).drop("__value", "__range", "__before", "__own")


def following(df: DataFrame, key: str, name: str) -> DataFrame:
    """Distinct keys of the whole frame with the next key, the last with the first."""
    ranged = in_ranges(df.select(key).distinct(), [key])
    firsts = ranged.groupBy("__range").agg(F.min(key).alias("__first"))
    ends = firsts.withColumn("__after", F.lead("__first").over(Window.orderBy("__range"))).withColumn("__least", F.min("__first").over(Window.partitionBy()))
    inner = F.lead(key).over(Window.partitionBy("__range").orderBy(key))
    return ranged.withColumn("__next", inner).join(F.broadcast(ends), "__range").select(key, F.coalesce("__next", "__after", "__least").alias(name))

"""Waiting times: fixed bins, survival, restricted mean, remaining time."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BINS = 64


def fixed_bin(value: Column, horizon: float, bins: int = BINS) -> Column:
    """Equal-width bin from 0; negative values fall into the first, values beyond the horizon into the last."""
    return F.when(value >= horizon, bins - 1).otherwise(F.least(F.lit(bins - 1), F.floor(F.greatest(F.lit(0.0), value) * bins / horizon))).cast("int")


def histogram(df: DataFrame, value: str, horizon: float, event: Column, bins: int = BINS) -> DataFrame:
    """(bin, events, censored) of all bins, empty ones included. The result has ``bins`` rows."""
    spark = df.sparkSession
    counted = df.filter(F.col(value).isNotNull()).groupBy(fixed_bin(F.col(value), horizon, bins).alias("bin")).agg(F.count_if(event).alias("events"), F.count_if(~event).alias("censored"))
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counted, "bin", "left").select("bin", F.coalesce("events", F.lit(0)).alias("events"), F.coalesce("censored", F.lit(0)).alias("censored"))


def kaplan_meier(hist: DataFrame) -> DataFrame:
    """(bin, at_risk, survival at the begin of the bin); a bin without risk leaves it unchanged."""
    risk = F.sum(F.col("events") + F.col("censored")).over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    before = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)
    r = hist.withColumn("at_risk", risk).withColumn("f", F.when(F.col("at_risk") > 0, 1 - F.col("events") / F.col("at_risk")).otherwise(F.lit(1.0)))
    s = F.aggregate(F.coalesce(F.collect_list("f").over(before), F.array().cast("array<double>")), F.lit(1.0), lambda a, x: a * x)
    return r.withColumn("survival", s).select("bin", "events", "censored", "at_risk", "survival")


def remaining_mean(km: DataFrame, horizon: float, bins: int = BINS) -> DataFrame:
    """Restricted mean of the remaining time from each bin on."""
    width = horizon / bins
    tail = F.sum("survival").over(Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, 0))
    most = horizon - F.col("bin") * width
    return km.withColumn("tail", tail).select("bin", F.round(F.least(most, F.greatest(F.lit(0.0), width * F.col("tail") / F.greatest(F.col("survival"), F.lit(1e-12)))), 6).alias("remaining"))


def midpoint_mean(hist: DataFrame, horizon: float, bins: int = BINS) -> DataFrame:
    w = horizon / bins
    return hist.agg(F.when(F.sum("events") == 0, w).otherwise(F.round(F.sum(F.col("events") * (F.col("bin") + 0.5) * w) / F.sum("events"), 6)).alias("mean"))


def next_milestone(done: Column, interval: int) -> Column:
    return (F.floor(done / interval) + 1) * interval

"""List losses of training, as aggregates over scored lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _lse(value: Column, top: str) -> Column:
    """Log of the sum of exponentials of a group whose largest value stands in ``top`` of every row; null
    for no values."""
    return F.first(top) + F.log(F.sum(F.exp(value - F.col(top))))


def _softplus(x: Column) -> Column:
    return F.greatest(x, F.lit(0.0)) + F.log1p(F.exp(-F.abs(x)))


def _with_tops(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Adds the largest score of each group among all, its positives and its others."""
    w = Window.partitionBy(*by)
    own, rest = F.when(positive, F.col(score)), F.when(~positive, F.col(score))
    return df.withColumns({"__pos": own, "__neg": rest, "__top": F.max(score).over(w), "__ptop": F.max(own).over(w), "__ntop": F.max(rest).over(w)})


def rank_mass_loss(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Per list: log mass of all scores less that of the positives; null without a positive or a negative."""
    g = _with_tops(df, by, score, positive).groupBy(*by)
    whole, part = _lse(F.col(score), "__top"), _lse(F.col("__pos"), "__ptop")
    return g.agg(F.when((F.count("__pos") > 0) & (F.count("__neg") > 0), whole - part).alias("loss"))


def pair_loss(df: DataFrame, by: list[str], score: str, positive: Column) -> DataFrame:
    """Per list: mean over its positives p of log(1 + sum of exp(c - p) over its competitors c).

    The sum is the competitors' log mass less p, so no pair is built. Null without one of both."""
    marked = _with_tops(df, by, score, positive)
    mass = marked.groupBy(*by).agg(_lse(F.col("__neg"), "__ntop").alias("__mass"))
    joined = marked.join(mass, by)
    return joined.groupBy(*by).agg(F.avg(F.when(F.col("__pos").isNotNull(), _softplus(F.col("__mass") - F.col("__pos")))).alias("loss"))


def two_level_mean(df: DataFrame, by: list[str], inner: str, value: str) -> DataFrame:
    """Per list the mean of the means of ``inner``, so that a much supported target counts once."""
    return df.groupBy(*by, inner).agg(F.avg(value).alias("__m")).groupBy(*by).agg(F.avg("__m").alias("mean"))


def list_divergence(df: DataFrame, by: list[str], student: str, teacher: str) -> DataFrame:
    """Per list the divergence of the student's softmax from the teacher's."""
    w = Window.partitionBy(*by)
    top = df.withColumns({"__st": F.max(student).over(w), "__tt": F.max(teacher).over(w)})
    share = top.withColumns({"__s": F.col(student) - F.col("__st") - F.log(F.sum(F.exp(F.col(student) - F.col("__st"))).over(w)), "__t": F.col(teacher) - F.col("__tt") - F.log(F.sum(F.exp(F.col(teacher) - F.col("__tt"))).over(w))})
    return share.groupBy(*by).agg(F.sum(F.exp("__t") * (F.col("__t") - F.col("__s"))).alias("loss"))


def top_list_divergence(df: DataFrame, by: list[str], student: str, teacher: str, ties: list[Column], k: int) -> DataFrame:
    """Divergence over the teacher's first ``k`` alone, and the rank mass loss with these as positives;
    the plain divergence for lists of at most ``k``, or ``k`` 0."""
    w = Window.partitionBy(*by)
    ranked = df.withColumn("__n", F.count("*").over(w)).withColumn("__r", F.row_number().over(w.orderBy(F.desc(teacher), *ties)))
    inside = (F.lit(k) <= 0) | (F.col("__r") <= k)
    near = list_divergence(ranked.filter(inside), by, student, teacher)
    mass = rank_mass_loss(ranked, by, student, inside).withColumnRenamed("loss", "__mass")
    return near.join(mass, by).select(*by, (F.col("loss") + F.coalesce("__mass", F.lit(0.0))).alias("loss"))

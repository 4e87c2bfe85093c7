"""Principal components from block sums; the only thing that reaches the driver is dim x dim."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def fit_pca(vectors: DataFrame, column: str, dim: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(mean, components k x dim, variances): eigenvectors of the covariance in double precision, each
    with its component of largest magnitude positive."""

    def sums(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n, s, c = 0, np.zeros(dim), np.zeros((dim, dim))
        for pdf in batches:
            if len(pdf):
                x = np.array(pdf["x"].tolist(), dtype="f8")
                n, s, c = n + len(x), s + x.sum(axis=0), c + x.T @ x
        yield pd.DataFrame({"n": [n], "s": [s.tobytes()], "c": [c.tobytes()]})

    parts = vectors.select(F.col(column).cast("array<double>").alias("x")).filter((F.size("x") == dim)).mapInPandas(sums, "n long, s binary, c binary").toLocalIterator()
    n, s, c = 0, np.zeros(dim), np.zeros((dim, dim))
    for p in parts:
        n, s, c = n + p["n"], s + np.frombuffer(p["s"]), c + np.frombuffer(p["c"]).reshape(dim, dim)
    if not n:
        return np.zeros(dim), np.zeros((0, dim)), np.zeros(0)
    mean = s / n
    values, axes = np.linalg.eigh(c / n - np.outer(mean, mean))
    order = np.argsort(-values)[:k]
    axes = axes[:, order].T
    sign = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    return mean, axes * np.where(sign == 0, 1, sign)[:, None], values[order]


def project(vectors: DataFrame, key: str, column: str, mean: np.ndarray, axes: np.ndarray) -> DataFrame:
    """(key, projected array<double>)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = (np.array(pdf["x"].tolist(), dtype="f8") - mean) @ axes.T
                yield pd.DataFrame({key: pdf[key].to_numpy(), "projected": list(x)})

    slim = vectors.select(key, F.col(column).cast("array<double>").alias("x")).filter(F.size("x") == len(mean))
    return slim.mapInPandas(run, f"{key} {dict(slim.dtypes)[key]}, projected array<double>")


def balanced_clusters(x: np.ndarray, clusters: int, capacity: int, rounds: int = 5, seed: int = 0) -> np.ndarray:
    """Cluster of each row: seeded k-means++ by cosine distance, then greedy assignment under a capacity.

    The nearest (row, cluster) pairs are served first; a full cluster takes no more. For inputs that
    were aggregated to fit one process, such as one vector per group."""
    n = len(x)
    if clusters * capacity < n or clusters < 1:
        raise ValueError("the clusters cannot hold all rows")
    if not n:
        return np.zeros(0, dtype=int)
    rng = np.random.default_rng(seed)
    u = x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)
    centre = [u[rng.integers(n)]]
    while len(centre) < min(clusters, n):
        gap = np.maximum(0.0, 1 - (u @ np.array(centre).T).max(axis=1))
        centre.append(u[rng.choice(n, p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(n)])
    c, own = np.array(centre), np.full(n, -1)
    for _ in range(rounds):
        gap = 1 - u @ c.T
        left, new = np.full(len(c), capacity), np.full(n, -1)
        for flat in np.argsort(gap, axis=None, kind="stable"):
            r, k = divmod(int(flat), len(c))
            if new[r] < 0 and left[k]:
                new[r] = k
                left[k] -= 1
        if (new == own).all():
            break
        own = new
        for k in range(len(c)):
            if (own == k).any():
                m = u[own == k].mean(axis=0)
                c[k] = m / max(np.linalg.norm(m), 1e-12)
    return own


def bin_means(df: DataFrame, by: str, position: str, vector: str, limit: int) -> DataFrame:
    """(by, bin, mean): a sequence's vectors as at most ``limit`` means of consecutive ones; a sequence of
    up to ``limit`` vectors stays as it is. Positions count from 0 without gaps."""
    from pyspark.sql import Window

    n = F.count("*").over(Window.partitionBy(by))
    # Bin j holds the positions from floor(j n / limit) up to the next one.
    bin_of = F.when(F.col("__n") <= limit, F.col(position)).otherwise(F.floor(((F.col(position) + 1) * limit - 1) / F.col("__n")))
    placed = df.withColumn("__n", n).select(by, bin_of.cast("int").alias("bin"), F.posexplode(F.col(vector)).alias("__k", "__x"))
    mean = placed.groupBy(by, "bin", "__k").agg(F.avg(F.col("__x").cast("double")).alias("__m"))
    return mean.groupBy(by, "bin").agg(F.array_sort(F.collect_list(F.struct("__k", "__m"))).alias("__v")).select(by, "bin", F.transform("__v", lambda x: x["__m"]).alias("mean"))

"""Filling fixed-capacity containers by best-fit decreasing.

Sizes are whole numbers up to the capacity, so the open containers of one bin of work are kept in
stacks by remaining capacity under a segment tree over the capacities: the tightest open container
that still takes an item is found, and updated, in logarithmic time of the capacity.

The work is cut into parts by a hash of key and piece. The number of parts follows the total size and
the number of pieces, and a part that a repeated or null key still overfills is cut further by row, so
no part outgrows a task; what a part loses is at most its few last containers.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.runtime import settle, small

CAPACITY = 2048
#: Containers that one part of the work fills, about; at 2,048 tokens about 20 million tokens.
PART_CONTAINERS = 10_000
#: Pieces that one part of the work holds, about, however small they are.
PART_PIECES = 200_000


class OpenBins:
    """Segment tree over remaining capacities 0..capacity; a leaf is the stack of open containers."""

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.span = 1
        while self.span <= capacity:
            self.span *= 2
        self.some = bytearray(2 * self.span)
        self.stacks: list[list[int]] = [[] for _ in range(capacity + 1)]
        self.opened = 0

    def _mark(self, rest: int, on: int) -> None:
        node = self.span + rest
        self.some[node] = on
        node //= 2
        while node:
            now = self.some[2 * node] | self.some[2 * node + 1]
            if self.some[node] == now:
                return
            self.some[node] = now
            node //= 2

    def tightest(self, size: int) -> int:
        """Smallest remaining capacity of at least ``size`` with an open container, or -1."""
        node = self.span + size
        if self.some[node]:
            return size
        while node > 1:
            if node % 2 == 0 and self.some[node + 1]:
                node += 1
                while node < self.span:
                    node = 2 * node if self.some[2 * node] else 2 * node + 1
                return node - self.span
            node //= 2
        return -1

    def put(self, size: int) -> int:
        """The container the item goes into."""
        rest = self.tightest(size)
        if rest < 0:
            box, rest = self.opened, self.capacity
            self.opened += 1
        else:
            stack = self.stacks[rest]
            box = stack.pop()
            if not stack:
                self._mark(rest, 0)
        left = rest - size
        if not self.stacks[left]:
            self._mark(left, 1)
        self.stacks[left].append(box)
        return box


def pack(sizes: DataFrame, key: str = "doc_id", size: str = "n_tokens", capacity: int = CAPACITY, part_containers: int = PART_CONTAINERS, part_pieces: int = PART_PIECES) -> DataFrame:
    """One row per piece: ``key``, ``piece`` (from 0), ``size``, ``container`` (bigint).

    An item over the capacity is cut into full containers of its own and a rest; no other item is
    cut. Items of null or negative size count as 0; items of size 0 get a container too. Repeated
    keys are separate items. An empty input gives no rows. Ties in size are taken by key, so the
    result is the same on every run, unless one key fills more than a part. Rows with a null key
    form items as well.
    """
    whole = F.greatest(F.coalesce(F.col(size), F.lit(0)), F.lit(0)).cast("long")
    slim = settle(sizes.select(F.col(key).alias("__key"), whole.alias("__size"), F.monotonically_increasing_id().alias("__row")))
    pieces = F.greatest(F.lit(1), F.ceil(F.col("__size") / capacity))
    load = slim.agg(F.sum("__size").alias("size"), F.sum(pieces).alias("pieces")).first()
    parts = max(1, -(-int(load["size"] or 0) // (capacity * part_containers)), -(-int(load["pieces"] or 0) // part_pieces))
    cut = slim.select("__key", "__size", "__row", F.explode(F.sequence(F.lit(0).cast("long"), (pieces - 1).cast("long"))).alias("__piece"))
    cut = cut.select(
        "__key",
        "__row",
        F.col("__piece").cast("int").alias("__piece"),
        F.least(F.lit(capacity), F.col("__size") - F.col("__piece") * capacity).cast("long").alias("__take"),
        F.pmod(F.xxhash64("__key", "__piece"), F.lit(parts)).alias("__part"),
    )
    if parts > 1:
        over = F.greatest(F.ceil(F.sum("__take") / (2 * capacity * part_containers)), F.ceil(F.count("*") / (2 * part_pieces)))
        split = settle(cut.groupBy("__part").agg(over.cast("int").alias("__ways")).filter("__ways > 1"))
        cut = cut.join(small(split), "__part", "left").withColumn("__part", F.col("__part") * (1 << 16) + F.coalesce(F.pmod(F.xxhash64("__row", "__piece"), F.col("__ways")), F.lit(0)))
    else:
        cut = cut.withColumn("__part", F.col("__part") * (1 << 16))
    schema = T.StructType(
        [T.StructField("__key", slim.schema["__key"].dataType), T.StructField("__piece", T.IntegerType()), T.StructField("__take", T.LongType()), T.StructField("container", T.LongType())]
    )

    def fill(key_of_part: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["__take", "__key", "__piece"], ascending=[False, True, True], kind="stable")
        bins = OpenBins(capacity)
        base = int(key_of_part[0]) << 24
        return pdf.assign(container=[base + bins.put(s) for s in pdf["__take"].tolist()])[["__key", "__piece", "__take", "container"]]

    done = cut.select("__key", "__piece", "__take", "__part").groupBy("__part").applyInPandas(fill, schema)
    return done.select(F.col("__key").alias(key), F.col("__piece").alias("piece"), F.col("__take").alias(size), "container")


def fill_report(packed: DataFrame, size: str = "n_tokens", capacity: int = CAPACITY) -> DataFrame:
    """One row: containers, tokens, and the share of the capacity that is used."""
    per = packed.groupBy("container").agg(F.sum(size).alias("used"))
    return per.agg(F.count("*").alias("containers"), F.coalesce(F.sum("used"), F.lit(0)).alias("tokens"), F.max("used").alias("fullest")).withColumn("fill", F.col("tokens") / (F.col("containers") * capacity))


__all__ = ["CAPACITY", "OpenBins", "fill_report", "pack"]

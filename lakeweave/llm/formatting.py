"""Collapsing records that differ in formatting only, by radix partitioning and tries.

Every record is turned into canonical bytes. Records are spread over buckets by the first bytes; a
bucket over ``bucket_rows`` is split by the first byte behind the longest prefix its records share,
again and again until it fits. A bucket whose records are all the same cannot be split by its
bytes: it is salted by a hash of the record key instead, and the salts' results are merged. Within a
bucket a trie counts: each terminal holds the number of records and their smallest key.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.runtime import settle, small

BUCKET_ROWS = 200_000
#: Canonical bytes kept as they are; what lies behind them enters as its SHA-256.
PLAIN_BYTES = 48

UNSEEN = regex.compile(r"[\p{Default_Ignorable_Code_Point}\p{Cf}[\p{Cc}--\s]]", regex.V1)
WORDS = regex.compile(r"\p{N}+(?:[.,]\p{N}+)*|[\p{L}\p{M}]+")


def words_of(text: str) -> list[str]:
    """Words and numbers of a text after NFKC, without case, invisible characters, punctuation."""
    if text.isascii() and text.isprintable():
        return WORDS.findall(text.lower())
    seen = unicodedata.normalize("NFKC", UNSEEN.sub("", text))
    return WORDS.findall(unicodedata.normalize("NFKC", seen.casefold()))


def canonical_value(text: str | None) -> str | None:
    """Sorted words and numbers; None if there is none."""
    found = sorted(words_of(text)) if text else []
    return " ".join(found) if found else None


def canonical_table(data) -> str | None:
    """Rows in their order, each with its cells sorted, empty cells left out; None if wordless."""
    if data is None:
        return None
    rows = []
    for row in data:
        cells = [] if row is None else [c for c in (canonical_value(x) for x in row) if c]
        rows.append("\x1f".join(sorted(cells)))
    return "\x1e".join(rows) if any(rows) else None


def key_bytes(scope: bytes, canonical: str) -> bytes:
    """Eight spread bytes of the scope, then the canonical bytes; a long rest enters as its digest."""
    own = canonical.encode()
    if len(own) > PLAIN_BYTES + 32:
        own = own[:PLAIN_BYTES] + hashlib.sha256(own[PLAIN_BYTES:]).digest()
    return hashlib.blake2b(scope, digest_size=8).digest() + own


class Trie:
    """A trie whose edges are ``step`` bytes; a branch with one record stays a single lazy leaf."""

    def __init__(self, step: int = 8):
        self.step, self.root = step, {}

    def add(self, path: bytes, owner) -> list:
        """Count one record. Returns its terminal: [path, count, smallest owner]."""
        node, at, step = self.root, 0, self.step
        while True:
            edge = path[at : at + step]
            kid = node.get(edge)
            if kid is None:
                node[edge] = leaf = [path, 1, owner]
                return leaf
            at += step
            if type(kid) is dict:
                node = kid
                continue
            if kid[0] == path:
                kid[1] += 1
                if owner < kid[2]:
                    kid[2] = owner
                return kid
            node[edge] = deeper = {}
            deeper[kid[0][at : at + step]] = kid
            node = deeper


def _shared(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def radix_buckets(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds ``bucket`` (binary) and ``salted`` to rows of (path, key, ...).

    Each round counts the rows of every prefix with a map-side combine and keeps the oversized
    ones, at most rows / bucket_rows of them; only their rows are written and go to the next round.
    """
    key = [c for c in rows.columns]
    todo = rows.withColumn("bucket", F.expr("substring(path, 1, 1)"))
    out = None

    def give(part: DataFrame, salted: bool) -> None:
        nonlocal out
        part = part.select(*key, "bucket").withColumn("salted", F.lit(salted))
        out = part if out is None else out.unionByName(part)

    def shared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            ends = [(bytes(a), bytes(z)) for a, z in zip(pdf["a"].tolist(), pdf["z"].tolist(), strict=True)]
            yield pdf.assign(depth=[_shared(a, z) + 1 for a, z in ends], stuck=[a == z for a, z in ends])[["bucket", "n", "depth", "stuck"]]

    while True:
        sizes = todo.groupBy("bucket").agg(F.count("*").alias("n"), F.min("path").alias("a"), F.max("path").alias("z")).filter(F.col("n") > bucket_rows)
        over = settle(sizes.mapInPandas(shared, "bucket binary, n long, depth int, stuck boolean"))
        if over.isEmpty():
            give(todo, False)
            return out
        give(todo.join(small(over.select("bucket")), "bucket", "left_anti"), False)
        split = settle(todo.join(small(over), "bucket"))
        salt = F.expr("unhex(lpad(hex(pmod(xxhash64(key), greatest(2, 2 * ceil(n / %d)))), 8, '0'))" % bucket_rows)
        give(split.filter("stuck").withColumn("bucket", F.concat("path", F.lit("|").cast("binary"), salt)), True)
        todo = split.filter("not stuck").select(*key, F.expr("substring(path, 1, depth)").alias("bucket"))


def copies_of(rows: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Of rows (tab, key, path): one row per copy with ``tab``, ``kept_key`` and ``copy_key``.

    Rows are distinct. A key that was delivered with several contents stands in each group once.
    """
    bucketed = radix_buckets(rows.select("tab", "key", "path"), bucket_rows)
    schema = "tab string, key string, kept string, path binary"

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        trie = Trie()
        salted = bool(pdf["salted"].iloc[0])
        keys, paths = pdf["key"].tolist(), pdf["path"].tolist()
        ends = [trie.add(bytes(p), k) for p, k in zip(paths, keys, strict=True)]
        rows = [(t, k, e[2], e[0] if salted else None) for t, k, e in zip(pdf["tab"].tolist(), keys, ends, strict=True) if salted or e[1] > 1]
        return pd.DataFrame(rows, columns=["tab", "key", "kept", "path"], dtype=object)

    found = settle(bucketed.groupBy("bucket").applyInPandas(count, schema))
    whole = found.filter("path is null").select("tab", F.col("kept").alias("kept_key"), F.col("key").alias("copy_key"))
    parts = found.filter("path is not null")
    least = parts.groupBy("path").agg(F.min("kept").alias("kept_key"))
    merged = parts.join(least, "path").select("tab", "kept_key", F.col("key").alias("copy_key"))
    return whole.unionByName(merged).filter("copy_key <> kept_key")


def _paths(df: DataFrame, tab: str, key: str, scope: list[str], content: str, canonical) -> DataFrame:
    slim = df.select(F.col(key).cast("string").alias("key"), *[F.col(s).cast("string").alias(f"s{k}") for k, s in enumerate(scope)], F.col(content).alias("content")).filter("key is not null and content is not null")
    schema = T.StructType([T.StructField("tab", T.StringType()), T.StructField("key", T.StringType()), T.StructField("path", T.BinaryType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            canon = [canonical(c) for c in pdf["content"]]
            scopes = list(zip(*[pdf[f"s{k}"] for k in range(len(scope))], strict=True)) if scope else [()] * len(pdf)
            path = [None if c is None else key_bytes("\x1f".join([tab, *["\x00" if s is None else s for s in own]]).encode(), c) for c, own in zip(canon, scopes, strict=True)]
            yield pd.DataFrame([(tab, k, p) for k, p in zip(pdf["key"].tolist(), path, strict=True) if p is not None], columns=["tab", "key", "path"], dtype=object)

    return slim.mapInPandas(run, schema)


def formatting_copies(values: DataFrame, tables: DataFrame, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Copies among distinct values (within one table_id and column_index) and among whole tables.

    Values are copies if they have the same words and numbers, equally often, in any order; tables
    if their rows, in the same order, have the same such cells in any order. Null and wordless
    contents and null keys take no part. A null table_id or column_index is a scope of its own.
    Redelivered rows count once. Empty inputs give no rows. Extra columns are not read.
    """
    rows = _paths(values, "distinct_values", "value_id", ["table_id", "column_index"], "value", canonical_value).unionByName(_paths(tables, "source_tables", "source_table_id", [], "data", canonical_table))
    return copies_of(settle(rows.distinct()), bucket_rows)


def copy_counts(copies: DataFrame) -> DataFrame:
    """The kept record of each group with its number of records."""
    return copies.groupBy("tab", "kept_key").agg((F.count("*") + 1).alias("n_copies"))

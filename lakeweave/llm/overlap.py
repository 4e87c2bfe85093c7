"""Records of evaluation splits that also occur, exactly or almost, in the training split.

Records are canonicalised (case, blanks, punctuation, order of rows and columns) and hashed; equal
records become one class, so copies meet once. Every row of a class is hashed several times: with
one half of one cell left out, so that a slip of typing in a cell leaves at least one hash alone.
Evaluation hashes are joined with training hashes. A hash that would meet too often is not dropped:
it is joined together with each hash of another row, and of a further one while that meets too often
still, which records that share enough rows share too. Met classes are compared row by row; the
classes' members are put out as pairs of records, or only counted.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Iterator

import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.llm.splits import split_label
from lakeweave.runtime import settle

COMMON_ROWS = 4
#: A hash that joins more class pairs than this is refined by a second row's hash.
HOT_PAIRS = 2_000
#: A cell shorter than this has no slips: another character makes another value.
SLIP_CHARS = 4

DROP = regex.compile(r"[^\p{L}\p{N}\p{M}]|[\p{Default_Ignorable_Code_Point}]")


def canonical_cell(text: str | None) -> str:
    if not text:
        return ""
    if text.isascii():
        return DROP.sub("", text.lower())
    return DROP.sub("", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold()))


def canonical_rows(rows) -> list[list[str]]:
    """Rows of sorted canonical cells, sorted; rows without any visible cell are left out."""
    out = []
    for row in rows if rows is not None else ():
        cells = sorted(canonical_cell(c) for c in (row if row is not None else ()))
        if any(cells):
            out.append(cells)
    return sorted(out)


def _digest(*parts: str) -> int:
    return xxhash.xxh3_64_intdigest("\x1f".join(parts)) - (1 << 63)


def row_hashes(cells: list[str]) -> set[int]:
    """Hashes of a row with a half of one cell left out; a slip leaves one of them alone.

    The halves are cut for the cell's own length and for one character less or more.
    """
    out = set()
    for k, cell in enumerate(cells):
        rest = "\x1e".join(cells[:k] + cells[k + 1 :])
        n = len(cell)
        if n < SLIP_CHARS:
            continue
        for h in {(n - 1) // 2, n // 2, (n + 1) // 2}:
            out.add(_digest("<", rest, cell[:h]))
            out.add(_digest(">", rest, cell[n - h :]))
    return out or {_digest("=", "\x1e".join(cells))}


def slip(a: str, b: str) -> bool:
    """Whether two cells are equal up to one insertion, deletion, replacement or swap."""
    if a == b:
        return True
    if min(len(a), len(b)) < SLIP_CHARS or abs(len(a) - len(b)) > 1:
        return False
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    return x[1:] == y[1:] or x[1:] == y or x == y[1:] or (len(x) > 1 and len(y) > 1 and x[0] == y[1] and x[1] == y[0] and x[2:] == y[2:])


def same_row(a: list[str], b: list[str]) -> bool:
    """Equal cells in any order, but for a slip in one cell."""
    if a == b:
        return True
    if len(a) != len(b):
        return False
    rest, left = list(b), []
    for c in a:
        if c in rest:
            rest.remove(c)
        else:
            left.append(c)
    return len(left) == 1 and len(rest) == 1 and slip(left[0], rest[0])


def rows_in_common(x: list[list[str]], y: list[list[str]]) -> int:
    """Largest number of rows that can be matched one to one, by augmenting paths."""
    at: dict[int, list[int]] = {}
    for j, b in enumerate(y):
        for h in row_hashes(b):
            at.setdefault(h, []).append(j)
    fits = [[j for j in sorted({j for h in row_hashes(a) for j in at.get(h, ())}) if same_row(a, y[j])] for a in x]
    owner: dict[int, int] = {}
    matched = 0
    for start in range(len(x)):
        came: dict[int, int] = {}
        todo, end = [start], -1
        while todo and end < 0:
            i = todo.pop()
            for j in fits[i]:
                if j not in came:
                    came[j] = i
                    if j not in owner:
                        end = j
                        break
                    todo.append(owner[j])
        if end >= 0:
            matched += 1
            mine = {i: j for j, i in owner.items()} if came[end] != start else {}
            while end is not None:
                i = came[end]
                before = mine.get(i)
                owner[end] = i
                end = before
    return matched


def canonical_views(views: DataFrame, common: int = COMMON_ROWS) -> DataFrame:
    """Distinct (table_id, source_table_id, label, side, cls, rows) of views with a known split.

    ``rows`` are JSON-free nested arrays; views with fewer than ``common`` visible rows are left out
    as they cannot share that many.
    """
    texts = F.transform("rows", lambda r: F.transform(r["cells"], lambda c: c["text"]))
    slim = views.select("table_id", "source_table_id", split_label(F.col("split")).alias("label"), texts.alias("rows")).filter("table_id is not null and label in ('train', 'dev', 'test') and rows is not null")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for t, s, label, rows in zip(pdf["table_id"].tolist(), pdf["source_table_id"].tolist(), pdf["label"].tolist(), pdf["rows"].tolist(), strict=True):
                c = canonical_rows(rows)
                if len(c) >= common:
                    cls = hashlib.sha256("\x1d".join("\x1e".join(r) for r in c).encode()).hexdigest()[:32]
                    out.append((t, s if isinstance(s, str) else None, label, "train" if label == "train" else "eval", cls, c))
            yield pd.DataFrame(out, columns=["table_id", "source_table_id", "label", "side", "cls", "rows"], dtype=object)

    return slim.mapInPandas(run, "table_id string, source_table_id string, label string, side string, cls string, rows array<array<string>>")


def _keys(classes: DataFrame) -> DataFrame:
    """(cls, row, key) of every class."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(c, k, h) for c, rows in zip(pdf["cls"].tolist(), pdf["rows"].tolist(), strict=True) for k, r in enumerate(rows) for h in row_hashes(list(r))]
            yield pd.DataFrame(out, columns=["cls", "row", "key"])

    return classes.select("cls", "rows").mapInPandas(run, "cls string, row int, key long")


def class_pairs(classes: DataFrame, common: int = COMMON_ROWS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(cls_train, cls_eval) of classes (cls, rows, in_train, in_eval) with ``common`` rows in common.

    A hash that would join more than ``hot_pairs`` class pairs is replaced by the hashes of it and one
    more row of its class, again up to ``common`` rows; so many equal rows make a pair anyway.
    """
    side = ["in_train", "in_eval"]

    def shared(keys: DataFrame) -> DataFrame:
        # A class that holds a hash twice counts twice: the load is never underrated.
        load = keys.groupBy("key").agg(F.sum(F.col("in_train").cast("long")).alias("nt"), F.sum(F.col("in_eval").cast("long")).alias("ne"))
        load = load.filter("nt > 0 and ne > 0").select("key", (F.col("nt") * F.col("ne") > hot_pairs).alias("hot"))
        return settle(keys.join(load, "key"))

    live = shared(_keys(classes).join(classes.select("cls", *side), "cls"))
    others = live.select("cls", F.col("row").alias("row2"), F.col("key").alias("key2")).distinct()
    ready = []
    for depth in range(1, common + 1):
        if depth == common or live.filter("hot").isEmpty():
            ready.append(live.select("cls", "key", *side))
            break
        ready.append(live.filter("not hot").select("cls", "key", *side))
        hot = live.filter("hot")
        if depth == 1:
            hot = hot.select("cls", *side, F.array("row").alias("taken"), F.array("key").alias("used"))
        wider = hot.join(others, "cls").filter(~F.array_contains("taken", F.col("row2")))
        wider = wider.select("cls", *side, F.array_sort(F.array_append("taken", F.col("row2"))).alias("taken"), F.array_sort(F.array_append("used", F.col("key2"))).alias("used")).distinct()
        live = shared(wider.withColumn("key", F.xxhash64("used")))
    met = None
    for part in ready:
        keys = part.distinct()
        pairs = keys.filter("in_train").select("key", F.col("cls").alias("cls_train")).join(keys.filter("in_eval").select("key", F.col("cls").alias("cls_eval")), "key").select("cls_train", "cls_eval")
        met = pairs if met is None else met.unionByName(pairs)
    met = met.distinct()
    full = met.join(classes.select(F.col("cls").alias("cls_train"), F.col("rows").alias("x")), "cls_train").join(classes.select(F.col("cls").alias("cls_eval"), F.col("rows").alias("y")), "cls_eval")

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for a, b, x, y in zip(pdf["cls_train"].tolist(), pdf["cls_eval"].tolist(), pdf["x"].tolist(), pdf["y"].tolist(), strict=True):
                n = len(x) if a == b else rows_in_common([list(r) for r in x], [list(r) for r in y])
                if n >= common:
                    out.append((a, b, n))
            yield pd.DataFrame(out, columns=["cls_train", "cls_eval", "n_rows"])

    return full.select("cls_train", "cls_eval", "x", "y").mapInPandas(verify, "cls_train string, cls_eval string, n_rows int")


def _classed(views: DataFrame, common: int, hot_pairs: int) -> tuple[DataFrame, DataFrame]:
    """The canonical views and the class pairs that overlap."""
    known = settle(canonical_views(views, common))
    classes = settle(known.groupBy("cls").agg(F.first("rows").alias("rows"), F.max(F.col("side") == "train").alias("in_train"), F.max(F.col("side") == "eval").alias("in_eval")))
    return known, settle(class_pairs(classes, common, hot_pairs))


def _sides(known: DataFrame) -> tuple[DataFrame, DataFrame]:
    train = known.filter("side = 'train'").select(F.col("cls").alias("cls_train"), F.col("table_id").alias("train_id")).distinct()
    evals = known.filter("side = 'eval'").select(F.col("cls").alias("cls_eval"), F.col("table_id").alias("eval_id"), F.col("label").alias("split"), "source_table_id").distinct()
    return train, evals


def cross_split_overlaps(views: DataFrame, common: int = COMMON_ROWS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """Distinct (train_id, eval_id, split, source_table_id, n_rows): a training and an evaluation
    view with at least ``common`` rows in common; ``split`` and source are the evaluation view's.

    Null and empty cells are alike; a null split, null rows or a null table_id take no part; a view
    delivered again counts once; empty inputs give no rows; extra columns are not read.
    """
    known, met = _classed(views, common, hot_pairs)
    train, evals = _sides(known)
    return met.join(train, "cls_train").join(evals, "cls_eval").filter("train_id <> eval_id").select("train_id", "eval_id", "split", "source_table_id", "n_rows")


def overlap_pairs(overlaps: DataFrame) -> DataFrame:
    return overlaps.select(F.least("train_id", "eval_id").alias("table_a"), F.greatest("train_id", "eval_id").alias("table_b")).distinct()


def overlap_counts(views: DataFrame, common: int = COMMON_ROWS, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(split, source_table_id, n_pairs, n_views): overlapping pairs, and evaluation views in them, per
    split and source of the evaluation view.

    Members of a class are counted, not paired. Only table ids that stand in several classes or on
    both sides, whose pairs could be counted twice, are written out as pairs.
    """
    known, met = _classed(views, common, hot_pairs)
    train, evals = _sides(known)
    ids = known.select("table_id", "cls", "side").distinct().groupBy("table_id").agg((F.count("*") > 1).alias("many")).filter("many")
    many = settle(ids.select("table_id"))
    flag_train = train.join(many.select(F.col("table_id").alias("train_id"), F.lit(True).alias("many_train")), "train_id", "left")
    flag_eval = evals.join(many.select(F.col("table_id").alias("eval_id"), F.lit(True).alias("many_eval")), "eval_id", "left")
    group = ["split", "source_table_id"]
    nt = flag_train.filter("many_train is null").groupBy("cls_train").agg(F.count("*").alias("nt"))
    ne = flag_eval.filter("many_eval is null").groupBy("cls_eval", *group).agg(F.count("*").alias("ne"))
    counted = met.join(nt, "cls_train").join(ne, "cls_eval").select(*group, (F.col("nt") * F.col("ne")).alias("n_pairs"))
    first = met.join(flag_train.filter("many_train"), "cls_train").join(evals, "cls_eval")
    second = met.join(flag_train.filter("many_train is null"), "cls_train").join(flag_eval.filter("many_eval"), "cls_eval")
    columns = [*group, "train_id", "eval_id"]
    single = first.select(*columns).unionByName(second.select(*columns)).filter("train_id <> eval_id").distinct().select(*group, F.lit(1).cast("long").alias("n_pairs"))
    pairs = counted.unionByName(single).groupBy(*group).agg(F.sum("n_pairs").alias("n_pairs"))
    # A view that meets only itself on the other side is in no pair.
    partners = met.join(train.groupBy("cls_train").agg(F.min("train_id").alias("lo"), F.max("train_id").alias("hi")), "cls_train").groupBy("cls_eval").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    seen = evals.join(partners, "cls_eval").filter((F.col("lo") != F.col("eval_id")) | (F.col("hi") != F.col("eval_id"))).select(*group, "eval_id").distinct()
    n_views = seen.groupBy(*group).agg(F.count("*").alias("n_views"))
    same = [pairs[c].eqNullSafe(n_views[c]) for c in group]
    return pairs.join(n_views, same[0] & same[1]).select(*[pairs[c] for c in group], "n_pairs", "n_views")

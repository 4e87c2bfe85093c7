"""Statistics of columns: dependencies, modes, distributions, redundancy, overlap."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.text import is_number, normalize
from lakeweave.operators.ranking import running_sum


def column_pairs(cell: DataFrame) -> DataFrame:
    """(source_table_id, row_id, x_col, y_col, x, y): the filled cells of two columns, row by row.

    A row's cells are gathered once, as many as the table has columns, and paired in place: one scan
    and one shuffle instead of a self join."""
    side = cell.filter("text <> ''").select("source_table_id", "row_id", "column_index", normalize("text").alias("k")).filter("k <> ''")
    rows = side.groupBy("source_table_id", "row_id").agg(F.collect_list(F.struct(F.col("column_index").alias("c"), "k")).alias("r"))
    left = rows.select("source_table_id", "row_id", "r", F.explode("r").alias("a"))
    both = left.select("source_table_id", "row_id", F.col("a.c").alias("x_col"), F.col("a.k").alias("x"), F.explode("r").alias("b"))
    return both.select("source_table_id", "row_id", "x_col", F.col("b.c").alias("y_col"), "x", F.col("b.k").alias("y")).filter("x_col <> y_col")


def fd_purity(cell: DataFrame) -> DataFrame:
    """Approximate dependency x -> y: the share of rows that carry the most frequent y of their x."""
    counts = column_pairs(cell).groupBy("source_table_id", "x_col", "y_col", "x", "y").agg(F.count("*").alias("n"))
    best = counts.groupBy("source_table_id", "x_col", "y_col", "x").agg(F.max("n").alias("top"), F.sum("n").alias("n"))
    return best.groupBy("source_table_id", "x_col", "y_col").agg(F.bround(F.sum("top") / F.sum("n"), 6).alias("purity"), F.sum("n").alias("support"))


def dominant_by_key(cell: DataFrame, key: int = 0, value: int = 1) -> DataFrame:
    """Per key the most frequent value; ties go to the value that stands first."""
    part = cell.filter(F.col("column_index").isin(key, value))
    pick = lambda c: F.max(F.when(F.col("column_index") == c, F.col("text")))
    wide = part.groupBy("source_table_id", "row_id").agg(pick(key).alias("key"), pick(value).alias("value")).filter("key <> '' and value <> ''")
    n = wide.groupBy("source_table_id", "key", "value").agg(F.count("*").alias("n"), F.min("row_id").alias("first"))
    order = Window.partitionBy("source_table_id", "key").orderBy(F.desc("n"), "first")
    return n.withColumn("r", F.row_number().over(order)).filter("r = 1").select("source_table_id", "key", "value", "n")


def target_rows(cell: DataFrame, bridge: int, dependent: list[int]) -> DataFrame:
    """(source_table_id, row_id, bridge, c<i>...): one row per bridge value, in order, with the dominant
    value of each dependent column. Bridge values without one complete row are left out."""
    part = cell.filter(F.col("column_index").isin(bridge, *dependent))
    pick = lambda c: F.max(F.when(F.col("column_index") == c, F.col("text")))
    wide = part.groupBy("source_table_id", "row_id").agg(pick(bridge).alias("bridge"), *[pick(c).alias(f"c{c}") for c in dependent])
    for c in ("bridge", *[f"c{c}" for c in dependent]):
        wide = wide.filter(F.col(c) != "")
    out = wide.select("source_table_id", "bridge").distinct()
    for c in dependent:
        best = dominant_by_key(cell, bridge, c).select("source_table_id", F.col("key").alias("bridge"), F.col("value").alias(f"c{c}"))
        out = out.join(best, ["source_table_id", "bridge"])
    place = F.row_number().over(Window.partitionBy("source_table_id").orderBy("bridge")) - 1
    return out.select("source_table_id", place.alias("row_id"), "bridge", *[f"c{c}" for c in dependent])


def redundant_columns(cell: DataFrame) -> DataFrame:
    """Columns of a table with the same values row by row, in groups of two or more."""
    one, two = (F.xxhash64(F.lit(salt), "row_id", "text").cast("decimal(38,0)") for salt in ("a", "b"))
    # Sums of hashes do not depend on the rows' order, so a column is never gathered.
    own = F.concat_ws(":", F.count("*").cast("string"), F.sum(one).cast("string"), F.sum(two).cast("string"))
    digest = cell.groupBy("source_table_id", "column_index").agg(own.alias("digest"))
    return digest.groupBy("source_table_id", "digest").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list("column_index")), ",").alias("members")).filter("n >= 2").select("source_table_id", "members", "n")


def modal_share(cell: DataFrame) -> DataFrame:
    """Share of the most frequent normalised value per column; 1 for a column without values."""
    k = normalize("text")
    n = cell.select("source_table_id", "column_index", k.alias("k")).groupBy("source_table_id", "column_index", "k").agg(F.count("*").alias("n"))
    some = F.col("k") != ""
    return n.groupBy("source_table_id", "column_index").agg(F.coalesce(F.bround(F.max(F.when(some, F.col("n"))) / F.sum(F.when(some, F.col("n"))), 6), F.lit(1.0)).alias("modal_share"))


def distribution(df: DataFrame, by: str, value: str) -> DataFrame:
    """Missing share, distinct values, collision probability, entropy and effective number of values.

    Values are counted first, map side combined; a hot value is one row from then on."""
    n = df.groupBy(by, value).agg(F.count("*").alias("n"))
    some = F.coalesce(F.col(value), F.lit("")) != ""
    total = n.groupBy(by).agg(F.sum(F.when(some, F.col("n"))).alias("filled"), F.sum("n").alias("total"))
    p = F.col("n") / F.col("filled")
    e = n.filter(some).join(total, by).groupBy(by).agg(F.count("*").alias("distinct_values"), F.sum(p * p).alias("c"), (-F.sum(p * F.log2(p))).alias("h"))
    return total.join(e, by, "left").select(
        by,
        F.bround(1 - F.coalesce("filled", F.lit(0)) / F.col("total"), 6).alias("missing_rate"),
        F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"),
        F.bround("c", 6).alias("collision"),
        F.bround("h", 6).alias("entropy_bits"),
        F.bround(F.pow(F.lit(2.0), "h"), 4).alias("effective_values"),
    )


# What in a header hints at measures and dates, and how years, ordinals and scores look.
MEASURE_HINTS = ("year", "date", "rank", "no.", "number", "score", "rating", "time", "age", "price", "population", "height", "weight", "length")
YEAR = r"^(?:1[5-9]\d{2}|20\d{2}|21\d{2})(?:[-/]\d{1,2}(?:[-/]\d{1,2})?)?$"
ORDINAL = r"(?i)^\d+(?:st|nd|rd|th)?$"
SCORE = r"^\(?\s*\d+(?:\.\d+)?\s*/\s*\d+(?:\.\d+)?\s*\)?$"


def looks_like_no_entity(cell: DataFrame) -> DataFrame:
    """Columns whose values are mostly years, ordinals, scores or numbers, and columns without values.

    Under a header that hints at measures 0.65 of the values of any kind suffice, else 0.8 of one."""
    some = F.col("text") != ""
    name = F.lower("column_name")
    hint = F.lit(False)
    for word in MEASURE_HINTS:
        hint = hint | name.contains(word)
    year, ordinal, score = (F.col("text").rlike(p) for p in (YEAR, ORDINAL, SCORE))
    share = lambda hit: F.coalesce(F.avg(F.when(some, hit.cast("double"))), F.lit(0.0))
    a = cell.groupBy("source_table_id", "column_index").agg(
        F.max(hint).alias("hint"),
        F.count_if(some).alias("k"),
        share(year | ordinal | score | is_number("text")).alias("any_share"),
        F.greatest(share(year), share(ordinal), share(score)).alias("one_share"),
    )
    veto = (F.col("k") == 0) | (F.col("hint") & (F.col("any_share") >= 0.65)) | (F.col("one_share") >= 0.8)
    return a.select("source_table_id", "column_index", F.bround("any_share", 6).alias("any_share"), veto.alias("veto"))


def overlap_share(cell: DataFrame) -> DataFrame:
    """Per pair of columns the share of rows whose texts are equal or contain one another (4 characters on)."""
    pairs = column_pairs(cell).filter("x_col < y_col")
    hit = (F.col("x") == F.col("y")) | ((F.least(F.length("x"), F.length("y")) >= 4) & (F.col("x").contains(F.col("y")) | F.col("y").contains(F.col("x"))))
    return pairs.groupBy("source_table_id", "x_col", "y_col").agg(F.bround(F.avg(hit.cast("double")), 6).alias("share"), F.count("*").alias("n"))


def gini(df: DataFrame, count: str, by: list[str] | None = None) -> DataFrame:
    """Gini coefficient of counts. Equal counts are one row; a frame without keys is ranked by ranges."""
    keys = by or []
    level = df.groupBy(*keys, count).agg(F.count("*").alias("m"))
    if keys:
        level = level.withColumn("upto", F.sum("m").over(Window.partitionBy(*keys).orderBy(count).rowsBetween(Window.unboundedPreceding, 0)))
    else:
        level = running_sum(level, [count], F.col("m"), "upto")
    # The places of m equal counts sum to m x (last place) - m (m - 1) / 2.
    places = F.col("m") * F.col("upto") - F.col("m") * (F.col("m") - 1) / 2
    n, s = F.sum("m"), F.sum(F.col("m") * F.col(count))
    value = F.when(s > 0, (2 * F.sum(places * F.col(count)) / (n * s)) - (n + 1) / n).otherwise(0.0)
    return level.groupBy(*keys).agg(F.bround(value, 6).alias("gini"), n.alias("n"))


def tally(df: DataFrame, column: str) -> DataFrame:
    return df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit("null")).alias("value")).agg(F.count("*").alias("n"))


def coverage(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of non-null rows per column, in long form."""
    one = df.agg(*[F.bround(F.avg(F.col(c).isNotNull().cast("double")), 4).alias(c) for c in columns])
    return one.select(F.explode(F.array(*[F.struct(F.lit(c).alias("field"), F.col(c).alias("share")) for c in columns])).alias("x")).select("x.field", "x.share")


def number_summary(c: Column) -> list[Column]:
    return [F.count(c).alias("n"), F.coalesce(F.min(c), F.lit(0.0)).alias("least"), F.coalesce(F.max(c), F.lit(0.0)).alias("most"), F.coalesce(F.bround(F.avg(c), 6), F.lit(0.0)).alias("mean")]

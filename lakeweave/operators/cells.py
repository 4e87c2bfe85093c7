"""From nested lake tables to the long cell model, and back to views.

Everything downstream works on ``cells(source_table_id, row_id, column_index, column_name, raw,
text, wiki_title, has_wiki_link)``: pruning and filters reach the scan, and no operator ever holds
a table in one value again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.text import EMPTY_HEADERS, cell_text, clean_each, clean_text, is_number, normalize, one_line, percent_encode

# Namespaces whose pages are not entities.
NO_ENTITY_SPACES = ("category", "file", "help", "image", "portal", "special", "talk", "template", "user", "wikipedia")
WIKI_CELL = r"^\[([^\]|]+)(?:\|([^\]]+))?\]$"


def latest(df: DataFrame, key: str, at: str = "loaded_at", *ties: str) -> DataFrame:
    """One row per key, the one delivered last; ties by the given columns, larger first."""
    order = [F.col(c).desc_nulls_last() for c in (at, *ties)]
    return df.withColumn("__rn", F.row_number().over(Window.partitionBy(key).orderBy(*order))).filter("__rn = 1").drop("__rn")


def lake(tables: DataFrame) -> DataFrame:
    return latest(tables, "source_table_id", "loaded_at", "pgtitle", "source_file")


def width() -> Column:
    """The largest of the declared, the observed and the header's number of columns."""
    seen = F.coalesce(F.array_max(F.transform("data", lambda r: F.coalesce(F.size(r), F.lit(0)))), F.lit(0))
    return F.greatest(F.coalesce("num_cols", F.lit(0)), seen, F.coalesce(F.size("title"), F.lit(0)))


def skip_reason(min_rows: int = 5, min_cols: int = 3) -> Column:
    """Why a table is not used, the first test that fails; null for a usable one."""
    return F.when(F.col("data").isNull(), "missing_data").when(F.size("data") < min_rows, "too_few_rows").when(width() < min_cols, "too_few_columns")


def with_names(tables: DataFrame) -> DataFrame:
    """Adds ``w`` and ``names``: headers cleaned, blank ones named after their position, repeated ones numbered."""
    base = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.coalesce(F.nullif(F.get("__title", i), F.lit("")), F.concat(F.lit("col_"), i.cast("string"))))

    def numbered(x: Column, i: Column) -> Column:
        before = F.size(F.filter(F.slice("__base", 1, i), lambda y: y == x))
        return F.when((i > 0) & (before > 0), F.concat(x, F.lit("_"), before.cast("string"))).otherwise(x)

    wide = tables.filter("data is not null").withColumn("w", width()).filter("w > 0").withColumn("__title", clean_each("title"))
    return wide.withColumn("__base", base).withColumn("names", F.transform("__base", numbered)).drop("__base", "__title")


def with_wiki_parts(df: DataFrame, raw: str = "raw") -> DataFrame:
    """Adds text, wiki_title and has_wiki_link of a cell such as ``[Page_Title|Text]``."""
    c, t, label = F.col("__c"), F.col("__t"), F.col("__l")
    out = df.withColumn("__c", clean_text(raw)).withColumn("has_wiki_link", c.rlike(WIKI_CELL))
    out = out.withColumns({"__t": F.replace(one_line(F.regexp_extract(c, WIKI_CELL, 1)), F.lit("_"), F.lit(" ")), "__l": F.regexp_extract(c, WIKI_CELL, 2)})
    space = F.when(t.contains(":"), F.lower(F.substring_index(t, ":", 1))).otherwise("")
    shown = F.replace(one_line(F.when(label != "", label).otherwise(t)), F.lit("_"), F.lit(" "))
    return out.withColumns({"text": F.when(F.col("has_wiki_link"), shown).otherwise(c), "wiki_title": F.when(F.col("has_wiki_link") & ~space.isin(*NO_ENTITY_SPACES), t)}).drop("__c", "__t", "__l")


def table_headers(tables: DataFrame) -> DataFrame:
    """(source_table_id, column_index, column_name) of the usable tables."""
    return with_names(tables).select("source_table_id", F.posexplode("names").alias("column_index", "column_name"))


def cells(tables: DataFrame) -> DataFrame:
    """The long form; short rows are padded with empty cells up to the table's width."""
    rows = with_names(tables).select("source_table_id", "names", "w", F.posexplode("data").alias("row_id", "row")).filter("row is not null")
    padded = F.transform(F.sequence(F.lit(0), F.col("w") - 1), lambda i: F.struct(F.get("names", i).alias("name"), F.coalesce(F.get("row", i), F.lit("")).alias("raw")))
    flat = rows.select("source_table_id", "row_id", F.posexplode(padded).alias("column_index", "c"))
    named = flat.select("source_table_id", "row_id", "column_index", F.col("c.name").alias("column_name"), F.col("c.raw").alias("raw"))
    return with_wiki_parts(named)


def column_profiles(cell: DataFrame, wiki_threshold: float = 0.3) -> DataFrame:
    """Per column: share of non-empty, linked, distinct and numeric cells, and whether it names entities."""
    some = F.col("text") != ""
    agg = cell.groupBy("source_table_id", "column_index").agg(
        F.count("*").alias("n"),
        F.count_if(some).alias("k"),
        F.count_if(F.coalesce(F.col("wiki_title"), F.lit("")) != "").alias("linked"),
        F.countDistinct(F.when(some, F.col("text"))).alias("distinct"),
        F.count_if(some & is_number("text")).alias("numeric"),
    )
    one = F.greatest(F.lit(1), F.col("k"))
    non_empty, wiki, unique, numeric = F.col("k") / F.col("n"), F.col("linked") / F.col("n"), F.col("distinct") / one, F.col("numeric") / one
    return agg.select(
        "source_table_id",
        "column_index",
        F.bround(non_empty, 6).alias("non_empty_ratio"),
        F.bround(wiki, 6).alias("wiki_link_ratio"),
        F.bround(unique, 6).alias("unique_ratio"),
        F.bround(numeric, 6).alias("numeric_ratio"),
        F.col("distinct").alias("distinct_count"),
        ((wiki >= wiki_threshold) & (non_empty >= 0.5) & (unique >= 0.2) & (numeric < 0.5)).alias("is_entity"),
    )


def entity_column(profiles: DataFrame, cell: DataFrame, least_linked: int = 5) -> DataFrame:
    """The entity column of a table: most linked, then leftmost, with enough linked rows."""
    linked = cell.filter("coalesce(wiki_title, '') <> ''").groupBy("source_table_id", "column_index").agg(F.count("*").alias("linked_rows"))
    ranked = profiles.filter("is_entity").join(linked.filter(F.col("linked_rows") >= least_linked), ["source_table_id", "column_index"])
    order = Window.partitionBy("source_table_id").orderBy(F.desc("wiki_link_ratio"), "column_index")
    return ranked.withColumn("r", F.row_number().over(order)).filter("r = 1").select("source_table_id", F.col("column_index").alias("entity_column"), "linked_rows")


def entities(cell: DataFrame) -> DataFrame:
    """Per linked page: distinct display texts, sorted, and the number of cells that name it."""
    named = cell.filter("coalesce(wiki_title, '') <> ''")
    texts = named.groupBy("wiki_title", "text").agg(F.count("*").alias("n"))
    return texts.groupBy("wiki_title").agg(F.array_join(F.array_sort(F.collect_set("text")), " | ").alias("display_texts"), F.sum("n").alias("n_cells"))


def context_terms(cell: DataFrame, most: int = 80) -> DataFrame:
    """Per linked page: the texts that stand beside it in its rows, most frequent first, up to ``most``."""
    row = cell.filter(F.col("text") != "").groupBy("source_table_id", "row_id").agg(
        F.collect_list(F.struct(F.col("column_index").alias("c"), F.col("text").alias("t"), F.col("wiki_title").alias("w"), is_number("text").alias("n"))).alias("r")
    )
    page = row.select("r", F.explode(F.filter("r", lambda x: F.coalesce(x["w"], F.lit("")) != "")).alias("p"))
    beside = page.select(F.col("p.w").alias("wiki_title"), F.col("p.c").alias("own"), F.explode("r").alias("b")).filter("b.c <> own and not b.n")
    counted = beside.groupBy("wiki_title", F.col("b.t").alias("term")).agg(F.count("*").alias("n"))
    order = Window.partitionBy("wiki_title").orderBy(F.desc("n"), "term")
    return counted.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most)


def serialized(cell: DataFrame, max_rows: int = 3, longest: int = 80) -> DataFrame:
    """``Columns: a | b`` and up to ``max_rows`` lines ``Row: x | y`` per table."""
    rows = cell.filter(F.col("row_id") < max_rows).groupBy("source_table_id", "row_id").agg(F.array_sort(F.collect_list(F.struct("column_index", "column_name", F.substring("text", 1, longest).alias("t")))).alias("c"))
    line = F.concat(F.lit("Row: "), F.array_join(F.transform("c", lambda x: x["t"]), " | "))
    head = F.concat(F.lit("Columns: "), F.array_join(F.transform("c", lambda x: x["column_name"]), " | "))
    lines = rows.select("source_table_id", "row_id", head.alias("head"), line.alias("line"))
    grouped = lines.groupBy("source_table_id").agg(F.min("head").alias("head"), F.array_sort(F.collect_list(F.struct("row_id", "line"))).alias("l"))
    return grouped.select("source_table_id", F.concat_ws("\n", "head", F.array_join(F.transform("l", lambda x: x["line"]), "\n")).alias("serialized"))


def entity_urls(cell: DataFrame, prefix: str = "https://wiki.example/wiki/") -> DataFrame:
    """A synthetic column with the percent-encoded page of each row's first linked cell; empty without one."""
    first = cell.groupBy("source_table_id", "row_id").agg(F.min(F.when(F.coalesce(F.col("wiki_title"), F.lit("")) != "", F.struct("column_index", "wiki_title"))).alias("x"))
    url = F.concat(F.lit(prefix), percent_encode(F.replace(F.col("x.wiki_title"), F.lit(" "), F.lit("_"))))
    return first.select("source_table_id", "row_id", F.lit(-1).alias("source_column_index"), F.lit("entity_url").alias("column_name"), F.coalesce(url, F.lit("")).alias("text"))


def projected_rows(cell: DataFrame, columns: list[int], dedupe: int | None = None) -> DataFrame:
    """Rows with a text in each of ``columns``; with ``dedupe`` only the first row of each value of it."""
    part = cell.filter(F.col("column_index").isin(columns)).select("source_table_id", "row_id", "column_index", cell_text("text").alias("text"))
    wide = part.groupBy("source_table_id", "row_id").pivot("column_index", columns).agg(F.min("text"))
    for c in columns:
        wide = wide.filter(F.coalesce(F.col(str(c)), F.lit("")) != "")
    if dedupe is not None:
        key = normalize(F.col(str(dedupe)))
        wide = wide.withColumn("k", key).filter("k <> ''").withColumn("r", F.row_number().over(Window.partitionBy("source_table_id", "k").orderBy("row_id"))).filter("r = 1").drop("r", "k")
    order = Window.partitionBy("source_table_id").orderBy("row_id")
    return wide.select("source_table_id", (F.row_number().over(order) - 1).alias("row_id"), F.col("row_id").alias("source_row_id"), *[F.col(str(c)).alias(f"c{c}") for c in columns])


def context_columns(profiles: DataFrame, exclude: DataFrame, most: int = 3) -> DataFrame:
    """Further columns of a table, fullest first, then least distinct, then rightmost."""
    rest = profiles.join(exclude.select("source_table_id", F.col("entity_column").alias("column_index")), ["source_table_id", "column_index"], "left_anti")
    order = Window.partitionBy("source_table_id").orderBy(F.desc("non_empty_ratio"), "unique_ratio", F.desc("column_index"))
    return rest.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= most).select("source_table_id", "column_index", "rank")


def says_nothing(name: Column) -> Column:
    return F.regexp_replace(F.lower(clean_text(name)), r"^[ .:]+|[ .:]+$", "").isin(*[h.strip(" .:") for h in EMPTY_HEADERS])


def reader_view(rows: Column) -> Column:
    """Rows of structs as arrays of texts, all a reader sees of them; null texts are empty."""
    return F.transform(rows, lambda r: F.transform(r["cells"], lambda c: F.coalesce(c["text"], F.lit(""))))


def source_columns(indices: Column) -> Column:
    """Map from a source column's index to its place in a projected table."""
    return F.map_from_entries(F.transform(F.array_distinct(indices), lambda c: F.struct(c, (F.array_position(indices, c) - 1).cast("int"))))


def permuted(key: Column, columns: Column, seed: int = 0) -> Column:
    """The places 0, 1, ... of an array in a digest order of ``key``, the same on every run."""
    places = F.transform(columns, lambda _, i: F.struct(F.sha2(F.concat_ws("|", F.lit(f"permute|{seed}"), key, i.cast("string")), 256).alias("d"), i.alias("i")))
    return F.transform(F.array_sort(places), lambda x: x["i"])


def context_choice(query: Column, target: Column, free: Column) -> Column:
    """(query, target): context columns for both sides, as many as each had: its own ones first, then free
    ones in order; a target takes none that the query shows. Null where there are not enough."""
    more = F.array_except(free, F.array_union(query, target))
    own = F.array_except(target, query)
    lacking = F.size(target) - F.size(own)
    chosen = F.concat(own, F.slice(more, F.lit(1), F.greatest(lacking, F.lit(0))))
    return F.when(F.size(chosen) == F.size(target), F.struct(query.alias("query"), chosen.alias("target")))


def shows_attribute(names: Column, texts: Column, attribute: Column) -> Column:
    """Whether a row already shows a value under a column of that name."""
    return F.exists(F.arrays_zip(names.alias("n"), texts.alias("t")), lambda x: (x["n"] == attribute) & (F.coalesce(x["t"], F.lit("")) != ""))


def evidence_is_shown(columns: Column, source_column: Column) -> Column:
    """Whether the column that an asset was made from is one of those a query displays."""
    return F.coalesce(F.array_contains(columns, source_column), F.lit(False))

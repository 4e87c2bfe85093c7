"""Building query, target and relevance records from lake tables and recovered attributes."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.functions.text import normalize, stable_json_hash, values_match
from lakeweave.operators.ranking import following
from lakeweave.operators.sampling import digest_positions
from lakeweave.runtime import settle


def required_rows(valid: Column, view_rows: int, ratio: str, least: int) -> Column:
    """max(least, ceil(ratio x min(valid, view_rows))) in exact decimals."""
    need = F.ceil(F.lit(ratio).cast("decimal(10,6)") * F.least(valid, F.lit(view_rows)).cast("decimal(10,0)"))
    return F.greatest(F.lit(least), need.cast("int"))


def recovered_rows(cells: DataFrame, entity: DataFrame, extractions: DataFrame) -> DataFrame:
    """(source_table_id, column_index, row_id): cells of linked rows whose value an extraction recovers.

    Extractions meet cells on table, row and normalised attribute; only then are values compared, so
    the loose comparison never spans rows."""
    linked = cells.join(entity.select("source_table_id", F.col("entity_column").alias("column_index")), ["source_table_id", "column_index"], "left_semi").filter("coalesce(wiki_title, '') <> ''")
    rows = linked.select("source_table_id", "row_id").distinct()
    c = cells.join(rows, ["source_table_id", "row_id"], "left_semi").filter("text <> ''").select("source_table_id", "row_id", "column_index", "text", normalize("column_name").alias("attribute"))
    e = extractions.select("source_table_id", F.col("source_row_id").alias("row_id"), normalize("attribute_name").alias("attribute"), "value")
    met = c.join(e, ["source_table_id", "row_id", "attribute"]).filter(values_match("value", "text"))
    return met.join(entity.select("source_table_id", "entity_column"), "source_table_id").filter("column_index <> entity_column").select("source_table_id", "column_index", "row_id").distinct()


def qualified_columns(cells: DataFrame, profiles: DataFrame, entity: DataFrame, extractions: DataFrame, view_rows: int = 5, ratio: str = "0.6", least: int = 2, filled: float = 0.5) -> DataFrame:
    """Columns that enough rows recover, best first: share of the valid rows, rows, position."""
    rec = recovered_rows(cells, entity, extractions).groupBy("source_table_id", "column_index").agg(F.count("*").alias("recovered"))
    valid = entity.select("source_table_id", "entity_column", F.col("linked_rows").alias("valid"))
    q = rec.join(valid, "source_table_id").join(profiles.select("source_table_id", "column_index", "non_empty_ratio"), ["source_table_id", "column_index"])
    q = q.withColumn("required", required_rows(F.col("valid"), view_rows, ratio, least))
    q = q.filter((F.col("valid") >= view_rows) & (F.col("recovered") >= F.col("required")) & (F.col("non_empty_ratio") >= filled))
    q = q.withColumn("ratio", F.bround(F.col("recovered") / F.col("valid"), 6))
    order = Window.partitionBy("source_table_id").orderBy(F.desc("ratio"), F.desc("recovered"), "column_index")
    return q.withColumn("rank", F.row_number().over(order)).select("source_table_id", "column_index", "valid", "recovered", "required", "ratio", "rank")


def context_layout(columns: DataFrame, least_context: int = 2) -> DataFrame:
    """Per table: which columns stay hidden bridges and which serve as query or target context.

    ``columns`` (source_table_id, column_index, is_entity, ratio, members, non_empty_ratio,
    unique_ratio): ``ratio`` is null for a column that does not qualify; ``members`` names the group of
    equal columns. The weakest groups become context until ``least_context`` columns are there; the
    last group is never given up, and a table that cannot reach the floor gives no rows. The context is
    halved in digest order, so the result is the same on every run. A group is one table's columns.
    """

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        table = pdf["source_table_id"].iloc[0]
        rows = pdf.to_dict("records")
        entity = {r["members"] for r in rows if r["is_entity"]}
        groups: dict[str, list[dict]] = {}
        for r in rows:
            if r["ratio"] == r["ratio"] and r["ratio"] is not None and r["members"] not in entity:
                groups.setdefault(r["members"], []).append(r)
        best = {m: min(g, key=lambda r: (-r["ratio"], r["column_index"])) for m, g in groups.items()}
        order = sorted(groups, key=lambda m: (-best[m]["ratio"], best[m]["column_index"]))
        taken = set(groups) | entity
        free = sorted((r for r in rows if r["members"] not in taken), key=lambda r: (-r["non_empty_ratio"], r["unique_ratio"], -r["column_index"]))
        context = [r["column_index"] for r in free]
        kept = list(order)
        for m in reversed(order):
            if len(context) >= least_context or len(kept) == 1:
                break
            kept.remove(m)
            context += [r["column_index"] for r in rows if r["members"] == m]
        if len(context) < least_context or not kept:
            return pd.DataFrame(columns=["source_table_id", "column_index", "role"])
        import hashlib

        dealt = sorted(context, key=lambda c: hashlib.sha256(f"context|{table}|{c}".encode()).hexdigest())
        half = max(1, round(len(dealt) / 2))
        out = [(table, r["column_index"], "hidden") for m in kept for r in rows if r["members"] == m]
        out += [(table, c, "target") for c in dealt[:half]] + [(table, c, "query") for c in dealt[half:]]
        out += [(table, r["column_index"], "entity") for r in rows if r["is_entity"]]
        return pd.DataFrame(out, columns=["source_table_id", "column_index", "role"])

    return columns.groupBy("source_table_id").applyInPandas(plan, "source_table_id string, column_index int, role string")


def query_ids(layout: DataFrame) -> DataFrame:
    """(source_table_id, query_id, target_id, hidden): one target per hidden column; ids by content."""
    shown = layout.filter("role in ('entity', 'query')").groupBy("source_table_id").agg(F.array_join(F.array_sort(F.collect_list("column_index")), ",").alias("shown"))
    hidden = layout.filter("role = 'hidden'").select("source_table_id", F.col("column_index").alias("hidden"))
    return hidden.join(shown, "source_table_id").select(
        "source_table_id",
        "hidden",
        F.concat(F.lit("query_"), stable_json_hash([F.col("source_table_id"), F.col("shown")])).alias("query_id"),
        F.concat(F.lit("target_"), stable_json_hash([F.col("source_table_id"), F.col("hidden").cast("string"), F.lit("target")])).alias("target_id"),
    )


def view_cells(cells: DataFrame, layout: DataFrame, ids: DataFrame, rows: DataFrame) -> DataFrame:
    """(query_id, row_id, source_row_id, column_index, column_name, text): what a query shows: the entity
    and its query context on the rows (source_table_id, row_id) chosen for it, rows numbered anew."""
    shown = layout.filter("role in ('entity', 'query')").select("source_table_id", "column_index")
    own = cells.join(rows, ["source_table_id", "row_id"], "left_semi").join(shown, ["source_table_id", "column_index"], "left_semi")
    placed = own.select("source_table_id", F.col("row_id").alias("source_row_id"), "column_index", "column_name", "text").withColumn("row_id", F.dense_rank().over(Window.partitionBy("source_table_id").orderBy("source_row_id")) - 1)
    return ids.select("source_table_id", "query_id").distinct().join(placed, "source_table_id").select("query_id", "row_id", "source_row_id", "column_index", "column_name", "text")


def target_cells(cells: DataFrame, layout: DataFrame, ids: DataFrame) -> DataFrame:
    """(target_id, row_id, source_row_id, column_index, column_name, text): what a target shows: its join
    column and the target context, on the first row of every value of the join column."""
    joins = ids.select("source_table_id", "target_id", F.col("hidden").alias("column_index")).join(cells.select("source_table_id", "column_index", "row_id", normalize("text").alias("k")), ["source_table_id", "column_index"]).filter("k <> ''")
    first = joins.groupBy("source_table_id", "target_id", "k").agg(F.min("row_id").alias("source_row_id"))
    placed = first.withColumn("row_id", F.row_number().over(Window.partitionBy("target_id").orderBy("source_row_id")) - 1).select("source_table_id", "target_id", "row_id", "source_row_id")
    columns = ids.select("target_id", "source_table_id", F.col("hidden").alias("column_index")).unionByName(ids.select("target_id", "source_table_id").join(layout.filter("role = 'target'").select("source_table_id", "column_index"), "source_table_id").select("target_id", "source_table_id", "column_index"))
    own = cells.select("source_table_id", F.col("row_id").alias("source_row_id"), "column_index", "column_name", "text")
    return placed.join(columns, ["target_id", "source_table_id"]).join(own, ["source_table_id", "source_row_id", "column_index"]).select("target_id", "row_id", "source_row_id", "column_index", "column_name", "text")


def build_dataset(cells: DataFrame, layout: DataFrame, rows: DataFrame) -> dict[str, DataFrame]:
    """Queries, targets and relevance records of all tables in one call.

    ``layout`` gives the columns' roles, ``rows`` (source_table_id, row_id) the rows a query shows. Query
    and target of one hidden column are relevant to each other; every frame stays lazy."""
    ids = settle(query_ids(layout))
    names = cells.select("source_table_id", F.col("column_index").alias("hidden"), F.col("column_name").alias("attribute")).distinct()
    qrels = ids.join(names, ["source_table_id", "hidden"]).select("query_id", "target_id", "source_table_id", "attribute", F.lit(1).alias("rel"))
    return {"queries": view_cells(cells, layout, ids, rows), "targets": target_cells(cells, layout, ids), "qrels": qrels}


def copied_columns(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Of (channel, column_name, asset_text, cell_text): channels whose texts copy the cell too often."""
    a, c = F.lower(F.trim("asset_text")), F.lower(F.trim("cell_text"))
    hit = (a == c) | ((F.length(c) >= 4) & a.contains(c))
    some = pairs.filter(F.coalesce(c, F.lit("")) != "")
    return some.groupBy("channel", "column_name").agg(F.bround(F.avg(hit.cast("double")), 6).alias("share"), F.count("*").alias("n")).filter(F.col("share") >= threshold)


def leaking_context(cells: DataFrame, hidden: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Columns whose cells show the hidden column's value on too many rows: they may not stay visible."""
    h = hidden.select("source_table_id", F.col("column_index").alias("hidden")).join(cells.select("source_table_id", F.col("column_index").alias("hidden"), "row_id", normalize("text").alias("h")), ["source_table_id", "hidden"]).filter("h <> ''")
    c = cells.select("source_table_id", "row_id", "column_index", normalize("text").alias("c")).filter("c <> ''")
    hit = (F.col("h") == F.col("c")) | ((F.least(F.length("h"), F.length("c")) >= 4) & (F.col("c").contains(F.col("h")) | F.col("h").contains(F.col("c"))))
    met = h.join(c, ["source_table_id", "row_id"]).filter("column_index <> hidden")
    return met.groupBy("source_table_id", "hidden", "column_index").agg(F.bround(F.avg(hit.cast("double")), 6).alias("share"), F.count("*").alias("n")).filter(F.col("share") >= threshold)


def degenerate_pairs(pairs: DataFrame, modal: DataFrame, most: float = 0.8) -> DataFrame:
    """(source_table_id, column_index) pairs whose join column is nearly constant."""
    return pairs.join(modal.filter(F.col("modal_share") >= most), ["source_table_id", "column_index"], "left_semi")


def candidate_lists(parts: dict[str, DataFrame]) -> DataFrame:
    """Union of candidate sets (query_id, target_id) with the names of the sets each pair came from."""
    every = None
    for name, df in parts.items():
        one = df.select("query_id", "target_id", F.lit(name).alias("origin"))
        every = one if every is None else every.unionByName(one)
    return every.groupBy("query_id", "target_id").agg(F.array_join(F.array_sort(F.collect_set("origin")), "+").alias("origin"))


def _prime_from(n: int) -> int:
    while any(n % d == 0 for d in range(2, int(n**0.5) + 1)):
        n += 1
    return n


def uniform_targets(queries: DataFrame, targets: DataFrame, excluded: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """k targets per query in a digest order of its own, none of the excluded ones; all that are left
    where there are fewer.

    The targets stand at the places of their digest order. A query walks through the places modulo the
    next prime with a start and a step of its own, which meets every place once; as many steps as it
    wants and excludes targets, and as there are empty places, are enough."""
    lib = settle(digest_positions(targets, "target_id", "library", seed).select("target_id", (F.col("position") - 1).alias("slot")))
    n = lib.count()
    p = _prime_from(max(n, 2))
    out = excluded.select("query_id", "target_id").distinct().groupBy("query_id").agg(F.count("*").alias("out"))
    width = F.least(F.lit(p), F.lit(k + p - n) + F.coalesce("out", F.lit(0)))
    asked = queries.select("query_id").distinct().join(out, "query_id", "left").select("query_id", F.explode(F.sequence(F.lit(0).cast("long"), (width - 1).cast("long"))).alias("i"))
    start, step = F.pmod(F.xxhash64("query_id", F.lit(seed)), F.lit(p)), 1 + F.pmod(F.xxhash64(F.lit(seed), "query_id"), F.lit(p - 1))
    walked = asked.withColumn("slot", F.pmod(start + F.col("i") * step, F.lit(p)))
    legal = walked.join(lib, "slot").join(excluded.select("query_id", "target_id"), ["query_id", "target_id"], "left_anti")
    return legal.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("i"))).filter(F.col("r") <= k).select("query_id", "target_id")


def competitors(bag: DataFrame, exact: DataFrame, uniform: DataFrame, protect: DataFrame, budget: int = 8) -> DataFrame:
    """Up to ``budget`` competitors per query: from the bag, then the exact list, then the sample."""
    parts = [df.select("query_id", "evidence_id", F.lit(p).alias("tier"), F.col("rank")) for p, df in ((1, bag), (2, exact), (3, uniform))]
    every = parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("query_id", "evidence_id").agg(F.min(F.struct("tier", "rank")).alias("x"))
    free = every.join(protect, ["query_id", "evidence_id"], "left_anti").select("query_id", "evidence_id", "x.tier", "x.rank")
    return free.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("tier", "rank", "evidence_id"))).filter(F.col("r") <= budget)


def edge_labels(edges: DataFrame, supported: DataFrame, corrupted: DataFrame) -> DataFrame:
    """1 for a supported (evidence, target), 0 for one only known from a corrupted path, null otherwise."""
    s, c = supported.select("evidence_id", "target_id").distinct().withColumn("s", F.lit(1)), corrupted.select("evidence_id", "target_id").distinct().withColumn("c", F.lit(1))
    return edges.join(s, ["evidence_id", "target_id"], "left").join(c, ["evidence_id", "target_id"], "left").withColumn("label", F.when(F.col("s") == 1, 1).when(F.col("c") == 1, 0)).drop("s", "c")


def nearest_shape(queries: DataFrame, targets: DataFrame, excluded: DataFrame) -> DataFrame:
    """(query_id, target_id): the first target, not excluded, of the most similar shape (columns, rows).

    Shapes are few: query shapes meet bucket heads, each bucket reduced to as many first ids as any
    query excludes, plus one."""
    n = (excluded.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0) + 1
    head = targets.withColumn("r", F.row_number().over(Window.partitionBy("cols", "rows").orderBy("target_id"))).filter(F.col("r") <= n).select(F.col("cols").alias("tc"), F.col("rows").alias("tr"), "target_id")
    order = Window.partitionBy("cols", "rows").orderBy(F.abs(F.col("tc") - F.col("cols")), F.abs(F.col("tr") - F.col("rows")), "tc", "tr", "target_id")
    ranked = queries.select("cols", "rows").distinct().crossJoin(head).withColumn("place", F.row_number().over(order)).filter(F.col("place") <= n)
    met = queries.join(ranked.select("cols", "rows", "target_id", "place"), ["cols", "rows"]).join(excluded, ["query_id", "target_id"], "left_anti")
    return met.withColumn("r", F.row_number().over(Window.partitionBy("query_id").orderBy("place"))).filter("r = 1").select("query_id", "target_id")


def swap_ring(ids: DataFrame, key: str) -> DataFrame:
    """Every id with the next one in byte order, the last with the first."""
    return following(ids, key, "partner")

"""Relevance labels, pool metrics, ambiguity and impact of joins, invariants of query sets, assets to drop."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.operators.ranking import top_k


def labels(gold: DataFrame, direct: DataFrame, witnesses: DataFrame) -> DataFrame:
    """Per query (query_id): its relevant targets, its direct candidates, and per relevant target the
    evidence that supports the pair, all sorted by bytes; witnesses (query_id, target_id, evidence_id)."""
    sets = lambda df, name: df.groupBy("query_id").agg(F.array_sort(F.collect_set("target_id")).alias(name))
    own = witnesses.join(gold, ["query_id", "target_id"], "left_semi").groupBy("query_id", "target_id").agg(F.array_sort(F.collect_set("evidence_id")).alias("evidence"))
    support = own.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("target_id", "evidence"))).alias("support"))
    return sets(gold, "relevant").join(sets(direct, "direct"), "query_id", "left").join(support, "query_id", "left")


def protected_evidence(gold: DataFrame, witnesses: DataFrame) -> DataFrame:
    """(query_id, target_id, evidence_id): what may not be a competitor of a pair: evidence of the pair,
    of the query's other pairs and of the target under any query."""
    own = witnesses.join(gold, ["query_id", "target_id"], "left_semi").select("query_id", "target_id", "evidence_id").distinct()
    by_query = gold.join(own.select("query_id", "evidence_id").distinct(), "query_id")
    by_target = gold.join(own.select("target_id", "evidence_id").distinct(), "target_id")
    columns = ["query_id", "target_id", "evidence_id"]
    return by_query.select(*columns).unionByName(by_target.select(*columns)).distinct()


def pool_metrics(pools: DataFrame, gold: DataFrame, k: int = 10) -> DataFrame:
    """Per collection and query of (collection, query_id, target_id): size, relevant targets in it, their
    share of all, whether there is one, and the recall at ``k`` that an ideal order could reach."""
    size = gold.groupBy("query_id").agg(F.count("*").alias("n_gold"))
    hit = pools.join(gold.withColumn("hit", F.lit(1)), ["query_id", "target_id"], "left")
    per = hit.groupBy("collection", "query_id").agg(F.count("*").alias("size"), F.count("hit").alias("hits"))
    every = size.join(pools.select("collection").distinct().hint("broadcast"), how="cross")  # a few names
    j = every.join(per, ["collection", "query_id"], "left").na.fill(0, ["size", "hits"])
    return j.select("collection", "query_id", "size", "hits", F.round(F.col("hits") / F.col("n_gold"), 6).alias("coverage"), (F.col("hits") > 0).alias("hit"), F.round(F.least(F.lit(k), F.col("hits")) / F.col("n_gold"), 6).alias("oracle"))


def first_hits(ranked: DataFrame, gold: DataFrame) -> DataFrame:
    """One row: mean reciprocal rank and the shares of queries with a hit at rank 1 and up to 3."""
    first = ranked.join(gold, ["query_id", "target_id"], "left_semi").groupBy("query_id").agg(F.min("rank").alias("first"))
    j = gold.select("query_id").distinct().join(first, "query_id", "left")
    share = lambda c: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 6)
    return j.agg(F.count("*").alias("queries"), share(1 / F.col("first")).alias("mrr"), share(F.col("first") <= 1).alias("hit_1"), share(F.col("first") <= 3).alias("hit_3"))


def value_ambiguity(claims: DataFrame, cells: DataFrame, gold: DataFrame) -> DataFrame:
    """(query_id, attribute, value, n_gold, n_other): tables that hold a recovered value in the column of
    that name, relevant ones and others. Others are counted per value once, never listed."""
    asked = claims.select("query_id", "attribute", "value").distinct()
    holds = cells.select(F.col("column_name").alias("attribute"), F.col("text").alias("value"), F.col("source_table_id").alias("target_id")).join(asked.select("attribute", "value").distinct(), ["attribute", "value"], "left_semi").distinct()
    total = holds.groupBy("attribute", "value").agg(F.count("*").alias("n_all"))
    own = asked.join(gold, "query_id").join(holds, ["attribute", "value", "target_id"], "left_semi").groupBy("query_id", "attribute", "value").agg(F.count("*").alias("n_gold"))
    j = asked.join(total, ["attribute", "value"], "left").join(own, ["query_id", "attribute", "value"], "left").na.fill(0, ["n_all", "n_gold"])
    return j.select("query_id", "attribute", "value", "n_gold", (F.col("n_all") - F.col("n_gold")).alias("n_other"))


def value_overlap(pairs: DataFrame, query_values: DataFrame, target_values: DataFrame) -> DataFrame:
    """Per kind of (query_id, target_id, kind): pairs, and those that share a value in a column of the
    same name; values (query_id, attribute, v_key) and (target_id, attribute, v_key)."""
    p = pairs.distinct()
    met = p.join(query_values.distinct(), "query_id").join(target_values.distinct(), ["target_id", "attribute", "v_key"]).select("query_id", "target_id", "kind").distinct().withColumn("m", F.lit(1))
    j = p.join(met, ["query_id", "target_id", "kind"], "left")
    return j.groupBy("kind").agg(F.count("*").alias("pairs"), F.count("m").alias("overlapping"), F.round(F.count("m") / F.count("*"), 6).alias("share"))


def join_impact(edges: DataFrame) -> DataFrame:
    """Per attribute of edges (query_id, target_id, attribute): the pairs and queries that use it, and the
    queries that would lose every relevant target without it."""
    e = edges.distinct()
    pair = Window.partitionBy("query_id", "target_id")
    only = e.withColumn("ways", F.count("*").over(pair)).withColumn("targets", F.size(F.collect_set("target_id").over(Window.partitionBy("query_id"))))
    per = only.groupBy("attribute", "query_id").agg(F.count("*").alias("pairs"), F.count_if(F.col("ways") == 1).alias("lost"), F.max("targets").alias("targets"))
    return per.groupBy("attribute").agg(F.sum("pairs").alias("pairs"), F.count("*").alias("queries"), F.count_if(F.col("lost") == F.col("targets")).alias("queries_without_target"))


def violations(views: DataFrame) -> DataFrame:
    """(rule, key, n) of query views (table_id, source_table_id, split, row, source_row_id) that break an
    invariant: a source row in two views, a source in two splits, a view with one source row twice."""
    rows = views.filter("source_table_id is not null and source_row_id is not null")
    place = F.concat_ws("#", "source_table_id", F.col("source_row_id").cast("string"))
    shared = rows.select(place.alias("key"), "table_id").distinct().groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("row_in_several_views").alias("rule"), "key", "n")
    torn = views.filter("source_table_id is not null and split is not null").select(F.col("source_table_id").alias("key"), "split").distinct().groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select(F.lit("source_in_several_splits").alias("rule"), "key", "n")
    twice = rows.select("table_id", "row", place.alias("p")).distinct().groupBy("table_id", "p").agg(F.count("*").alias("n")).filter("n > 1").groupBy(F.col("table_id").alias("key")).agg(F.count("*").alias("n")).select(F.lit("row_twice_in_a_view").alias("rule"), "key", "n")
    return shared.unionByName(torn).unionByName(twice)


def repeated_labels(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Labels that occur more than once."""
    return pairs.groupBy(*keys).agg(F.count("*").alias("n")).filter("n > 1")


def residual_order(ranked: DataFrame, base: str, score: str, scale: float) -> DataFrame:
    """Lists (query_id, target_id) ranked anew by base + scale x (score - base), ties by target."""
    moved = ranked.withColumn("scaled", F.col(base) + scale * (F.col(score) - F.col(base)))
    return top_k(moved, ["query_id"], [F.desc("scaled"), F.col("target_id")], 1 << 30, "new_rank")


def top_records(ranked: DataFrame, paths: DataFrame, k: int, paths_k: int) -> DataFrame:
    """(query_id, target_id, rank, evidence): the first ``k`` targets with at most ``paths_k`` distinct
    evidences of their best paths (query_id, target_id, evidence_id, score), best first."""
    best = paths.groupBy("query_id", "target_id", "evidence_id").agg(F.max("score").alias("score"))
    kept = top_k(best, ["query_id", "target_id"], [F.desc("score"), F.col("evidence_id")], paths_k, "place")
    listed = kept.groupBy("query_id", "target_id").agg(F.array_sort(F.collect_list(F.struct("place", "evidence_id"))).alias("e"))
    head = ranked.filter(F.col("rank") <= k).select("query_id", "target_id", "rank")
    return head.join(listed, ["query_id", "target_id"], "left").select("query_id", "target_id", "rank", F.coalesce(F.transform("e", lambda x: x["evidence_id"]), F.array().cast("array<string>")).alias("evidence"))


def one_per_kind(paths: DataFrame, kind: str, score: str) -> DataFrame:
    """For every query and kind of evidence the one of the highest mean score, ties to the smaller id."""
    mean = paths.groupBy("query_id", kind, "evidence_id").agg(F.avg(score).alias("mean"))
    return top_k(mean, ["query_id", kind], [F.desc("mean"), F.col("evidence_id")], 1, "r").drop("r")


def removable_assets(assets: DataFrame, labelled: DataFrame, popularity: DataFrame, hub: int, sources: list[str]) -> DataFrame:
    """(asset_id, rule) of assets (asset_id, asset_type, source, cls) that a rule would drop; assets of a
    content class that holds a labelled asset (asset_id) are never dropped.

    hub: the class is used by at least ``hub`` queries (asset_id, n), text_hub: and is a text;
    unlabelled_text: a text; unsupported_source: its source has no labelled asset; listed_source: its
    source is one of ``sources``.
    """
    marked = assets.join(labelled.select("asset_id").distinct(), "asset_id", "left_semi")
    free = assets.join(marked.select("cls").distinct(), "cls", "left_anti")
    used = assets.join(popularity, "asset_id").groupBy("cls").agg(F.sum("n").alias("used")).filter(F.col("used") >= hub)
    hubs = free.join(used.select("cls"), "cls", "left_semi")
    text = F.col("asset_type") == "text"
    backed = marked.select("source").filter("source is not null").distinct()
    rules = {"hub": hubs, "text_hub": hubs.filter(text), "unlabelled_text": free.filter(text), "unsupported_source": free.join(backed, "source", "left_anti"), "listed_source": free.filter(F.col("source").isin(sources))}
    out = None
    for rule, df in rules.items():
        one = df.select("asset_id", F.lit(rule).alias("rule")).distinct()
        out = one if out is None else out.unionByName(one)
    return out


def unanchored_texts(titles: DataFrame, texts: DataFrame, share: float = 0.01, words: int = 3) -> DataFrame:
    """(id) of texts (id, row, text) that do not name enough of their row's distinctive title words.

    Distinctive are the ``words`` rarest of the words in at most ceil(``share`` x rows) titles (row,
    title); two of them must stand in the text, or the only one. A text without any is unanchored."""

    def tokens(c: Column) -> Column:
        return F.array_distinct(F.filter(F.regexp_extract_all(F.lower(F.coalesce(c, F.lit(""))), F.lit(r"(?U)\w+"), F.lit(0)), lambda w: (F.length(w) > 2) & w.rlike(r"^\p{L}+$")))

    own = titles.select("row", F.explode(tokens(F.col("title"))).alias("word"))
    frequency = own.groupBy("word").agg(F.count("*").alias("n"))
    limit = titles.select("row").distinct().agg(F.ceil(F.count("*") * share).alias("limit"))
    rare = own.join(frequency, "word").join(F.broadcast(limit)).filter("n <= limit")
    anchors = top_k(rare, ["row"], [F.col("n"), F.col("word")], words, "r").groupBy("row").agg(F.collect_set("word").alias("anchors"))
    j = texts.join(anchors, "row", "left")
    enough = F.size(F.array_intersect("anchors", tokens(F.col("text")))) >= F.least(F.lit(2), F.size("anchors"))
    return j.filter(~F.coalesce(enough, F.lit(False))).select("id").distinct()

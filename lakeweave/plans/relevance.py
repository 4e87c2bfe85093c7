"""Queries on labels, losses, candidate pools, ambiguity and invariants of query sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions.text import bare_url, norm
from lakeweave.functions.values import with_value
from lakeweave.operators import cells as C
from lakeweave.operators import losses as L
from lakeweave.operators import profiles as P
from lakeweave.operators import relevance as V
from lakeweave.plans import lake, records, search
from lakeweave.plans import sqlkit as K
from lakeweave.runtime import settle, table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lists(s, root):
    """(query_id, target_id, score, rank, positive): the candidates of every view and whether they are relevant."""
    near = search.views(s, root).join(search.nearest(s, root).withColumnRenamed("query_id", "source_table_id"), "source_table_id").select(F.col("table_id").alias("query_id"), "target_id", "score", "rank")
    marked = near.join(search.gold(s, root).withColumn("g", F.lit(True)), ["query_id", "target_id"], "left")
    return settle(marked.select("query_id", "target_id", "score", "rank", F.col("g").isNotNull().alias("positive")))


SC = f"{search.Z}, {search.GOLD}, sc AS (SELECT vw.table_id AS query_id, near.target_id, near.score, near.rank, gold.target_id IS NOT NULL AS positive FROM vw JOIN near ON near.query_id = vw.source_table_id LEFT JOIN gold ON gold.query_id = vw.table_id AND gold.target_id = near.target_id)"


def rounded(df):
    return df.withColumn("loss", F.round("loss", 6))


@query(f"WITH {SC} SELECT query_id, CASE WHEN count(*) FILTER (positive) > 0 AND count(*) FILTER (NOT positive) > 0 THEN round(ln(sum(exp(score))) - ln(sum(exp(score)) FILTER (positive)), 6) END AS loss FROM sc GROUP BY 1")
def rank_mass_losses(s, root):
    return rounded(L.rank_mass_loss(lists(s, root), ["query_id"], "score", F.col("positive")))


@query(f"WITH {SC}, ng AS (SELECT query_id, ln(sum(exp(score)) FILTER (NOT positive)) AS m FROM sc GROUP BY 1) SELECT query_id, round(avg(ln(1 + exp(m - score))) FILTER (positive), 6) AS loss FROM sc JOIN ng USING (query_id) GROUP BY 1")
def pair_losses(s, root):
    return rounded(L.pair_loss(lists(s, root), ["query_id"], "score", F.col("positive")))


@query(f"WITH {SC} SELECT target_id, round(avg(m), 6) AS mean FROM (SELECT target_id, positive, avg(score) AS m FROM sc GROUP BY 1, 2) GROUP BY 1")
def two_level_means(s, root):
    return L.two_level_mean(lists(s, root), ["target_id"], "positive", "score").withColumn("mean", F.round("mean", 6))


def _kl(source: str) -> str:
    return f"SELECT query_id, sum(exp(t - tl) * ((t - tl) - (u - ul))) AS loss FROM (SELECT *, ln(sum(exp(t)) OVER (PARTITION BY query_id)) AS tl, ln(sum(exp(u)) OVER (PARTITION BY query_id)) AS ul FROM {source}) GROUP BY 1"


TU = "tu AS (SELECT *, score * 20 AS t, -rank / 10.0 AS u FROM sc)"


def _taught(s, root):
    return lists(s, root).withColumns({"t": F.col("score") * 20, "u": -F.col("rank") / 10.0})


@query(f"WITH {SC}, {TU} SELECT query_id, round(loss, 6) AS loss FROM ({_kl('tu')})")
def list_divergences(s, root):
    return rounded(L.list_divergence(_taught(s, root), ["query_id"], "u", "t"))


@query(
    f"""WITH {SC}, {TU}, rk AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY t DESC, target_id) AS r, count(*) OVER (PARTITION BY query_id) AS n FROM tu), hd AS (SELECT * FROM rk WHERE r <= 10),
 ms AS (SELECT query_id, CASE WHEN max(n) > 10 THEN ln(sum(exp(u))) - ln(sum(exp(u)) FILTER (r <= 10)) ELSE 0 END AS m FROM rk GROUP BY 1)
 SELECT query_id, round(loss + m, 6) AS loss FROM ({_kl('hd')}) JOIN ms USING (query_id)"""
)
def top_list_divergences(s, root):
    return rounded(L.top_list_divergence(_taught(s, root), ["query_id"], "u", "t", [F.col("target_id")], 10))


@query(
    f"""WITH {SC}, po AS (SELECT 'first_30' AS collection, query_id, target_id FROM sc WHERE rank <= 30 UNION ALL SELECT 'all_50', query_id, target_id FROM sc), sz AS (SELECT query_id, count(*) AS n FROM gold GROUP BY 1),
 ht AS (SELECT collection, query_id, count(*) AS size, count(gold.query_id) AS hits FROM po LEFT JOIN gold USING (query_id, target_id) GROUP BY 1, 2)
 SELECT c.collection, sz.query_id, coalesce(size, 0) AS size, coalesce(hits, 0) AS hits, round(coalesce(hits, 0) / n, 6) AS coverage, coalesce(hits, 0) > 0 AS hit, round(least(10, coalesce(hits, 0)) / n, 6) AS oracle FROM sz JOIN (SELECT DISTINCT collection FROM po) c ON true LEFT JOIN ht ON ht.query_id = sz.query_id AND ht.collection = c.collection"""
)
def candidate_pool_metrics(s, root):
    n = lists(s, root)
    pools = n.filter("rank <= 30").select(F.lit("first_30").alias("collection"), "query_id", "target_id").unionByName(n.select(F.lit("all_50").alias("collection"), "query_id", "target_id"))
    return V.pool_metrics(pools, search.gold(s, root))


@query(f"WITH {SC}, f AS (SELECT query_id, min(rank) AS r FROM sc WHERE positive GROUP BY 1) SELECT count(*) AS queries, round(avg(coalesce(1 / r, 0)), 6) AS mrr, round(avg(coalesce((r <= 1)::INT, 0)), 6) AS hit_1, round(avg(coalesce((r <= 3)::INT, 0)), 6) AS hit_3 FROM (SELECT DISTINCT query_id FROM gold) LEFT JOIN f USING (query_id)")
def first_hit_metrics(s, root):
    return V.first_hits(lists(s, root), search.gold(s, root))


@query(f"WITH {SC} SELECT query_id, target_id, row_number() OVER (PARTITION BY query_id ORDER BY score + 0.5 * (1.0 / rank - score) DESC, target_id) AS new_rank FROM sc")
def residual_orders(s, root):
    n = lists(s, root).withColumn("other", 1.0 / F.col("rank"))
    return V.residual_order(n, "score", "other", 0.5).select("query_id", "target_id", "new_rank")


@query(f"WITH {SC}, ev AS (SELECT a.query_id, a.target_id, b.target_id AS evidence_id, a.score + b.score AS score FROM sc a JOIN sc b ON a.query_id = b.query_id AND b.rank <= 12 AND a.target_id <> b.target_id WHERE a.rank <= 5), kp AS (SELECT *, row_number() OVER (PARTITION BY query_id, target_id ORDER BY score DESC, evidence_id) AS p FROM (SELECT query_id, target_id, evidence_id, max(score) AS score FROM ev GROUP BY ALL)) SELECT query_id, target_id, sc.rank, array_to_string(coalesce(list(evidence_id ORDER BY p) FILTER (p IS NOT NULL), []), ',') AS evidence FROM (SELECT * FROM sc WHERE rank <= 5) sc LEFT JOIN (SELECT * FROM kp WHERE p <= 3) k USING (query_id, target_id) GROUP BY ALL")
def exported_records(s, root):
    """The first five targets of a view with the three best of the other close tables as their evidence."""
    n = lists(s, root)
    head, near = n.filter("rank <= 5"), n.filter("rank <= 12").select("query_id", F.col("target_id").alias("evidence_id"), F.col("score").alias("s2"))
    paths = head.select("query_id", "target_id", "score").join(near, "query_id").filter("target_id <> evidence_id").select("query_id", "target_id", "evidence_id", (F.col("score") + F.col("s2")).alias("score"))
    return V.top_records(head, paths, 5, 3).withColumn("evidence", F.array_join("evidence", ","))


def _witnesses(s, root):
    """Pairs of a view and a relevant table with the view's hidden attributes as what supports them."""
    q = table(s, root, "query_tables").filter("table_id is not null").select(F.col("table_id").alias("query_id"), "hidden_attributes", "target_table_ids").distinct()
    return q.select("query_id", F.explode("hidden_attributes").alias("evidence_id"), "target_table_ids").select("query_id", "evidence_id", F.explode("target_table_ids").alias("target_id")).filter("target_id is not null and evidence_id is not null").distinct()


WIT = "wt AS (SELECT DISTINCT query_id, target_id, evidence_id FROM (SELECT query_id, evidence_id, unnest(target_table_ids) AS target_id FROM (SELECT table_id AS query_id, unnest(hidden_attributes) AS evidence_id, target_table_ids FROM query_tables WHERE table_id IS NOT NULL)) WHERE target_id IS NOT NULL AND evidence_id IS NOT NULL)"


@query(f"WITH {search.Z}, {search.GOLD}, {WIT}, g AS (SELECT query_id, list(target_id ORDER BY target_id) AS r FROM gold GROUP BY 1), d AS (SELECT table_id AS query_id, list(DISTINCT target ORDER BY target) AS d FROM scope GROUP BY 1), w AS (SELECT query_id, list(target_id || ':' || e ORDER BY target_id) AS w FROM (SELECT query_id, target_id, string_agg(evidence_id, '+' ORDER BY evidence_id) AS e FROM wt GROUP BY 1, 2) GROUP BY 1) SELECT query_id, array_to_string(r, ',') AS relevant, array_to_string(d, ',') AS direct, array_to_string(w, ',') AS support FROM g LEFT JOIN d USING (query_id) LEFT JOIN w USING (query_id)")
def relevance_labels(s, root):
    direct = search.scope(s, root).select(F.col("table_id").alias("query_id"), F.col("target").alias("target_id"))
    n = V.labels(search.gold(s, root), direct, _witnesses(s, root))
    support = F.transform("support", lambda x: F.concat(x["target_id"], F.lit(":"), F.array_join(x["evidence"], "+")))
    return n.select("query_id", F.array_join("relevant", ",").alias("relevant"), F.array_join("direct", ",").alias("direct"), F.array_join(support, ",").alias("support"))


@query(f"WITH {search.GOLD}, {WIT} SELECT DISTINCT query_id, target_id, evidence_id FROM (SELECT gold.query_id, gold.target_id, wt.evidence_id FROM gold JOIN wt USING (query_id) UNION ALL SELECT gold.query_id, gold.target_id, wt.evidence_id FROM gold JOIN wt USING (target_id))")
def protected_evidence(s, root):
    return V.protected_evidence(search.gold(s, root), _witnesses(s, root))


@query(
    f"""WITH {K.CELLS}, {search.GOLD}, cl AS (SELECT DISTINCT q.table_id AS query_id, q.attribute, c.text AS value FROM (SELECT table_id, source_table_id, attribute, rows[row + 1].source_row_id AS source_row_id FROM (SELECT *, unnest(range(len(rows))) AS row FROM (
   SELECT table_id, source_table_id, rows, unnest(hidden_attributes) AS attribute FROM (SELECT DISTINCT table_id, source_table_id, rows, hidden_attributes FROM query_tables WHERE table_id IS NOT NULL AND rows IS NOT NULL)))) q JOIN cells c ON c.source_table_id = q.source_table_id AND c.row_id = q.source_row_id AND c.column_name = q.attribute),
 ho AS (SELECT DISTINCT column_name AS attribute, text AS value, source_table_id AS target_id FROM cells)
 SELECT cl.query_id, cl.attribute, cl.value, count(gold.target_id) AS n_gold, count(ho.target_id) - count(gold.target_id) AS n_other FROM cl LEFT JOIN ho USING (attribute, value) LEFT JOIN gold ON gold.query_id = cl.query_id AND gold.target_id = ho.target_id GROUP BY ALL"""
)
def recovery_ambiguity(s, root):
    cells = settle(search.lake_cells(s, root))
    return V.value_ambiguity(search.claims(s, root, cells).withColumnRenamed("table_id", "query_id"), cells, search.gold(s, root))


@query(f"WITH {WIT}, e AS (SELECT query_id, target_id, evidence_id AS attribute FROM wt), o AS (SELECT *, count(*) OVER (PARTITION BY query_id, target_id) AS ways FROM e), t AS (SELECT query_id, count(DISTINCT target_id) AS targets FROM e GROUP BY 1), p AS (SELECT attribute, query_id, count(*) AS pairs, count(*) FILTER (ways = 1) AS lost, max(targets) AS targets FROM o JOIN t USING (query_id) GROUP BY 1, 2) SELECT attribute, sum(pairs)::BIGINT AS pairs, count(*) AS queries, count(*) FILTER (lost = targets) AS queries_without_target FROM p GROUP BY 1")
def join_impact(s, root):
    return V.join_impact(_witnesses(s, root).withColumnRenamed("evidence_id", "attribute"))


VW = "v AS (SELECT table_id, source_table_id, nullif(regexp_replace(lower(split), '\\s+', '', 'g'), '') AS split, row, rows[row + 1].source_row_id AS source_row_id FROM (SELECT *, unnest(range(len(rows))) AS row FROM (SELECT DISTINCT table_id, source_table_id, split, rows FROM query_tables WHERE table_id IS NOT NULL AND rows IS NOT NULL)))"


@query(f"""WITH {VW}, r AS (SELECT *, source_table_id || '#' || source_row_id AS k FROM v WHERE source_table_id IS NOT NULL AND source_row_id IS NOT NULL)
 SELECT 'row_in_several_views' AS rule, k AS key, count(DISTINCT table_id) AS n FROM r GROUP BY 2 HAVING count(DISTINCT table_id) > 1
 UNION ALL SELECT 'source_in_several_splits', source_table_id, count(DISTINCT split) FROM v WHERE source_table_id IS NOT NULL AND split IS NOT NULL GROUP BY 2 HAVING count(DISTINCT split) > 1
 UNION ALL SELECT 'row_twice_in_a_view', table_id, count(*) FROM (SELECT table_id, k FROM (SELECT DISTINCT table_id, row, k FROM r) GROUP BY 1, 2 HAVING count(*) > 1) GROUP BY 2""")
def query_violations(s, root):
    q = table(s, root, "query_tables").filter("table_id is not null and rows is not null").select("table_id", "source_table_id", F.nullif(F.regexp_replace(F.lower("split"), r"\s+", ""), F.lit("")).alias("split"), "rows").distinct()
    rows = q.select("table_id", "source_table_id", "split", F.posexplode("rows").alias("row", "r")).select("table_id", "source_table_id", "split", "row", F.col("r.source_row_id").alias("source_row_id"))
    return V.violations(rows)


@query("WITH p AS (SELECT table_id AS query_id, unnest(target_table_ids) AS target_id FROM query_tables WHERE table_id IS NOT NULL) SELECT query_id, target_id, count(*) AS n FROM p WHERE target_id IS NOT NULL GROUP BY ALL HAVING count(*) > 1")
def repeated_labels(s, root):
    p = table(s, root, "query_tables").filter("table_id is not null").select(F.col("table_id").alias("query_id"), F.explode("target_table_ids").alias("target_id")).filter("target_id is not null")
    return V.repeated_labels(p, ["query_id", "target_id"])


@query("SELECT table_id, CASE WHEN min(k) <> max(k) THEN 'mixed' WHEN min(k) THEN 'implicit' ELSE 'explicit' END AS kind FROM (SELECT table_id, coalesce(len(hidden_attributes), 0) > 0 AS k FROM query_tables WHERE table_id IS NOT NULL) GROUP BY 1")
def query_kinds(s, root):
    q = table(s, root, "query_tables").filter("table_id is not null").select("table_id", (F.coalesce(F.size("hidden_attributes"), F.lit(0)) > 0).alias("k"))
    return q.groupBy("table_id").agg(F.min("k").alias("a"), F.max("k").alias("z")).select("table_id", F.when(F.col("a") != F.col("z"), "mixed").when(F.col("a"), "implicit").otherwise("explicit").alias("kind"))


SIGN = "sha256(array_to_string(coalesce(column_names, []), chr(31)) || chr(29) || array_to_string([r.source_row_id || chr(31) || array_to_string([coalesce(c.text, '') FOR c IN r.cells], chr(31)) FOR r IN rows], chr(30)))"


@query(f"SELECT fingerprint, min(table_id) AS first_id, count(DISTINCT table_id) AS n FROM (SELECT table_id, {SIGN} AS fingerprint FROM query_tables WHERE table_id IS NOT NULL AND rows IS NOT NULL AND len([r FOR r IN rows IF r.source_row_id IS NULL]) = 0) GROUP BY 1")
def view_fingerprints(s, root):
    """Views that show the same columns, source rows and texts."""
    q = table(s, root, "query_tables").filter("table_id is not null and rows is not null").filter(~F.exists("rows", lambda r: r["source_row_id"].isNull()))
    row = F.transform("rows", lambda r: F.concat(r["source_row_id"].cast("string"), F.lit("\x1f"), F.array_join(F.transform(r["cells"], lambda c: F.coalesce(c["text"], F.lit(""))), "\x1f")))
    sign = F.sha2(F.concat(F.array_join(F.coalesce("column_names", F.array().cast("array<string>")), "\x1f"), F.lit("\x1d"), F.array_join(row, "\x1e")), 256)
    return q.select("table_id", sign.alias("fingerprint")).groupBy("fingerprint").agg(F.min("table_id").alias("first_id"), F.countDistinct("table_id").alias("n"))


@query(f"WITH {K.PROFILES} SELECT source_table_id, column_index, (non_empty_ratio >= 0.6 AND numeric_ratio <= 0.8 AND unique_ratio <= 0.9) AS bridge, (non_empty_ratio >= 0.6 AND distinct_count >= 2) AS target FROM profiles")
def chain_columns(s, root):
    """Columns that can serve as a bridge, or as a target, of a chain of joins."""
    filled = F.col("non_empty_ratio") >= 0.6
    return lake.profile(s, root).select("source_table_id", "column_index", (filled & (F.col("numeric_ratio") <= 0.8) & (F.col("unique_ratio") <= 0.9)).alias("bridge"), (filled & (F.col("distinct_count") >= 2)).alias("target"))


@query(
    f"""WITH {K.CELLS}, w AS (SELECT source_table_id, row_id, max(text) FILTER (column_index = 0) AS b, max(text) FILTER (column_index = 1) AS c1, max(text) FILTER (column_index = 2) AS c2 FROM cells GROUP BY 1, 2),
 k AS (SELECT DISTINCT source_table_id, b FROM w WHERE b <> '' AND c1 <> '' AND c2 <> ''),
 d1 AS (SELECT *, row_number() OVER (PARTITION BY source_table_id, b ORDER BY n DESC, f) AS r FROM (SELECT source_table_id, b, c1, count(*) AS n, min(row_id) AS f FROM w WHERE b <> '' AND c1 <> '' GROUP BY ALL)),
 d2 AS (SELECT *, row_number() OVER (PARTITION BY source_table_id, b ORDER BY n DESC, f) AS r FROM (SELECT source_table_id, b, c2, count(*) AS n, min(row_id) AS f FROM w WHERE b <> '' AND c2 <> '' GROUP BY ALL))
 SELECT k.source_table_id, row_number() OVER (PARTITION BY k.source_table_id ORDER BY k.b) - 1 AS row_id, k.b AS bridge, c1, c2 FROM k JOIN d1 ON d1.source_table_id = k.source_table_id AND d1.b = k.b AND d1.r = 1 JOIN d2 ON d2.source_table_id = k.source_table_id AND d2.b = k.b AND d2.r = 1"""
)
def target_rows(s, root):
    """One row per bridge value with the dominant value of each dependent column."""
    return P.target_rows(settle(lake.cell(s, root).filter("column_index < 3")), 0, [1, 2])


ASSETS = "al AS (SELECT asset_id, asset_type, source, min(asset_id) OVER (PARTITION BY asset_type, coalesce(content, asset_id)) AS cls, entity_id FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY loaded_at DESC, retrieved_at DESC) AS r FROM bridge_assets WHERE asset_id IS NOT NULL) WHERE r = 1), pe AS (SELECT entity_id, count(*) AS n FROM documents WHERE entity_id IS NOT NULL GROUP BY 1), lb AS (SELECT DISTINCT asset_id FROM al JOIN (SELECT DISTINCT entity_id FROM documents WHERE lang = 'fr') USING (entity_id))"


@query(
    f"""WITH {ASSETS}, fr AS (SELECT * FROM al WHERE cls NOT IN (SELECT cls FROM al JOIN lb USING (asset_id))), us AS (SELECT cls FROM al JOIN pe USING (entity_id) GROUP BY 1 HAVING sum(n) >= 20), hb AS (SELECT * FROM fr WHERE cls IN (SELECT cls FROM us)), bk AS (SELECT DISTINCT source FROM al JOIN lb USING (asset_id) WHERE source IS NOT NULL)
 SELECT asset_id, 'hub' AS rule FROM hb UNION ALL SELECT asset_id, 'text_hub' FROM hb WHERE asset_type = 'text' UNION ALL SELECT asset_id, 'unlabelled_text' FROM fr WHERE asset_type = 'text'
 UNION ALL SELECT asset_id, 'unsupported_source' FROM fr WHERE source IS NULL OR source NOT IN (SELECT source FROM bk) UNION ALL SELECT asset_id, 'listed_source' FROM fr WHERE source IN ('shop_page', 'seller_description')"""
)
def removable_assets(s, root):
    """Assets of entities without French documents by the rule that would drop them."""
    from lakeweave.operators.cells import latest

    a = latest(table(s, root, "bridge_assets").filter("asset_id is not null"), "asset_id", "loaded_at", "retrieved_at")
    groups = a.groupBy("asset_type", F.coalesce("content", "asset_id").alias("c")).agg(F.min("asset_id").alias("cls"))
    a = settle(a.withColumn("c", F.coalesce("content", "asset_id")).join(groups, ["asset_type", "c"]).select("asset_id", "asset_type", "source", "cls", "entity_id"))
    docs = table(s, root, "documents").filter("entity_id is not null")
    used = a.join(docs.groupBy("entity_id").agg(F.count("*").alias("n")), "entity_id").select("asset_id", "n")
    labelled = a.join(docs.filter("lang = 'fr'").select("entity_id").distinct(), "entity_id", "left_semi").select("asset_id")
    return V.removable_assets(a.drop("entity_id"), labelled, used, 20, ["shop_page", "seller_description"])


@query(f"WITH RECURSIVE {records.PAGES} SELECT size, count(*) AS n FROM (SELECT c, sum(k) AS size FROM (SELECT c, count(*) AS k FROM pc GROUP BY 1 UNION ALL SELECT c, count(*) FROM (SELECT a, min(c) AS c FROM n JOIN pc ON p = b GROUP BY 1) GROUP BY 1) GROUP BY 1) GROUP BY 1")
def page_component_sizes(s, root):
    """Sizes of the components of tables and pages."""
    c = records.page_components(s, root)
    return c.groupBy("component").agg(F.count("*").alias("size")).groupBy("size").agg(F.count("*").alias("n"))


@query(f"WITH {search.Z}, h AS (SELECT query_id, target_id, score FROM near WHERE rank <= 10) SELECT a.target_id AS target_a, b.target_id AS target_b, count(*) AS n FROM h a JOIN h b ON a.query_id = b.query_id AND a.target_id < b.target_id GROUP BY 1, 2 HAVING count(*) >= 5")
def targets_met_together(s, root):
    """Pairs of targets that stand among the first ten of the same five queries or more."""
    h = settle(search.nearest(s, root).filter("rank <= 10").select("query_id", "target_id"))
    met = h.withColumnRenamed("target_id", "target_a").join(h.withColumnRenamed("target_id", "target_b"), "query_id").filter("target_a < target_b")
    return met.groupBy("target_a", "target_b").agg(F.count("*").alias("n")).filter("n >= 5")


@query(f"WITH {K.CELLS}, {SC}, {search.QV}, {search.DOM}, qa AS (SELECT DISTINCT table_id AS query_id, {K.norm('column_name')} AS attribute, {K.key('n')} AS v_key FROM (SELECT *, {K.norm('text')} AS n FROM qc)), mt AS (SELECT DISTINCT sc.query_id, sc.target_id FROM sc JOIN qa USING (query_id) JOIN dm ON dm.source_table_id = sc.target_id AND dm.attribute = qa.attribute AND dm.v_key = qa.v_key), pr AS (SELECT DISTINCT query_id, target_id, CASE WHEN positive THEN 'relevant' WHEN rank <= 10 THEN 'first_10' ELSE 'other' END AS kind FROM sc) SELECT kind, count(*) AS pairs, count(mt.query_id) AS overlapping, round(count(mt.query_id) / count(*), 6) AS share FROM pr LEFT JOIN mt USING (query_id, target_id) GROUP BY 1")
def retrieval_overlap(s, root):
    """How often a view shares a value, in a column of one name, with relevant, first and other targets."""
    n = lists(s, root)
    pairs = n.select("query_id", "target_id", F.when(F.col("positive"), "relevant").when(F.col("rank") <= 10, "first_10").otherwise("other").alias("kind"))
    q = table(s, root, "query_tables").filter("table_id is not null and rows is not null").select(F.col("table_id").alias("query_id"), "rows").distinct()
    cell = q.select("query_id", F.explode("rows").alias("r")).select("query_id", F.explode("r.cells").alias("c")).select("query_id", norm("c.column_name").alias("attribute"), F.coalesce("c.text", F.lit("")).alias("text"))
    own = with_value(cell, "text").filter("v_key is not null").select("query_id", "attribute", "v_key")
    dom = search.domain(s, root).filter("v_key is not null").select(F.col("source_table_id").alias("target_id"), "attribute", "v_key")
    return V.value_overlap(pairs, own, dom)


@query("SELECT DISTINCT table_id, array_to_string([array_to_string([coalesce(c.text, '') FOR c IN r.cells], ' | ') FOR r IN rows], chr(10)) AS shown FROM query_tables WHERE table_id IS NOT NULL AND rows IS NOT NULL")
def reader_views(s, root):
    """What a reader sees of a view: the texts of its rows."""
    q = table(s, root, "query_tables").filter("table_id is not null and rows is not null")
    return q.select("table_id", F.array_join(F.transform(C.reader_view(F.col("rows")), lambda r: F.array_join(r, " | ")), "\n").alias("shown")).distinct()


@query("SELECT DISTINCT table_id, array_to_string([column_names[k.i + 1] FOR k IN list_sort([{'d': sha256('permute|7|' || table_id || '|' || i), 'i': i} FOR i IN range(len(column_names))])], ' | ') AS columns FROM query_tables WHERE table_id IS NOT NULL AND column_names IS NOT NULL")
def permuted_columns(s, root):
    """Column names of views in an order of their own."""
    q = table(s, root, "query_tables").filter("table_id is not null and column_names is not null").select("table_id", "column_names").distinct()
    names = F.transform(C.permuted(F.col("table_id"), F.col("column_names"), 7), lambda i: F.get("column_names", i))
    return q.select("table_id", F.array_join(names, " | ").alias("columns")).distinct()


@query(f"WITH {WIT}, h AS (SELECT DISTINCT unnest(column_names) AS attribute FROM query_tables WHERE table_id IS NOT NULL AND column_names IS NOT NULL) SELECT DISTINCT evidence_id AS attribute, evidence_id IN (SELECT attribute FROM h WHERE attribute IS NOT NULL) AS shown FROM wt")
def join_columns(s, root):
    """Column names that any relevant pair joins on, and whether some view shows a column of that name."""
    shown = table(s, root, "query_tables").filter("table_id is not null").select(F.explode("column_names").alias("attribute")).filter("attribute is not null").distinct().withColumn("shown", F.lit(True))
    used = _witnesses(s, root).select(F.col("evidence_id").alias("attribute")).distinct()
    return used.join(shown, "attribute", "left").select("attribute", F.coalesce("shown", F.lit(False)).alias("shown"))


@query("SELECT regexp_extract(lower(page_url), '^([a-z][a-z0-9+.\\-]*://[^/?#]*)', 1) || rtrim(regexp_extract(page_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://[^/?#]*([^?#]*)', 1), '/') AS url, min(asset_id) AS asset_id, count(DISTINCT asset_id) AS n FROM bridge_assets WHERE page_url IS NOT NULL AND asset_id IS NOT NULL AND regexp_matches(page_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://') GROUP BY 1")
def unique_pages(s, root):
    """One job per page address, whatever its query string, with the first asset that wants it."""
    a = table(s, root, "bridge_assets").filter("page_url is not null and asset_id is not null").select(bare_url("page_url").alias("url"), "asset_id").filter("url is not null")
    return a.groupBy("url").agg(F.min("asset_id").alias("asset_id"), F.countDistinct("asset_id").alias("n"))

"""Queries of table search: retrieval, matching, reranking, evaluation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.operators import cells as C
from lakeweave.operators import matching as M
from lakeweave.operators import metrics as E
from lakeweave.operators import ranking as R
from lakeweave.operators import retrieval as N
from lakeweave.plans import sqlkit as K
from lakeweave.runtime import settle, table

QUERIES, SQL = {}, {}
DEPTH, SCOPE = 50, 30


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def objects(s: SparkSession, root: str, kind: str | None = None) -> DataFrame:
    """(id, z): the first usable vector of every encoded object."""
    bad = F.exists("z", lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    z = table(s, root, "z_store").select("vec_id", "object_id", "object_type", "z").filter("object_id is not null and z is not null and size(z) = 64")
    z = z.filter(~bad & F.exists("z", lambda x: x != 0))
    if kind:
        z = z.filter(F.col("object_type") == kind)
    return z.groupBy(F.col("object_id").alias("id")).agg(F.min(F.struct("vec_id", "z")).getField("z").alias("z"))


def views(s: SparkSession, root: str) -> DataFrame:
    return table(s, root, "query_tables").select("table_id", "source_table_id").filter("table_id is not null and source_table_id is not null").distinct()


def nearest(s: SparkSession, root: str, depth: int = DEPTH) -> DataFrame:
    """Sources of queries against all tables: exact cosine, blocks of targets."""
    t = settle(objects(s, root, "table"))
    asked = t.join(views(s, root).select(F.col("source_table_id").alias("id")).distinct(), "id", "left_semi")
    return N.knn_join(asked, t, depth)


def scope(s: SparkSession, root: str, depth: int = SCOPE) -> DataFrame:
    near = nearest(s, root, depth)
    return views(s, root).join(near.select(F.col("query_id").alias("source_table_id"), F.col("target_id").alias("target"), F.col("rank").alias("stage1")), "source_table_id").select("table_id", "target", "stage1")


def query_values(s: SparkSession, root: str) -> DataFrame:
    return M.visible_query_values(M.query_cells(table(s, root, "query_tables")))


def lake_cells(s: SparkSession, root: str) -> DataFrame:
    return C.cells(C.lake(table(s, root, "source_tables"))).select("source_table_id", "row_id", "column_index", "column_name", "text")


def domain(s: SparkSession, root: str) -> DataFrame:
    return M.domains(lake_cells(s, root))


def claims(s: SparkSession, root: str, cells: DataFrame | None = None) -> DataFrame:
    """Hidden attributes read back from the source row: (table_id, attribute, row, value)."""
    q = table(s, root, "query_tables").select("table_id", "source_table_id", "rows", "hidden_attributes").filter("table_id is not null and rows is not null").distinct()
    row = q.select("table_id", "source_table_id", F.explode("hidden_attributes").alias("attribute"), "rows").select("table_id", "source_table_id", "attribute", F.posexplode("rows").alias("row", "r"))
    read = lake_cells(s, root) if cells is None else cells
    cell = read.select("source_table_id", F.col("row_id").alias("source_row_id"), F.col("column_name").alias("attribute"), F.col("text").alias("value"))
    return row.select("table_id", "source_table_id", "attribute", "row", F.col("r.source_row_id").alias("source_row_id")).join(cell, ["source_table_id", "source_row_id", "attribute"]).select("table_id", "attribute", "row", "value")


def reranked(s: SparkSession, root: str) -> DataFrame:
    sc = settle(scope(s, root))
    cells = settle(lake_cells(s, root))
    dom = settle(M.domains(cells))
    vis = M.visible_scores(sc, query_values(s, root), dom)
    both = M.bridge_scores(vis, M.bridges(claims(s, root, cells)), dom)
    tiers = R.tier_order(both, "table_id", "target", "bridge", "vis_idf", "vis_row", "stage1")
    return R.rrf(tiers, "table_id", "target", "stage1", "tier_rank")


def gold(s: SparkSession, root: str) -> DataFrame:
    return table(s, root, "query_tables").select(F.col("table_id").alias("query_id"), F.explode("target_table_ids").alias("target_id")).filter("query_id is not null and target_id is not null").distinct()


Z = """okz AS (SELECT object_id AS id, object_type, vec_id, z::DOUBLE[] AS z FROM z_store WHERE object_id IS NOT NULL AND z IS NOT NULL AND len(z) = 64
   AND len([x FOR x IN z IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN z IF x <> 0]) > 0),
 tz AS (SELECT id, z FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY vec_id) AS r FROM okz WHERE object_type = 'table') WHERE r = 1),
 vw AS (SELECT DISTINCT table_id, source_table_id FROM query_tables WHERE table_id IS NOT NULL AND source_table_id IS NOT NULL),
 near AS (SELECT query_id, target_id, score, rank FROM (SELECT q.id AS query_id, t.id AS target_id, list_cosine_similarity(q.z, t.z) AS score,
   row_number() OVER (PARTITION BY q.id ORDER BY round(list_cosine_similarity(q.z, t.z), 12) DESC, t.id) AS rank
   FROM tz q, tz t WHERE q.id IN (SELECT source_table_id FROM vw)) WHERE rank <= 50),
 scope AS (SELECT table_id, target_id AS target, rank AS stage1 FROM vw JOIN near ON query_id = source_table_id WHERE rank <= 30)"""

QV = f"""qc AS (SELECT table_id, row, c.column_index AS column_index, c.column_name AS column_name, coalesce(c.text, '') AS text FROM (
   SELECT table_id, row, unnest(rows[row + 1].cells) AS c FROM (SELECT table_id, rows, unnest(range(len(rows))) AS row FROM (SELECT DISTINCT table_id, rows FROM query_tables WHERE table_id IS NOT NULL AND rows IS NOT NULL)))),
 qk AS (SELECT table_id, row, column_index, {K.key('n')} AS v_key, {K.kind('n')} AS v_kind, n FROM (SELECT *, {K.norm('text')} AS n FROM qc WHERE {K.norm('column_name')} <> 'entity_url')),
 qv AS (SELECT * FROM qk WHERE v_key IS NOT NULL AND v_kind <> 'URL' AND (table_id, column_index) IN (SELECT (table_id, column_index) FROM qk WHERE v_key IS NOT NULL AND v_kind <> 'URL' GROUP BY table_id, column_index HAVING count(DISTINCT v_key) >= 2))"""

DOM = f"""dom AS (SELECT DISTINCT source_table_id, column_index, {K.norm('column_name')} AS attribute, {K.key('n')} AS v_key, {K.kind('n')} AS v_kind, n FROM (SELECT *, {K.norm('text')} AS n FROM cells)),
 dm AS (SELECT * FROM dom WHERE v_key IS NOT NULL)"""

HITS = """hits AS (SELECT DISTINCT s.table_id, s.target, q.column_index AS q_col, q.row, d.column_index AS t_col FROM scope s JOIN qv q USING (table_id)
   JOIN dm d ON d.source_table_id = s.target AND d.v_key = q.v_key AND d.v_kind NOT IN ('URL', 'EMPTY') AND d.attribute <> 'entity_url'),
 df AS (SELECT table_id, q_col, row, count(DISTINCT target) AS df FROM hits GROUP BY ALL), ks AS (SELECT table_id, count(*) AS k FROM scope GROUP BY 1),
 wt AS (SELECT table_id, q_col, row, ln((k + 1) / (df + 1)) / ln(k + 1) AS w FROM df JOIN ks USING (table_id)),
 pr AS (SELECT table_id, target, q_col, t_col, count(*) / 5 AS r, sum(w) / 5 AS i FROM hits JOIN wt USING (table_id, q_col, row) GROUP BY ALL),
 vis AS (SELECT table_id, target, stage1, coalesce(max(r), 0) AS vis_row, coalesce(max(i), 0) AS vis_idf FROM scope LEFT JOIN pr USING (table_id, target) GROUP BY ALL)"""

CLAIMS = f"""cl AS (SELECT q.table_id, q.attribute, q.row, c.text AS value FROM (
   SELECT table_id, source_table_id, attribute, row, rows[row + 1].source_row_id AS source_row_id FROM (SELECT *, unnest(range(len(rows))) AS row FROM (
     SELECT table_id, source_table_id, rows, unnest(hidden_attributes) AS attribute FROM (SELECT DISTINCT table_id, source_table_id, rows, hidden_attributes FROM query_tables WHERE table_id IS NOT NULL AND rows IS NOT NULL)))) q
   JOIN cells c ON c.source_table_id = q.source_table_id AND c.row_id = q.source_row_id AND c.column_name = q.attribute),
 ck AS (SELECT table_id, {K.norm('attribute')} AS attribute, row, {K.key('n')} AS v_key FROM (SELECT *, {K.norm('value')} AS n FROM cl)),
 sl AS (SELECT table_id, attribute, row, count(DISTINCT v_key) AS k, min(v_key) AS v_key FROM ck GROUP BY ALL),
 br AS (SELECT e.table_id, e.attribute, e.row::INT AS row, CASE WHEN coalesce(k, 0) = 0 THEN 'MISSING' WHEN k = 1 THEN 'VALUE' ELSE 'CONFLICT' END AS status, CASE WHEN k = 1 THEN v_key END AS v_key
   FROM (SELECT table_id, attribute, unnest(range(5)) AS row FROM (SELECT DISTINCT table_id, attribute FROM ck)) e LEFT JOIN sl USING (table_id, attribute, row)),
 bm AS (SELECT s.table_id, s.target, b.attribute, d.column_index, count(DISTINCT b.row) / 5 AS m FROM scope s JOIN br b ON b.table_id = s.table_id AND b.status = 'VALUE' JOIN dm d ON d.source_table_id = s.target AND d.attribute = b.attribute AND d.v_key = b.v_key GROUP BY ALL),
 sc AS (SELECT vis.*, coalesce((SELECT max(m) FROM bm WHERE bm.table_id = vis.table_id AND bm.target = vis.target), 0) AS bridge FROM vis),
 ti AS (SELECT *, CASE WHEN bridge > 0 THEN 1 WHEN vis_idf > 0 THEN 2 ELSE 3 END AS tier FROM sc),
 tr AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY tier, CASE tier WHEN 1 THEN -round(bridge, 8) WHEN 2 THEN -round(vis_idf, 12) END, CASE tier WHEN 2 THEN -round(vis_row, 8) END, stage1, target) AS tier_rank FROM ti),
 fu AS (SELECT *, round(1 / (60 + stage1) + 1 / (60 + tier_rank), 12) AS score FROM tr),
 rr AS (SELECT *, row_number() OVER (PARTITION BY table_id ORDER BY score DESC, stage1, target) AS fused_rank FROM fu)"""

FULL = f"{K.CELLS}, {Z}, {QV}, {DOM}, {HITS}, {CLAIMS}"


@query(f"WITH {Z} SELECT query_id, target_id, round(score, 6) AS score, rank FROM near")
def knn_targets(s, root):
    return nearest(s, root).select("query_id", "target_id", F.round("score", 6).alias("score"), "rank")


@query()
def ann_targets(s, root):
    """The same search through inverted lists; its recall against ``knn_targets`` is tested."""
    t = settle(objects(s, root, "table"))
    asked = t.join(views(s, root).select(F.col("source_table_id").alias("id")).distinct(), "id", "left_semi")
    return N.list_join(asked, t, 10).select("query_id", "target_id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH {QV} SELECT table_id, column_index, count(DISTINCT v_key) AS n_keys, count(*) AS n_cells FROM qv GROUP BY ALL")
def visible_query_columns(s, root):
    return query_values(s, root).groupBy("table_id", "column_index").agg(F.countDistinct("v_key").alias("n_keys"), F.count("*").alias("n_cells"))


@query(f"WITH {K.CELLS}, {Z}, {QV}, {DOM}, {HITS} SELECT table_id, target, round(vis_row, 6) AS vis_row, round(vis_idf, 6) AS vis_idf FROM vis")
def visible_scores(s, root):
    v = M.visible_scores(settle(scope(s, root)), query_values(s, root), domain(s, root))
    return v.select("table_id", "target", F.round("vis_row", 6).alias("vis_row"), F.round("vis_idf", 6).alias("vis_idf"))


@query(f"WITH {FULL} SELECT table_id, attribute, row, status, v_key FROM br")
def evidence_bridges(s, root):
    return M.bridges(claims(s, root))


@query(f"WITH {FULL} SELECT table_id, target, stage1, round(bridge, 6) AS bridge, tier, tier_rank, fused_rank FROM rr")
def tiered_rerank(s, root):
    return reranked(s, root).select("table_id", "target", "stage1", F.round("bridge", 6).alias("bridge"), "tier", "tier_rank", "fused_rank")


GOLD = "gd AS (SELECT DISTINCT table_id AS query_id, unnest(target_table_ids) AS target_id FROM query_tables WHERE table_id IS NOT NULL), gold AS (SELECT * FROM gd WHERE target_id IS NOT NULL)"


def _metric_sql(source: str) -> str:
    parts = ", ".join(
        f"round(coalesce(h{k}, 0) / n_gold, 6) AS recall_{k}, round(coalesce(h{k}, 0) / {k}, 6) AS precision_{k}, round(coalesce(d{k}, 0) / list_sum([1 / log2(i + 1) FOR i IN range(1, least({k}, n_gold) + 1)]), 6) AS ndcg_{k}" for k in E.CUTOFFS
    )
    aggs = ", ".join(f"count(*) FILTER (rank <= {k}) AS h{k}, sum(CASE WHEN rank <= {k} THEN 1 / log2(rank + 1) ELSE 0 END) AS d{k}" for k in E.CUTOFFS)
    return f"sz AS (SELECT query_id, count(*) AS n_gold FROM gold GROUP BY 1), ht AS (SELECT query_id, {aggs} FROM {source} JOIN gold USING (query_id, target_id) GROUP BY 1), mt AS (SELECT query_id, n_gold, {parts} FROM sz LEFT JOIN ht USING (query_id))"


@query(f"WITH {FULL}, {GOLD}, rk AS (SELECT table_id AS query_id, target AS target_id, fused_rank AS rank FROM rr), {_metric_sql('rk')} SELECT * FROM mt")
def ranking_metrics(s, root):
    return E.rank_metrics(_ranked(s, root), gold(s, root))


def _ranked(s, root):
    return reranked(s, root).select(F.col("table_id").alias("query_id"), F.col("target").alias("target_id"), F.col("fused_rank").alias("rank"))


def _stage1(s, root):
    return scope(s, root).select(F.col("table_id").alias("query_id"), F.col("target").alias("target_id"), F.col("stage1").alias("rank"))


SPLIT = "sp AS (SELECT query_id, min(label) AS split FROM (SELECT table_id AS query_id, coalesce(nullif(regexp_replace(lower(split), '\\s+', '', 'g'), ''), 'none') AS label FROM query_tables) GROUP BY 1)"


@query(
    f"WITH {Z}, {GOLD}, {SPLIT}, rk AS (SELECT table_id AS query_id, target AS target_id, stage1 AS rank FROM scope), {_metric_sql('rk')} SELECT coalesce(split, 'overall') AS segment, count(*) AS queries, round(avg(recall_10), 6) AS recall_10, round(avg(ndcg_10), 6) AS ndcg_10 FROM mt JOIN sp USING (query_id) GROUP BY ROLLUP (split)"
)
def metrics_by_split(s, root):
    label = F.coalesce(F.nullif(F.regexp_replace(F.lower("split"), r"\s+", ""), F.lit("")), F.lit("none"))
    sp = table(s, root, "query_tables").select(F.col("table_id").alias("query_id"), label.alias("split")).groupBy("query_id").agg(F.min("split").alias("split"))
    return E.by_segment(E.rank_metrics(_stage1(s, root), gold(s, root)).join(sp, "query_id"), "split", ["recall_10", "ndcg_10"])


@query(
    f"""WITH {Z}, {GOLD}, q AS (SELECT query_id, target_id, 1 + ascii(right(target_id, 1)) % 3 AS rel FROM gold), rk AS (SELECT table_id AS query_id, target AS target_id, stage1 AS rank FROM scope),
 idl AS (SELECT query_id, sum(CASE WHEN i <= 10 THEN (2 ** rel - 1) / log2(i + 1) END) AS ideal, count(*) FILTER (rel > 0) AS n FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY rel DESC, target_id) AS i FROM q) GROUP BY 1),
 got AS (SELECT query_id, sum(CASE WHEN rank <= 10 THEN (2 ** rel - 1) / log2(rank + 1) ELSE 0 END) AS dcg, count(*) FILTER (rank <= 10) AS h, min(rank) AS first FROM rk JOIN q USING (query_id, target_id) GROUP BY 1)
 SELECT count(*) AS queries, round(avg(coalesce(h, 0) / n), 6) AS recall, round(avg(coalesce(dcg, 0) / ideal), 6) AS ndcg, round(avg(coalesce(1 / first, 0)), 6) AS mrr FROM idl LEFT JOIN got USING (query_id)"""
)
def graded_metrics(s, root):
    qrels = gold(s, root).withColumn("rel", 1 + F.ascii(F.right("target_id", F.lit(1))) % 3)
    return E.graded_metrics(_stage1(s, root), qrels)


@query(f"WITH {Z}, {GOLD} SELECT round((sum(p * ar) - sum(p) * (sum(p) + 1) / 2) / (sum(p) * sum(n - p)), 6) AS auc, sum(p)::BIGINT AS positives, sum(n - p)::BIGINT AS negatives FROM (SELECT n, p, coalesce(sum(n) OVER (ORDER BY s ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) + (n + 1) / 2 AS ar FROM (SELECT round(score, 6) AS s, count(*) AS n, count(*) FILTER (g.target_id IS NOT NULL) AS p FROM vw JOIN near ON query_id = source_table_id LEFT JOIN gold g ON g.query_id = vw.table_id AND g.target_id = near.target_id GROUP BY 1))")
def score_auc(s, root):
    scored = views(s, root).join(nearest(s, root).withColumnRenamed("query_id", "source_table_id"), "source_table_id").select(F.col("table_id").alias("query_id"), "target_id", F.round("score", 6).alias("score"))
    marked = scored.join(gold(s, root).withColumn("g", F.lit(True)), ["query_id", "target_id"], "left").withColumn("positive", F.col("g").isNotNull())
    return E.auc(marked, "score", F.col("positive"))


@query(f"WITH {Z}, h AS (SELECT target_id, count(*) AS n FROM near WHERE rank <= 10 GROUP BY 1) SELECT round_even(2 * sum(i * n) / (count(*) * sum(n)) - (count(*) + 1) / count(*), 6) AS gini, count(*) AS n FROM (SELECT n, row_number() OVER (ORDER BY n) AS i FROM h)")
def hubness_gini(s, root):
    from lakeweave.operators.profiles import gini

    hits = nearest(s, root).filter("rank <= 10").groupBy("target_id").agg(F.count("*").alias("hits"))
    return gini(hits, "hits")


@query(f"WITH {Z} SELECT query_id, target_id, round(score - m - ln(s), 6) AS log_share FROM (SELECT *, max(score) OVER w AS m, sum(exp(score - mm)) OVER w AS s FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS mm FROM near) WINDOW w AS (PARTITION BY query_id))")
def log_softmax_scores(s, root):
    return R.log_softmax(nearest(s, root), ["query_id"], "score", "log_share").select("query_id", "target_id", F.round("log_share", 6).alias("log_share"))


@query(f"WITH {Z} SELECT target_id, round(max(m) + ln(sum(exp(score - m)) / count(*)), 6) AS log_mean FROM (SELECT *, max(score) OVER (PARTITION BY target_id) AS m FROM near) GROUP BY 1")
def log_mean_exp_by_target(s, root):
    return R.log_sum_exp(nearest(s, root), ["target_id"], "score", "log_mean", mean=True).select("target_id", F.round("log_mean", 6).alias("log_mean"))


@query(f"WITH {Z}, tg AS (SELECT *, chr(97 + ascii(right(target_id, 1)) % 4) AS lane FROM near), cp AS (SELECT *, row_number() OVER (PARTITION BY query_id, lane ORDER BY score DESC, target_id) AS inner_rank FROM tg) SELECT query_id, lane, target_id, inner_rank, rank FROM (SELECT query_id, lane, target_id, inner_rank, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, target_id) AS rank FROM cp WHERE inner_rank <= 3) WHERE rank <= 10")
def capped_plan(s, root):
    n = nearest(s, root).drop("rank").withColumn("lane", F.chr(F.lit(97) + F.ascii(F.right("target_id", F.lit(1))) % 4))
    return R.cap_then_cut(n, "query_id", "lane", [F.desc("score"), F.col("target_id")], 3, 10).select("query_id", "lane", "target_id", "inner_rank", "rank")


@query()
def two_hop_retention(s, root):
    """Tables to text and image evidence to tables, evidence kept by greedy coverage of the four
    zero-padded slices of the query's vector."""
    tables, kinds = settle(objects(s, root, "table")), [settle(objects(s, root, k)) for k in ("text", "image")]
    asked = tables.join(views(s, root).select(F.col("source_table_id").alias("id")).distinct(), "id", "left_semi")
    first = settle(N.knn_join(asked, kinds[0], 10).unionByName(N.knn_join(asked, kinds[1], 10)))
    evidence = kinds[0].unionByName(kinds[1])
    second = settle(N.knn_join(evidence.join(first.select(F.col("target_id").alias("id")).distinct(), "id", "left_semi"), tables, 10))
    rows, units = N.slice_rows(asked), evidence.withColumn("z", N.unit(F.col("z")))
    supports = N.row_supports(first.select("query_id", F.col("target_id").alias("evidence_id")), rows, units)
    paths = N.two_hop_paths(first.join(supports.withColumnRenamed("evidence_id", "target_id"), ["query_id", "target_id"]), second)
    kept = N.retain_evidence(paths, rows, units)
    return kept.withColumn("coverage", F.round("coverage", 6))


@query()
def admitted_candidates(s, root):
    """The direct top 100 and every two-hop target compete for 150 places by their exact cosine."""
    kept = settle(two_hop_retention(s, root).groupBy("query_id", "target_id").agg(F.max("coverage").alias("coverage")))
    tables = objects(s, root, "table")
    pairs = N.with_evidence_targets(settle(nearest(s, root, 100)), kept, tables, tables)
    return N.admit(pairs, kept, 150).select("query_id", "target_id", "admitted_rank")


@query(
    f"""WITH {Z}, e AS (SELECT query_id AS src, target_id AS dst, score FROM near WHERE rank <= 5 AND query_id <> target_id),
 h1 AS (SELECT src AS query_id, dst AS node, least(1.0, score) AS score, row_number() OVER (PARTITION BY src ORDER BY least(1.0, score) DESC, dst) AS r FROM e),
 h2 AS (SELECT h1.query_id, e.dst AS node, least(h1.score, e.score) AS score FROM h1 JOIN e ON e.src = h1.node WHERE h1.r <= 8 AND e.dst <> h1.query_id AND e.dst <> h1.node)
 SELECT query_id, node, round(max(score), 6) AS score FROM (SELECT query_id, node, score FROM h1 UNION ALL SELECT * FROM h2) GROUP BY 1, 2"""
)
def beam_paths(s, root):
    near = nearest(s, root, 5).filter("query_id <> target_id")
    return N.beam(near.select("query_id").distinct().withColumn("id", F.col("query_id")), near.select(F.col("query_id").alias("src"), F.col("target_id").alias("dst"), "score"), 8, 2).withColumn("score", F.round("score", 6))


@query()
def bootstrap_gain(s, root):
    a = E.rank_metrics(_ranked(s, root), gold(s, root)).select("query_id", F.col("recall_10").alias("a"))
    b = E.rank_metrics(_stage1(s, root), gold(s, root)).select("query_id", F.col("recall_10").alias("b"))
    d = a.join(b, "query_id").join(views(s, root).withColumnRenamed("table_id", "query_id"), "query_id").select("source_table_id", (F.col("a") - F.col("b")).alias("delta"))
    return E.group_bootstrap(d, "source_table_id", "delta", 2000)


@query(f"WITH {Z}, {GOLD} SELECT n.query_id, n.target_id, n.rank FROM (SELECT vw.table_id AS query_id, near.target_id, near.rank FROM vw JOIN near ON near.query_id = vw.source_table_id WHERE near.target_id <> vw.source_table_id) n LEFT JOIN gold USING (query_id, target_id) WHERE gold.query_id IS NULL AND n.rank <= 20")
def hard_negatives(s, root):
    near = views(s, root).join(nearest(s, root).withColumnRenamed("query_id", "source_table_id"), "source_table_id").filter("target_id <> source_table_id and rank <= 20")
    return near.select(F.col("table_id").alias("query_id"), "target_id", "rank").join(gold(s, root), ["query_id", "target_id"], "left_anti")

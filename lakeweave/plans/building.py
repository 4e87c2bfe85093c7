"""Queries that build query, target and training records."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.operators import cells as C
from lakeweave.operators import joinability as J
from lakeweave.operators import linear
from lakeweave.operators import profiles as P
from lakeweave.operators import retrieval as N
from lakeweave.plans import search
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


def parts(s, root):
    c = C.cells(C.lake(table(s, root, "source_tables")))
    p = C.column_profiles(c)
    return c, p, C.entity_column(p, c)


def extractions(s, root):
    """Hidden attributes of query views as extractor output: the value of the source row."""
    q = table(s, root, "query_tables").select("source_table_id", "rows", "hidden_attributes").filter("source_table_id is not null and rows is not null").distinct()
    row = q.select("source_table_id", F.explode("hidden_attributes").alias("attribute_name"), "rows").select("source_table_id", "attribute_name", F.explode("rows").alias("r")).select("source_table_id", "attribute_name", F.col("r.source_row_id").alias("source_row_id")).distinct()
    cell = C.cells(C.lake(table(s, root, "source_tables"))).select("source_table_id", F.col("row_id").alias("source_row_id"), F.col("column_name").alias("attribute_name"), F.col("text").alias("value"))
    return row.join(cell, ["source_table_id", "source_row_id", "attribute_name"])


@query(
    f"""WITH {K.ENTITY}, ex AS (SELECT DISTINCT source_table_id, a AS attribute, r.source_row_id AS row_id FROM (SELECT source_table_id, a, unnest(rows) AS r FROM (SELECT source_table_id, rows, unnest(hidden_attributes) AS a FROM query_tables WHERE source_table_id IS NOT NULL AND rows IS NOT NULL))),
 lr AS (SELECT DISTINCT c.source_table_id, c.row_id FROM cells c JOIN entity e ON e.source_table_id = c.source_table_id AND e.entity_column = c.column_index WHERE coalesce(c.wiki_title, '') <> ''),
 src AS (SELECT DISTINCT ex.source_table_id, ex.row_id, {K.normalize('ex.attribute')} AS k, {K.normalize('v.text')} AS val FROM ex JOIN cells v ON v.source_table_id = ex.source_table_id AND v.row_id = ex.row_id AND v.column_name = ex.attribute),
 rec AS (SELECT DISTINCT c.source_table_id, c.column_index, c.row_id FROM cells c JOIN lr USING (source_table_id, row_id) JOIN src ON src.source_table_id = c.source_table_id AND src.row_id = c.row_id AND src.k = {K.normalize('c.column_name')} JOIN entity e ON e.source_table_id = c.source_table_id
   WHERE c.text <> '' AND c.column_index <> e.entity_column AND val <> '' AND (val = {K.normalize('c.text')} OR (least(length(val), length({K.normalize('c.text')})) >= 4 AND (contains(val, {K.normalize('c.text')}) OR contains({K.normalize('c.text')}, val))))),
 n AS (SELECT source_table_id, column_index, count(*) AS recovered FROM rec GROUP BY ALL),
 q AS (SELECT n.source_table_id, n.column_index, e.linked_rows AS valid, recovered, greatest(2, ceil(0.6 * least(e.linked_rows, 5)))::INT AS required, round_even(recovered / e.linked_rows, 6) AS ratio FROM n JOIN entity e USING (source_table_id) JOIN profiles p ON p.source_table_id = n.source_table_id AND p.column_index = n.column_index WHERE p.non_empty_ratio >= 0.5)
 SELECT *, row_number() OVER (PARTITION BY source_table_id ORDER BY ratio DESC, recovered DESC, column_index) AS rank FROM q WHERE valid >= 5 AND recovered >= required"""
)
def qualified_columns(s, root):
    c, p, e = parts(s, root)
    return J.qualified_columns(c, p, e, extractions(s, root))


def layout(s, root):
    c, p, e = parts(s, root)
    q = J.qualified_columns(c, p, e, extractions(s, root)).select("source_table_id", "column_index", "ratio")
    groups = P.redundant_columns(c).select("source_table_id", "members", F.explode(F.split("members", ",")).alias("m")).select("source_table_id", "members", F.col("m").cast("int").alias("column_index"))
    cols = p.join(q, ["source_table_id", "column_index"], "left").join(groups, ["source_table_id", "column_index"], "left").join(e.select("source_table_id", "entity_column"), "source_table_id")
    cols = cols.select("source_table_id", "column_index", (F.col("column_index") == F.col("entity_column")).alias("is_entity"), "ratio", F.coalesce("members", F.col("column_index").cast("string")).alias("members"), "non_empty_ratio", "unique_ratio")
    return J.context_layout(cols)


@query()
def context_layout(s, root):
    return layout(s, root)


@query()
def join_records(s, root):
    return J.query_ids(layout(s, root))


@query()
def joinability_dataset(s, root):
    """All parts of the built dataset in one frame: queries of the first five rows, targets, relevance."""
    cells = settle(C.cells(C.lake(table(s, root, "source_tables"))))
    roles = settle(layout(s, root))
    made = J.build_dataset(cells, roles, cells.filter("row_id < 5").select("source_table_id", "row_id").distinct())
    line = lambda df, part, key: df.select(F.lit(part).alias("part"), F.col(key).alias("id"), "row_id", "column_index", "column_name", "text")
    rel = made["qrels"].select(F.lit("qrel").alias("part"), F.col("query_id").alias("id"), F.lit(None).cast("int").alias("row_id"), F.lit(None).cast("int").alias("column_index"), F.col("attribute").alias("column_name"), F.col("target_id").alias("text"))
    return line(made["queries"], "query", "query_id").unionByName(line(made["targets"], "target", "target_id")).unionByName(rel)


@query(
    f"""WITH {K.PAIRS}, hid AS (SELECT source_table_id, 1 AS hidden FROM (SELECT DISTINCT source_table_id FROM cells WHERE column_index = 1))
 SELECT p.source_table_id, 1 AS hidden, y_col AS column_index, round_even(avg((x = y OR (least(length(x), length(y)) >= 4 AND (contains(y, x) OR contains(x, y))))::INT), 6) AS share, count(*) AS n
 FROM pairs p JOIN hid USING (source_table_id) WHERE x_col = 1 GROUP BY ALL HAVING round_even(avg((x = y OR (least(length(x), length(y)) >= 4 AND (contains(y, x) OR contains(x, y))))::INT), 6) >= 0.05"""
)
def leaking_context(s, root):
    c = C.cells(C.lake(table(s, root, "source_tables")))
    hidden = c.filter("column_index = 1").select("source_table_id", "column_index").distinct()
    return J.leaking_context(c, hidden, 0.05)


@query(f"WITH {K.CELLS}, m AS (SELECT source_table_id, column_index, coalesce(max(n) FILTER (k <> '') / sum(n) FILTER (k <> ''), 1.0) AS share FROM (SELECT source_table_id, column_index, {K.normalize('text')} AS k, count(*) AS n FROM cells GROUP BY ALL) GROUP BY ALL) SELECT source_table_id, column_index FROM (SELECT DISTINCT source_table_id, column_index FROM cells) JOIN m USING (source_table_id, column_index) WHERE round_even(share, 6) >= 0.3")
def degenerate_join_columns(s, root):
    c = C.cells(C.lake(table(s, root, "source_tables")))
    return J.degenerate_pairs(c.select("source_table_id", "column_index").distinct(), P.modal_share(c), 0.3)


@query(f"WITH {search.Z}, {search.GOLD}, a AS (SELECT table_id AS query_id, target AS target_id, 'direct' AS origin FROM scope UNION ALL SELECT query_id, target_id, 'gold' FROM gold) SELECT query_id, target_id, string_agg(origin, '+' ORDER BY origin) AS origin FROM (SELECT DISTINCT * FROM a) GROUP BY ALL")
def candidate_lists(s, root):
    direct = search.scope(s, root).select(F.col("table_id").alias("query_id"), F.col("target").alias("target_id"))
    return J.candidate_lists({"direct": direct, "gold": search.gold(s, root)})


@query(
    f"""WITH {K.LAKE}, q AS (SELECT DISTINCT table_id AS query_id, len(column_names) AS cols, len(rows) AS rows FROM query_tables WHERE table_id IS NOT NULL AND rows IS NOT NULL), t AS (SELECT source_table_id AS target_id, w AS cols, len(data) AS rows FROM wide WHERE data IS NOT NULL), {search.GOLD}
 SELECT query_id, target_id FROM (SELECT q.query_id, t.target_id, row_number() OVER (PARTITION BY q.query_id, q.cols, q.rows ORDER BY abs(t.cols - q.cols), abs(t.rows - q.rows), t.cols, t.rows, t.target_id) AS r FROM q JOIN t ON true WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = q.query_id AND g.target_id = t.target_id)) WHERE r = 1"""
)
def structure_negatives(s, root):
    q = table(s, root, "query_tables").filter("table_id is not null and rows is not null").select(F.col("table_id").alias("query_id"), F.size("column_names").alias("cols"), F.size("rows").alias("rows")).distinct()
    t = C.lake(table(s, root, "source_tables")).filter("data is not null").select(F.col("source_table_id").alias("target_id"), C.width().alias("cols"), F.size("data").alias("rows"))
    return J.nearest_shape(q, t, search.gold(s, root))


@query("WITH a AS (SELECT DISTINCT asset_id FROM bridge_assets WHERE asset_id IS NOT NULL) SELECT asset_id, coalesce(lead(asset_id) OVER (ORDER BY asset_id), (SELECT min(asset_id) FROM a)) AS partner FROM a")
def evidence_swap_ring(s, root):
    return J.swap_ring(table(s, root, "bridge_assets").filter("asset_id is not null"), "asset_id")


@query()
def uniform_targets(s, root):
    q = search.views(s, root).select(F.col("table_id").alias("query_id")).distinct()
    t = search.objects(s, root, "table").select(F.col("id").alias("target_id"))
    return J.uniform_targets(q, t, search.gold(s, root), 32)


@query()
def pca_projection(s, root):
    e = table(s, root, "embeddings").select("vec_id", "embedding")
    mean, axes, _ = linear.fit_pca(e, "embedding", 64, 4)
    return linear.project(e, "vec_id", "embedding", mean, axes).select("vec_id", F.transform("projected", lambda x: F.round(x, 5)).alias("projected"))


def _bags(df, key, text):
    words = df.select(F.col(key).alias("id"), F.explode(F.regexp_extract_all(F.lower(text), F.lit(r"[a-z0-9_]+"), F.lit(0))).alias("token"))
    return words.groupBy("id", "token").agg(F.count("*").alias("tf"))


TOK = "regexp_extract_all(lower(txt), '[a-z0-9_]+')"


@query(
    f"""WITH {K.LAKE}, {search.GOLD}, tt AS (SELECT source_table_id AS id, coalesce(pgtitle, '') || ' ' || coalesce(array_to_string(title, ' '), '') AS txt FROM lake),
 qt AS (SELECT table_id AS id, min(array_to_string(column_names, ' ')) AS txt FROM query_tables WHERE table_id IS NOT NULL AND column_names IS NOT NULL GROUP BY 1),
 tb AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({TOK}) AS token FROM tt) GROUP BY ALL), qb AS (SELECT id, token, count(*) AS tf FROM (SELECT id, unnest({TOK}) AS token FROM qt) GROUP BY ALL),
 n AS (SELECT count(DISTINCT id) AS n FROM tt), df AS (SELECT token, ln((n + 1) / (count(*) + 1)) + 1 AS idf FROM tb, n GROUP BY token, n),
 tw AS (SELECT id, token, tf * idf AS w FROM tb JOIN df USING (token)), qw AS (SELECT id, token, tf * idf AS w FROM qb JOIN df USING (token)),
 tn AS (SELECT id, sqrt(sum(w * w)) AS l FROM tw GROUP BY 1), qn AS (SELECT id, sqrt(sum(w * w)) AS l FROM qw GROUP BY 1),
 sc AS (SELECT qw.id AS query_id, tw.id AS target_id, sum(qw.w / qn.l * (tw.w / tn.l)) AS score FROM qw JOIN qn USING (id) JOIN tw ON tw.token = qw.token JOIN tn ON tn.id = tw.id GROUP BY ALL)
 SELECT query_id, target_id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, target_id) AS r FROM sc WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = sc.query_id AND g.target_id = sc.target_id)) WHERE r = 1"""
)
def semantic_negatives(s, root):
    """The most similar table by header and page words that is not relevant to the query."""
    t = C.lake(table(s, root, "source_tables")).select("source_table_id", F.concat_ws(" ", F.coalesce("pgtitle", F.lit("")), F.array_join(F.coalesce("title", F.array().cast("array<string>")), " ")).alias("txt"))
    q = table(s, root, "query_tables").filter("table_id is not null and column_names is not null").groupBy("table_id").agg(F.min(F.array_join("column_names", " ")).alias("txt"))
    bags = settle(_bags(t, "source_table_id", "txt"))
    n = t.count()
    idf = settle(bags.groupBy("token").agg((F.log(F.lit(n + 1) / (F.count("*") + 1)) + 1).alias("idf")))

    def unit(b):
        w = b.join(idf, "token").select("id", "token", (F.col("tf") * F.col("idf")).alias("w"))
        length = w.groupBy("id").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("l"))
        return w.join(length, "id").select("id", "token", (F.col("w") / F.col("l")).alias("weight"))

    gold = settle(search.gold(s, root))
    most = (gold.groupBy("query_id").count().agg(F.max("count")).first()[0] or 0) + 1
    near = N.sparse_knn_join(unit(_bags(q, "table_id", "txt")), unit(bags), most, n_targets=n)
    free = near.drop("rank").join(gold, ["query_id", "target_id"], "left_anti")
    from lakeweave.operators.ranking import top_k

    return top_k(free, ["query_id"], [F.round("score", 12).desc(), F.col("target_id")], 1).select("query_id", "target_id", F.round("score", 6).alias("score"))

"""Queries over lake tables in the long cell model."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lakeweave.functions.values import with_value
from lakeweave.operators import cells as C
from lakeweave.operators import profiles as P
from lakeweave.plans import sqlkit as K
from lakeweave.runtime import table

QUERIES, SQL = {}, {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lake(s: SparkSession, root: str) -> DataFrame:
    return C.lake(table(s, root, "source_tables"))


def cell(s: SparkSession, root: str) -> DataFrame:
    return C.cells(lake(s, root))


def profile(s: SparkSession, root: str) -> DataFrame:
    return C.column_profiles(cell(s, root))


@query(K.with_(K.LAKE, """SELECT coalesce(reason, 'used') AS reason, count(*) AS n FROM (
  SELECT CASE WHEN data IS NULL THEN 'missing_data' WHEN len(data) < 8 THEN 'too_few_rows' WHEN w < 4 THEN 'too_few_columns' END AS reason FROM wide) GROUP BY 1"""))
def scan_skip_reasons(s, root):
    return lake(s, root).select(F.coalesce(C.skip_reason(8, 4), F.lit("used")).alias("reason")).groupBy("reason").agg(F.count("*").alias("n"))


@query(K.with_(K.HEADERS, "SELECT source_table_id, column_index, column_name FROM headers"))
def repaired_headers(s, root):
    return C.table_headers(lake(s, root))


@query(K.with_(K.CELLS, "SELECT source_table_id, row_id, column_index, column_name, text, coalesce(wiki_title, '') AS wiki_title, has_wiki_link FROM cells"))
def wiki_cells(s, root):
    return cell(s, root).select("source_table_id", "row_id", "column_index", "column_name", "text", F.coalesce("wiki_title", F.lit("")).alias("wiki_title"), "has_wiki_link")


@query(K.with_(K.PROFILES, "SELECT * FROM profiles"))
def profile_columns(s, root):
    return profile(s, root)


@query(K.with_(K.ENTITY, "SELECT * FROM entity"))
def entity_columns(s, root):
    c = cell(s, root)
    return C.entity_column(C.column_profiles(c), c)


@query(K.with_(K.CELLS, """SELECT wiki_title, string_agg(text, ' | ' ORDER BY text) AS display_texts, sum(n)::BIGINT AS n_cells FROM (
  SELECT wiki_title, text, count(*) AS n FROM cells WHERE coalesce(wiki_title, '') <> '' GROUP BY ALL) GROUP BY 1"""))
def entity_records(s, root):
    return C.entities(cell(s, root))


@query(K.with_(K.CELLS, f"""SELECT wiki_title, term, n, rank FROM (SELECT *, row_number() OVER (PARTITION BY wiki_title ORDER BY n DESC, term) AS rank FROM (
  SELECT p.wiki_title, b.text AS term, count(*) AS n FROM cells p JOIN cells b USING (source_table_id, row_id)
  WHERE coalesce(p.wiki_title, '') <> '' AND p.column_index <> b.column_index AND b.text <> '' AND NOT {K.number('b.text')} GROUP BY ALL)) WHERE rank <= 80"""))
def entity_context_terms(s, root):
    return C.context_terms(cell(s, root))


@query(K.with_(K.PAIRS, """SELECT source_table_id, x_col, y_col, round_even(sum(top) / sum(n), 6) AS purity, sum(n)::BIGINT AS support FROM (
  SELECT source_table_id, x_col, y_col, x, max(n) AS top, sum(n) AS n FROM (SELECT source_table_id, x_col, y_col, x, y, count(*) AS n FROM pairs GROUP BY ALL) GROUP BY ALL) GROUP BY ALL"""))
def fd_purity(s, root):
    return P.fd_purity(cell(s, root))


@query(K.with_(K.CELLS, """SELECT source_table_id, key, value, n FROM (SELECT *, row_number() OVER (PARTITION BY source_table_id, key ORDER BY n DESC, first) AS r FROM (
  SELECT k.source_table_id, k.text AS key, v.text AS value, count(*) AS n, min(k.row_id) AS first FROM cells k JOIN cells v USING (source_table_id, row_id)
  WHERE k.column_index = 1 AND v.column_index = 2 AND k.text <> '' AND v.text <> '' GROUP BY ALL)) WHERE r = 1"""))
def dominant_value_by_key(s, root):
    return P.dominant_by_key(cell(s, root), 1, 2)


@query(K.with_(K.CELLS, """SELECT source_table_id, string_agg(column_index::VARCHAR, ',' ORDER BY column_index) AS members, count(*) AS n FROM (
  SELECT source_table_id, column_index, string_agg(length(text) || ':' || text, '|' ORDER BY row_id) AS d FROM cells GROUP BY ALL) GROUP BY source_table_id, d HAVING count(*) >= 2"""))
def redundancy_groups(s, root):
    return P.redundant_columns(cell(s, root))


@query(K.with_(K.CELLS, f"""SELECT source_table_id, column_index, coalesce(round_even(max(n) FILTER (k <> '') / sum(n) FILTER (k <> ''), 6), 1.0) AS modal_share FROM (
  SELECT source_table_id, column_index, {K.normalize('text')} AS k, count(*) AS n FROM cells GROUP BY ALL) GROUP BY ALL"""))
def modal_share(s, root):
    return P.modal_share(cell(s, root))


@query("WITH " + K.CELLS + """, n AS (SELECT column_name, text, count(*) AS n FROM cells GROUP BY ALL), t AS (SELECT column_name, sum(n) FILTER (text <> '') AS filled, sum(n) AS total FROM n GROUP BY 1),
 e AS (SELECT column_name, count(*) AS d, sum((n / filled) * (n / filled)) AS c, -sum((n / filled) * log2(n / filled)) AS h FROM n JOIN t USING (column_name) WHERE text <> '' GROUP BY 1)
 SELECT column_name, round_even(1 - coalesce(filled, 0) / total, 6) AS missing_rate, coalesce(d, 0) AS distinct_values, round_even(c, 6) AS collision, round_even(h, 6) AS entropy_bits, round_even(2.0 ** h, 4) AS effective_values
 FROM t LEFT JOIN e USING (column_name)""")
def column_distribution(s, root):
    return P.distribution(cell(s, root), "column_name", "text")


@query(K.with_(K.PAIRS, """SELECT source_table_id, x_col, y_col, round_even(avg((x = y OR (least(length(x), length(y)) >= 4 AND (contains(x, y) OR contains(y, x))))::INT), 6) AS share, count(*) AS n
 FROM pairs WHERE x_col < y_col GROUP BY ALL"""))
def column_overlap_share(s, root):
    return P.overlap_share(cell(s, root))


@query(K.with_(K.CELLS, """SELECT source_table_id, 'Columns: ' || min(head) || chr(10) || string_agg('Row: ' || line, chr(10) ORDER BY row_id) AS serialized FROM (
  SELECT source_table_id, row_id, string_agg(column_name, ' | ' ORDER BY column_index) AS head, string_agg(left(text, 80), ' | ' ORDER BY column_index) AS line
  FROM cells WHERE row_id < 3 GROUP BY ALL) GROUP BY 1"""))
def serialized_tables(s, root):
    return C.serialized(cell(s, root))


@query(K.with_(K.CELLS, """SELECT source_table_id, row_id, -1 AS source_column_index, 'entity_url' AS column_name, coalesce('https://wiki.example/wiki/' || t, '') AS text FROM (
  SELECT source_table_id, row_id, min_by(replace(url_encode(replace(wiki_title, ' ', '_')), '%2F', '/'), column_index) FILTER (coalesce(wiki_title, '') <> '') AS t FROM cells GROUP BY ALL)"""))
def entity_url_column(s, root):
    return C.entity_urls(cell(s, root))


@query(K.with_(K.CELLS, f"""SELECT source_table_id, row_number() OVER (PARTITION BY source_table_id ORDER BY source_row_id) - 1 AS row_id, source_row_id, c0, c1 FROM (
  SELECT *, row_number() OVER (PARTITION BY source_table_id, k ORDER BY source_row_id) AS r FROM (
    SELECT a.source_table_id, a.row_id AS source_row_id, rtrim(left(a.text, 1024)) AS c0, rtrim(left(b.text, 1024)) AS c1, {K.normalize('a.text')} AS k
    FROM cells a JOIN cells b USING (source_table_id, row_id) WHERE a.column_index = 0 AND b.column_index = 1 AND a.text <> '' AND b.text <> '') WHERE k <> '') WHERE r = 1"""))
def project_rows(s, root):
    return C.projected_rows(cell(s, root), [0, 1], dedupe=0)


@query(K.with_(K.ENTITY, """SELECT source_table_id, column_index, rank FROM (SELECT p.source_table_id, p.column_index, row_number() OVER (PARTITION BY p.source_table_id ORDER BY non_empty_ratio DESC, unique_ratio, p.column_index DESC) AS rank
  FROM profiles p LEFT JOIN entity e ON e.source_table_id = p.source_table_id AND e.entity_column = p.column_index WHERE e.source_table_id IS NULL) WHERE rank <= 3"""))
def context_columns(s, root):
    c = cell(s, root)
    p = C.column_profiles(c)
    return C.context_columns(p, C.entity_column(p, c))


HINTED = " OR ".join(f"contains(lower(column_name), '{w}')" for w in P.MEASURE_HINTS)
IS_YEAR, IS_ORDINAL, IS_SCORE = (f"regexp_matches(text, '{p}')" for p in (P.YEAR, P.ORDINAL, P.SCORE))


@query("WITH " + K.CELLS + f""", a AS (SELECT source_table_id, column_index, bool_or({HINTED}) AS hint, count(*) FILTER (text <> '') AS k,
  coalesce(avg(({IS_YEAR} OR {IS_ORDINAL} OR {IS_SCORE} OR {K.number('text')})::INT) FILTER (text <> ''), 0) AS any_share,
  greatest(coalesce(avg({IS_YEAR}::INT) FILTER (text <> ''), 0), coalesce(avg({IS_ORDINAL}::INT) FILTER (text <> ''), 0), coalesce(avg({IS_SCORE}::INT) FILTER (text <> ''), 0)) AS one_share
  FROM cells GROUP BY ALL)
  SELECT source_table_id, column_index, round_even(any_share, 6) AS any_share, (k = 0 OR (hint AND any_share >= 0.65) OR one_share >= 0.8) AS veto FROM a""")
def non_entity_columns(s, root):
    return P.looks_like_no_entity(cell(s, root))


@query(f"SELECT kind, count(*) AS n, count(DISTINCT key) AS n_keys FROM (SELECT {K.kind('n')} AS kind, {K.key('n')} AS key FROM (SELECT {K.norm('value')} AS n FROM distinct_values)) GROUP BY 1")
def typed_value_kinds(s, root):
    v = with_value(table(s, root, "distinct_values").select("value"), "value")
    return v.groupBy(F.col("v_kind").alias("kind")).agg(F.count("*").alias("n"), F.countDistinct("v_key").alias("n_keys"))


@query(K.with_(K.CELLS, f"SELECT source_table_id, column_index, key, min(row_id) AS first_row, count(*) AS n_rows FROM (SELECT *, {K.key('n')} AS key FROM (SELECT *, {K.norm('text')} AS n FROM cells)) WHERE key IS NOT NULL GROUP BY ALL"))
def table_domains(s, root):
    typed_cells = with_value(cell(s, root).select("source_table_id", "row_id", "column_index", "text"), "text", empty=False)
    return typed_cells.groupBy("source_table_id", "column_index", F.col("v_key").alias("key")).agg(F.min("row_id").alias("first_row"), F.count("*").alias("n_rows"))


@query(K.with_(K.CELLS, """SELECT column_name, count(DISTINCT source_table_id) AS n_tables, count(DISTINCT source_table_id) FILTER (d = 0) AS all_missing, count(DISTINCT source_table_id) FILTER (d = 1) AS constant FROM (
  SELECT source_table_id, column_name, count(DISTINCT CASE WHEN text <> '' THEN text END) AS d FROM cells GROUP BY ALL) GROUP BY 1"""))
def column_summary(s, root):
    per = cell(s, root).groupBy("source_table_id", "column_name").agg(F.countDistinct(F.when(F.col("text") != "", F.col("text"))).alias("d"))
    return per.groupBy("column_name").agg(F.countDistinct("source_table_id").alias("n_tables"), F.countDistinct(F.when(F.col("d") == 0, F.col("source_table_id"))).alias("all_missing"), F.countDistinct(F.when(F.col("d") == 1, F.col("source_table_id"))).alias("constant"))

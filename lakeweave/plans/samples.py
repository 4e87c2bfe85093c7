"""Queries on sampling, splits, waiting times, distributions and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.operators import cells as C
from lakeweave.operators import dedupe as D
from lakeweave.operators import profiles as P
from lakeweave.operators import ranking as R
from lakeweave.operators import sampling as S
from lakeweave.operators import survival as V
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


def lake_ids(s, root):
    return table(s, root, "source_tables").select("source_table_id").filter("source_table_id is not null").distinct()


def sha(key: str, namespace: str, seed: int = 0, anchor: str = "''") -> str:
    return f"sha256('{namespace}|{seed}|' || {anchor} || '|' || {key})"


HEX = "[instr('0123456789abcdef', h[i]) - 1 FOR i IN range(1, length(h) + 1)]"
UNIT = "(('0x' || left(sha1('0|' || {k}), 13))::BIGINT / 4503599627370496.0)"


@query(f"SELECT seller_id, listing_id, r AS rank FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY {sha('listing_id::VARCHAR', 'order', 3, 'seller_id')}, listing_id) AS r FROM (SELECT DISTINCT seller_id, listing_id FROM abebooks WHERE seller_id IS NOT NULL)) WHERE r <= 5")
def hash_order_first(s, root):
    b = table(s, root, "abebooks").filter("seller_id is not null").select("seller_id", "listing_id").distinct()
    order = [S.sha_order(F.col("listing_id").cast("string"), "order", 3, F.col("seller_id")), F.col("listing_id")]
    return R.top_k(b, ["seller_id"], order, 5)


@query(f"SELECT source_table_id FROM (SELECT *, row_number() OVER (ORDER BY {sha('source_table_id', 'sample')}, source_table_id) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT source_table_id FROM source_tables WHERE source_table_id IS NOT NULL)) WHERE r <= ceil(n * 0.1)")
def exact_sample(s, root):
    return S.exact_sample(lake_ids(s, root), "source_table_id", 0.1)


@query(f"SELECT source, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {sha('asset_id', 'bottom')}, asset_id) AS r FROM (SELECT DISTINCT source, asset_id FROM bridge_assets WHERE source IS NOT NULL)) WHERE r <= 20")
def bottom_k_sample(s, root):
    return S.bottom_k(table(s, root, "bridge_assets").filter("source is not null"), "source", "asset_id", 20)


@query(f"SELECT source_table_id, CASE WHEN u < 0.8 THEN 'train' WHEN u < 0.9 THEN 'dev' ELSE 'test' END AS split FROM (SELECT source_table_id, {UNIT.format(k='source_table_id')} AS u FROM (SELECT DISTINCT source_table_id FROM source_tables WHERE source_table_id IS NOT NULL))")
def hash_split(s, root):
    return lake_ids(s, root).select("source_table_id", S.split_of(F.col("source_table_id")).alias("split"))


@query(f"SELECT source_table_id, list_reduce(list_prepend(0::BIGINT, {HEX}), lambda a, x: (a * 16 + x) % 10)::BIGINT AS fold, list_reduce(list_prepend(0::BIGINT, [instr('0123456789abcdef', g[i]) - 1 FOR i IN range(1, 17)]), lambda a, x: (a * 16 + x) % 7)::BIGINT AS shard FROM (SELECT source_table_id, sha256('fold|' || source_table_id) AS h, sha256(source_table_id) AS g FROM (SELECT DISTINCT source_table_id FROM source_tables WHERE source_table_id IS NOT NULL))")
def digest_modulus(s, root):
    k = F.col("source_table_id")
    return lake_ids(s, root).select("source_table_id", S.holdout(k, 10, "fold").alias("fold"), S.shard_of(k, 7).alias("shard"))


@query(f"""WITH i AS (SELECT *, row_number() OVER (ORDER BY {sha('source_table_id', 'split')}, source_table_id) AS p, count(*) OVER () AS n FROM (SELECT DISTINCT source_table_id FROM source_tables WHERE source_table_id IS NOT NULL))
 SELECT source_table_id, CASE WHEN p <= greatest(1, floor(n * 0.8)) THEN 'train' WHEN p <= greatest(1, floor(n * 0.8)) + greatest(1, floor(n * 0.1)) THEN 'dev' ELSE 'test' END AS split FROM i""")
def quota_split(s, root):
    return S.quota_splits(lake_ids(s, root), "source_table_id", (0.8, 0.1, 0.1))


@query("SELECT asset_type, asset_id, (row_number() OVER (PARTITION BY asset_type ORDER BY asset_id) - 1) % 4 AS shard FROM (SELECT DISTINCT asset_type, asset_id FROM bridge_assets)")
def balanced_shards(s, root):
    return S.balanced_shards(table(s, root, "bridge_assets").select("asset_type", "asset_id").distinct(), "asset_type", "asset_id", 4)


@query("SELECT lang, doc_id, ntile(5) OVER (PARTITION BY lang ORDER BY doc_id) AS chunk FROM documents")
def near_equal_chunks(s, root):
    return S.near_equal_chunks(table(s, root, "documents").select("lang", "doc_id"), "lang", "doc_id", 5)


@query("""WITH t AS (SELECT doc_id, coalesce(source, '') AS source, doc_id // 200 AS block, row_number() OVER (PARTITION BY doc_id // 200, coalesce(source, '') ORDER BY doc_id) AS turn FROM documents),
 f AS (SELECT *, min(CASE WHEN turn = 1 THEN doc_id END) OVER (PARTITION BY block, source) AS first FROM t)
 SELECT block, source, doc_id, row_number() OVER (PARTITION BY block ORDER BY turn, first) AS position FROM f""")
def fair_interleave(s, root):
    d = table(s, root, "documents").select(F.floor(F.col("doc_id") / 200).alias("block"), F.coalesce("source", F.lit("")).alias("source"), "doc_id")
    return R.round_robin(d, ["block"], "source", [F.col("doc_id")]).select("block", "source", "doc_id", "position")


@query(f"""WITH {K.LAKE}, r AS (SELECT source_table_id, unnest(range(len(data))) AS row_id FROM lake WHERE data IS NOT NULL), m AS (SELECT *, (row_id % 3 <> 1) AS rec FROM r),
 c AS (SELECT *, sum(rec::INT) OVER (PARTITION BY source_table_id ORDER BY row_id) AS rec_no, least(floor(count(*) OVER (PARTITION BY source_table_id) / 5), floor(sum(rec::INT) OVER (PARTITION BY source_table_id) / 3)) AS nv FROM m),
 d AS (SELECT *, (rec AND rec_no <= nv * 3) AS res FROM c), e AS (SELECT *, sum((NOT res)::INT) OVER (PARTITION BY source_table_id ORDER BY row_id) AS rest_no FROM d),
 v AS (SELECT source_table_id, row_id, nv, CASE WHEN res THEN floor((rec_no - 1) / 3) ELSE floor((rest_no - 1) / 2) END AS view FROM e)
 SELECT source_table_id, view::INT AS view, row_id FROM v WHERE nv > 0 AND view < nv""")
def disjoint_row_views(s, root):
    rows = C.lake(table(s, root, "source_tables")).filter("data is not null").select("source_table_id", F.explode(F.when(F.size("data") > 0, F.sequence(F.lit(0), F.size("data") - 1)).otherwise(F.array().cast("array<int>"))).alias("row_id"))
    return S.row_views(rows.withColumn("recovered", F.col("row_id") % 3 != 1), "source_table_id", "row_id", "recovered", 5, 3)


@query(f"""WITH d AS (SELECT DISTINCT source, asset_id FROM bridge_assets WHERE source IS NOT NULL), z AS (SELECT source, count(*) AS n, sqrt(count(*)) AS w FROM d GROUP BY 1),
 a AS (SELECT *, least(60, sum(n) OVER ()) AS slots FROM z), b AS (SELECT *, (slots - coalesce(sum(n) OVER (ORDER BY n, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY n DESC, source DESC) >= w AS fits FROM a),
 c AS (SELECT *, bool_and(fits) OVER (ORDER BY n, source) AS full_ FROM b), e AS (SELECT *, CASE WHEN full_ THEN n ELSE (slots - coalesce(sum(CASE WHEN full_ THEN n END) OVER (), 0)) * w / sum(CASE WHEN NOT full_ THEN w END) OVER () END AS share FROM c),
 f AS (SELECT *, floor(share) AS whole, row_number() OVER (PARTITION BY full_ ORDER BY share - floor(share) DESC, n, source) AS i, slots - sum(floor(share)) OVER () AS rest FROM e),
 q AS (SELECT source, whole + (NOT full_ AND i <= rest)::INT AS quota FROM f)
 SELECT source, asset_id FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY {sha('asset_id', 'take')}, asset_id) AS r FROM d) JOIN q USING (source) WHERE r <= quota""")
def stratified_take(s, root):
    d = table(s, root, "bridge_assets").filter("source is not null").select("source", "asset_id").distinct()
    return S.stratified_take(d, "source", "asset_id", 60, root=True)


H = 3600.0
EV = "ev AS (SELECT *, epoch(ts) - epoch(lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)) AS gap FROM events), hb AS (SELECT CASE WHEN gap >= 3600 THEN 63 ELSE least(63, floor(greatest(0, gap) * 64 / 3600))::INT END AS bin, count(*) FILTER (event_type <> 'error') AS e, count(*) FILTER (event_type = 'error') AS c FROM ev WHERE gap IS NOT NULL GROUP BY 1), hist AS (SELECT b::INT AS bin, coalesce(e, 0) AS events, coalesce(c, 0) AS censored FROM (SELECT unnest(range(64)) AS b) LEFT JOIN hb ON bin = b)"


def gaps(s, root):
    from pyspark.sql import Window

    e = table(s, root, "events").withColumn("t", F.unix_micros(F.col("ts").cast("timestamp")) / 1e6)
    return e.withColumn("gap", F.col("t") - F.lag("t").over(Window.partitionBy("user_id").orderBy("ts", "event_id"))).select("event_type", "gap")


def waiting(s, root):
    return V.histogram(gaps(s, root), "gap", H, F.col("event_type") != "error")


@query(f"WITH {EV} SELECT * FROM hist")
def waiting_histogram(s, root):
    return waiting(s, root)


KM = f"{EV}, rk AS (SELECT *, sum(events + censored) OVER (ORDER BY bin DESC) AS at_risk FROM hist), km AS (SELECT bin, events, censored, at_risk, coalesce(list_reduce(list_prepend(1.0::DOUBLE, list(CASE WHEN at_risk > 0 THEN 1 - events / at_risk ELSE 1.0 END) OVER (ORDER BY bin ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)), lambda a, x: a * x), 1.0) AS survival FROM rk)"


@query(f"WITH {KM} SELECT bin, events, censored, at_risk::BIGINT AS at_risk, round(survival, 6) AS survival FROM km")
def survival_curve(s, root):
    return V.kaplan_meier(waiting(s, root)).withColumn("survival", F.round("survival", 6))


@query(f"WITH {KM} SELECT bin, round(least(3600 - bin * 56.25, greatest(0, 56.25 * sum(survival) OVER (ORDER BY bin DESC) / greatest(survival, 1e-12))), 6) AS remaining FROM km")
def remaining_time(s, root):
    return V.remaining_mean(V.kaplan_meier(waiting(s, root)), H)


@query(f"WITH {EV} SELECT CASE WHEN sum(events) = 0 THEN 56.25 ELSE round(sum(events * (bin + 0.5) * 56.25) / sum(events), 6) END AS mean FROM hist")
def midpoint_mean(s, root):
    return V.midpoint_mean(waiting(s, root), H)


@query("SELECT user_id, count(*) AS done, (floor(count(*) / 25) + 1) * 25 AS next_mark FROM events GROUP BY 1")
def next_milestones(s, root):
    return table(s, root, "events").groupBy("user_id").agg(F.count("*").alias("done")).withColumn("next_mark", V.next_milestone(F.col("done"), 25))


@query("SELECT event_type, round(corr(value, json_extract(props, '$.k')::DOUBLE), 6) AS r, count(*) AS n FROM events GROUP BY 1")
def pearson_by_type(s, root):
    e = table(s, root, "events").withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    return e.groupBy("event_type").agg(F.round(F.corr("value", "k"), 6).alias("r"), F.count("*").alias("n"))


@query("SELECT event_type, count(value) AS n, coalesce(min(value), 0) AS least, coalesce(max(value), 0) AS most, coalesce(round_even(avg(value), 6), 0) AS mean FROM events GROUP BY 1")
def number_summaries(s, root):
    return table(s, root, "events").groupBy("event_type").agg(*P.number_summary(F.col("value")))


@query("SELECT coalesce(book_condition, 'null') AS value, count(*) AS n FROM abebooks GROUP BY 1")
def value_tally(s, root):
    return P.tally(table(s, root, "abebooks"), "book_condition")


FIELDS = ["isbn13", "title", "authors", "publisher", "publication_year", "book_condition"]


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, round_even(avg(({c} IS NOT NULL)::INT), 4) AS share FROM abebooks" for c in FIELDS))
def field_coverage(s, root):
    return P.coverage(table(s, root, "abebooks"), FIELDS)


@query("SELECT seller_id, round_even(1 - coalesce(sum(n) FILTER (v <> ''), 0) / sum(n), 6) AS missing_rate, count(*) FILTER (v <> '') AS distinct_values FROM (SELECT seller_id, coalesce(publisher, '') AS v, count(*) AS n FROM abebooks WHERE seller_id IS NOT NULL GROUP BY ALL) GROUP BY 1")
def publishers_by_seller(s, root):
    return P.distribution(table(s, root, "abebooks").filter("seller_id is not null"), "seller_id", "publisher").select("seller_id", "missing_rate", "distinct_values")


@query("SELECT source_table_id, min(l) AS first_split, max(l) AS last_split, count(*) AS n FROM (SELECT source_table_id, regexp_replace(lower(split), '\\s+', '', 'g') AS l FROM query_tables WHERE source_table_id IS NOT NULL AND split IS NOT NULL) GROUP BY 1 HAVING min(l) <> max(l)")
def sources_in_several_splits(s, root):
    q = table(s, root, "query_tables").withColumn("label", F.regexp_replace(F.lower("split"), r"\s+", ""))
    return D.torn_keys(q, "source_table_id", "label")


@query("SELECT table_id, source_table_id FROM (SELECT DISTINCT table_id, source_table_id FROM query_tables WHERE source_table_id IS NOT NULL) q WHERE NOT EXISTS (SELECT 1 FROM source_tables s WHERE s.source_table_id = q.source_table_id)")
def dangling_sources(s, root):
    q = table(s, root, "query_tables").select("table_id", "source_table_id").distinct()
    return D.dangling(q, "source_table_id", table(s, root, "source_tables"), "source_table_id").select("table_id", "source_table_id")


@query("(SELECT DISTINCT table_id AS id FROM distinct_values WHERE table_id IS NOT NULL) INTERSECT (SELECT source_table_id FROM query_tables WHERE source_table_id IS NOT NULL)")
def profiled_and_queried(s, root):
    a = table(s, root, "distinct_values").select(F.col("table_id").alias("id")).filter("id is not null")
    return a.intersect(table(s, root, "query_tables").select(F.col("source_table_id").alias("id")).filter("id is not null"))


@query("(SELECT DISTINCT source_table_id AS id FROM source_tables WHERE source_table_id IS NOT NULL) EXCEPT (SELECT source_table_id FROM query_tables WHERE source_table_id IS NOT NULL)")
def tables_without_queries(s, root):
    a = lake_ids(s, root).withColumnRenamed("source_table_id", "id")
    return a.exceptAll(a.intersect(table(s, root, "query_tables").select(F.col("source_table_id").alias("id")).filter("id is not null")))


@query("WITH d AS (SELECT doc_id, n_chars FROM documents WHERE n_chars IS NOT NULL) SELECT doc_id, list_transform(range(greatest(1, ceil((n_chars - 64) / 448.0)::BIGINT)), lambda i: i * 448)::VARCHAR AS begins FROM d WHERE n_chars > 0")
def token_windows(s, root):
    d = table(s, root, "documents").filter("n_chars > 0").select("doc_id", R.windows(F.col("n_chars"), 512, 64).alias("w"))
    return d.select("doc_id", F.concat(F.lit("["), F.array_join(F.transform("w", lambda x: x["begin"].cast("string")), ", "), F.lit("]")).alias("begins"))


@query(f"""WITH z AS (SELECT source, least(n, 5, 40) AS first, least(n, 40) - least(n, 5, 40) AS n FROM (SELECT source, count(DISTINCT asset_id) AS n FROM bridge_assets WHERE source IS NOT NULL GROUP BY 1)), v AS (SELECT *, sqrt(n) AS w FROM z WHERE n > 0),
 a AS (SELECT *, least(greatest(0, 120 - (SELECT sum(first) FROM z)), sum(n) OVER ()) AS slots FROM v), b AS (SELECT *, (slots - coalesce(sum(n) OVER (ORDER BY n, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(w) OVER (ORDER BY n DESC, source DESC) >= w AS fits FROM a),
 c AS (SELECT *, bool_and(fits) OVER (ORDER BY n, source) AS full_ FROM b), e AS (SELECT *, CASE WHEN full_ THEN n ELSE (slots - coalesce(sum(CASE WHEN full_ THEN n END) OVER (), 0)) * w / sum(CASE WHEN NOT full_ THEN w END) OVER () END AS share FROM c),
 f AS (SELECT *, floor(share) AS whole, row_number() OVER (PARTITION BY full_ ORDER BY share - floor(share) DESC, n, source) AS i, slots - sum(floor(share)) OVER () AS rest FROM e)
 SELECT z.source, (z.first + coalesce(whole + (NOT full_ AND i <= rest)::INT, 0))::BIGINT AS quota FROM z LEFT JOIN f USING (source)""")
def class_quotas(s, root):
    """120 slots over the sources: five each, the rest by roots, 40 at most."""
    sizes = table(s, root, "bridge_assets").filter("source is not null").groupBy("source").agg(F.countDistinct("asset_id").alias("n"))
    return S.base_then_root(sizes, "source", 120, 5, 40)


@query("""WITH c AS (SELECT entity_id, asset_type, page_url, asset_id, (source <> 'wiki_extract')::INT AS ind FROM (SELECT DISTINCT entity_id, asset_type, page_url, asset_id, source FROM bridge_assets WHERE entity_id IS NOT NULL AND asset_type IS NOT NULL AND page_url IS NOT NULL AND asset_id IS NOT NULL AND source IS NOT NULL)),
 o AS (SELECT *, row_number() OVER (PARTITION BY entity_id, page_url ORDER BY ind, asset_id, asset_type) AS r FROM c)
 SELECT entity_id, asset_type, page_url, asset_id, attempt FROM (SELECT *, row_number() OVER (PARTITION BY entity_id, asset_type ORDER BY ind, asset_id, asset_type) AS attempt FROM o WHERE r = 1) WHERE attempt <= 3""")
def planned_pages(s, root):
    """Up to three pages per entity and kind of evidence, encyclopedic sources first, no page twice."""
    a = table(s, root, "bridge_assets").select("entity_id", "asset_type", "page_url", "asset_id", "source").na.drop().distinct()
    return S.budgeted(a, "entity_id", "asset_type", "page_url", F.col("source") == "wiki_extract", [F.col("asset_id"), F.col("asset_type")], 3).drop("source")

"""The problems' queries and, where SQL can state them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lakeweave.llm import encode, formatting, names, neighbours, overlap, packing, quality, splits, truncation
from lakeweave.runtime import table


def p1_found(spark: SparkSession, root: str) -> DataFrame:
    return neighbours.similar_pairs(neighbours.most_similar(table(spark, root, "z_store"), least_cosine=0.9))


def p1_neighbours(spark: SparkSession, root: str) -> DataFrame:
    """The full lists. Unclustered vectors have no close neighbours and visit most shards, so the
    shards are larger and the bounds wider; see the README for recall and cost."""
    return neighbours.most_similar(table(spark, root, "z_store"), factor=0.12, tree_factor=0.25, shard_rows=5_000)


def p2_assets(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncated_assets(table(spark, root, "bridge_assets"))


def p2_found(spark: SparkSession, root: str) -> DataFrame:
    return p2_assets(spark, root).filter("cut").select("asset_id").distinct()


def p2_report(spark: SparkSession, root: str) -> DataFrame:
    return truncation.truncation_report(p2_assets(spark, root))


def p4_found(spark: SparkSession, root: str) -> DataFrame:
    return overlap.overlap_pairs(overlap.cross_split_overlaps(table(spark, root, "query_tables")))


def p4_counts(spark: SparkSession, root: str) -> DataFrame:
    return overlap.overlap_counts(table(spark, root, "query_tables"))


def p5_clusters(spark: SparkSession, root: str) -> DataFrame:
    return names.link_names(names.name_spellings(table(spark, root, "abebooks")), table(spark, root, "nickname_forms"))


def p5_found(spark: SparkSession, root: str) -> DataFrame:
    return names.name_pairs(p5_clusters(spark, root))


def p6_found(spark: SparkSession, root: str) -> DataFrame:
    return formatting.formatting_copies(table(spark, root, "distinct_values"), table(spark, root, "source_tables"))


def p6_counts(spark: SparkSession, root: str) -> DataFrame:
    return formatting.copy_counts(p6_found(spark, root))


def p7_found(spark: SparkSession, root: str) -> DataFrame:
    return splits.torn_views(table(spark, root, "query_tables"), table(spark, root, "source_tables"))


def p7_splits(spark: SparkSession, root: str) -> DataFrame:
    return splits.assign_splits(table(spark, root, "query_tables"), table(spark, root, "source_tables")).select("table_id", "new_split")


def p7_shares(spark: SparkSession, root: str) -> DataFrame:
    """Shares that the new splits reach; one giant page shows as the largest group."""
    return splits.split_shares(splits.assign_splits(table(spark, root, "query_tables"), table(spark, root, "source_tables")))


def p8_ids(spark: SparkSession, root: str) -> DataFrame:
    return encode.encode_documents(table(spark, root, "documents"))


def p9_containers(spark: SparkSession, root: str) -> DataFrame:
    return packing.pack(encode.count_tokens(table(spark, root, "documents")))


def p9_fill(spark: SparkSession, root: str) -> DataFrame:
    return packing.fill_report(p9_containers(spark, root))


def p10_found(spark: SparkSession, root: str) -> DataFrame:
    return p10_quality(spark, root).filter("not_prose").select("doc_id").distinct()


def p10_quality(spark: SparkSession, root: str) -> DataFrame:
    return quality.document_quality(table(spark, root, "documents"), table(spark, root, "common_words"))


def queries() -> dict:
    return {
        "p1_found": p1_found,
        "p1_neighbours": p1_neighbours,
        "p2_found": p2_found,
        "p2_assets": p2_assets,
        "p2_report": p2_report,
        "p4_found": p4_found,
        "p4_counts": p4_counts,
        "p5_found": p5_found,
        "p5_clusters": p5_clusters,
        "p6_found": p6_found,
        "p6_counts": p6_counts,
        "p7_found": p7_found,
        "p7_splits": p7_splits,
        "p7_shares": p7_shares,
        "p8_ids": p8_ids,
        "p9_containers": p9_containers,
        "p9_fill": p9_fill,
        "p10_found": p10_found,
        "p10_quality": p10_quality,
    }


#: Groups of query tables over any number of steps: sources and pages, closed by a recursive union.
GROUPS = r"""WITH RECURSIVE st AS (SELECT DISTINCT source_table_id AS s, nullif(regexp_replace(lower(pgtitle), '[_\t-\r \x{85}\p{Z}\x{200b}\x{feff}\x{ad}]+', '', 'g'), '') AS p FROM source_tables WHERE source_table_id IS NOT NULL),
 e AS (SELECT DISTINCT a.p AS a, b.p AS b FROM st a JOIN st b USING (s) WHERE a.p IS NOT NULL AND b.p IS NOT NULL),
 r(p, c) AS (SELECT DISTINCT p, p FROM st WHERE p IS NOT NULL UNION SELECT e.b, r.c FROM r JOIN e ON e.a = r.p),
 pc AS (SELECT p, min(c) AS c FROM r GROUP BY 1),
 sc AS (SELECT s, coalesce('p:' || min(c), 's:' || s) AS g FROM st LEFT JOIN pc USING (p) GROUP BY s),
 v AS (SELECT DISTINCT table_id, source_table_id, nullif(regexp_replace(lower(split), '\s+', '', 'g'), '') AS label FROM query_tables),
 vg AS (SELECT table_id, source_table_id, label, coalesce(g, 's:' || source_table_id, 'v:' || table_id) AS g FROM v LEFT JOIN sc ON s = source_table_id)"""

TORN = GROUPS + " SELECT DISTINCT table_id FROM vg WHERE label IS NOT NULL AND source_table_id IS NOT NULL AND g IN (SELECT g FROM vg WHERE label IS NOT NULL AND source_table_id IS NOT NULL GROUP BY g HAVING count(DISTINCT label) > 1)"


def _score(name: str, weight: float) -> str:
    return f"-{weight} / ln((('0x' || left(md5('0|{name}|' || g), 13))::BIGINT + 0.5) / 4503599627370496.0)"


ANEW = GROUPS + f""", o AS (SELECT table_id, min(g) AS g FROM vg WHERE table_id IS NOT NULL GROUP BY 1), w AS (SELECT table_id, g, {_score('train', 0.8)} AS a, {_score('dev', 0.1)} AS b, {_score('test', 0.1)} AS c FROM o)
 SELECT table_id, CASE WHEN a >= b AND a >= c THEN 'train' WHEN b >= c THEN 'dev' ELSE 'test' END AS new_split FROM w"""

SHARES = f"""WITH k AS ({ANEW.replace("SELECT table_id, CASE", "SELECT g, CASE")}), per AS (SELECT new_split, g, count(*) AS n FROM k GROUP BY 1, 2)
 SELECT new_split, sum(n)::BIGINT AS n_views, sum(n) / (SELECT count(*) FROM k) AS share, count(*) AS n_groups, max(n) AS largest_group FROM per GROUP BY 1"""


#: Letters, digits and signs of full width with their plain forms, as NFKC gives them.
WIDE = "".join(chr(c) for c in range(0xFF01, 0xFF5F)) + "\u3000\xa0"
NARROW = "".join(chr(c - 0xFEE0) for c in range(0xFF01, 0xFF5F)) + "  "


def _canonical(x: str) -> str:
    """SQL of the sorted words and numbers of a text; null if there is none."""
    plain = f"translate(regexp_replace({x}, '[\\p{{Cf}}\\x00-\\x08\\x0e-\\x1b\\x7f]', '', 'g'), '{WIDE.replace(chr(39), chr(39) * 2)}', '{NARROW.replace(chr(39), chr(39) * 2)}')"
    return f"nullif(array_to_string(list_sort(regexp_extract_all(nfc_normalize(replace(lower(nfc_normalize({plain})), 'ß', 'ss')), '\\pN+(?:[.,]\\pN+)*|[\\pL\\pM]+')), ' '), '')"


COPIES = f"""WITH v AS (SELECT DISTINCT value_id AS key, table_id, column_index, {_canonical('value')} AS c FROM distinct_values WHERE value_id IS NOT NULL),
 t AS (SELECT key, array_to_string(list(array_to_string(list_sort([x FOR x IN r IF x IS NOT NULL]), chr(31)) ORDER BY i), chr(30)) AS c FROM (
   SELECT key, d, i, list({_canonical('cell')} ORDER BY j) AS r FROM (SELECT key, d, i, unnest(CASE WHEN len(row) > 0 THEN row ELSE [NULL] END) AS cell, generate_subscripts(CASE WHEN len(row) > 0 THEN row ELSE [NULL] END, 1) AS j FROM (
     SELECT source_table_id AS key, row_number() OVER () AS d, unnest(data) AS row, generate_subscripts(data, 1) AS i FROM source_tables WHERE source_table_id IS NOT NULL AND data IS NOT NULL)) GROUP BY 1, 2, 3) GROUP BY key, d),
 g AS (SELECT 'distinct_values' AS tab, key, coalesce(table_id, chr(1)) || chr(31) || coalesce(column_index::VARCHAR, chr(1)) || chr(29) || c AS c FROM v WHERE c IS NOT NULL UNION SELECT 'source_tables', key, c FROM t WHERE replace(c, chr(30), '') <> ''),
 f AS (SELECT tab, min(key) OVER (PARTITION BY tab, c) AS kept_key, key AS copy_key FROM g)
 SELECT DISTINCT tab, kept_key, copy_key FROM f WHERE kept_key <> copy_key"""

COPY_COUNTS = f"SELECT tab, kept_key, count(*) + 1 AS n_copies FROM ({COPIES}) GROUP BY 1, 2"


#: All pairs of vectors: exact, while the operator may leave out a small part of them.
SIMILAR = """WITH z AS (SELECT vec_id, any_value(z)::DOUBLE[] AS z FROM z_store WHERE vec_id IS NOT NULL AND z IS NOT NULL AND len(z) = 64 GROUP BY 1),
 u AS (SELECT * FROM z WHERE len([x FOR x IN z IF x IS NULL OR isnan(x) OR isinf(x)]) = 0 AND len([x FOR x IN z IF x <> 0]) > 0),
 n AS (SELECT a.vec_id AS a, b.vec_id AS b, round(list_cosine_similarity(a.z, b.z), 12) AS c FROM u a JOIN u b ON a.vec_id <> b.vec_id),
 k AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY a ORDER BY c DESC, b) <= 10)
 SELECT DISTINCT least(a, b) AS vec_a, greatest(a, b) AS vec_b FROM k WHERE c >= 0.9"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that it can state; the others are held against brute force in tests/llm."""
    return {"p1_found": SIMILAR, "p6_found": COPIES, "p6_counts": COPY_COUNTS, "p7_found": TORN, "p7_splits": ANEW, "p7_shares": SHARES}

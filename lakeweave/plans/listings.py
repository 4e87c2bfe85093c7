"""Queries on book listings: keys, grouping, joins judged by the books they meet."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import books as B
from lakeweave.operators import listings as L
from lakeweave.plans import records as R
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


@query("WITH n AS (SELECT publisher AS v FROM abebooks WHERE publisher IS NOT NULL GROUP BY 1 HAVING count(*) >= 12) SELECT coalesce(v, 'tail') AS part, count(*) AS n, count(DISTINCT listing_id) AS listings FROM abebooks LEFT JOIN n ON v = publisher GROUP BY 1")
def publisher_groups(s, root):
    """Listings grouped to tables by publisher, small publishers together."""
    return L.by_value(table(s, root, "abebooks"), "publisher", 12).groupBy("part").agg(F.count("*").alias("n"), F.countDistinct("listing_id").alias("listings"))


ONE = "one AS (SELECT DISTINCT ON (listing_id) listing_id, seller_id, coalesce(book_id, '') AS book, title, authors, publication_year, publisher FROM abebooks WHERE seller_id IS NOT NULL AND title IS NOT NULL AND book_id IS NOT NULL ORDER BY listing_id, loaded_at DESC NULLS LAST, title, authors)"
TARGETS = "tg AS (SELECT part AS target, listing_id AS other, book, title, authors, publication_year FROM one JOIN (SELECT publisher AS v, publisher AS part FROM one WHERE publisher IS NOT NULL GROUP BY 1 HAVING count(*) >= 12) ON v = publisher)"
VIEWS = "qr AS (SELECT seller_id AS query, r AS row, book, title, authors, publication_year FROM (SELECT *, row_number() OVER (PARTITION BY seller_id ORDER BY listing_id) AS r FROM one) WHERE r <= 5)"


def _one(s, root):
    from pyspark.sql import Window

    b = table(s, root, "abebooks").filter("seller_id is not null and title is not null and book_id is not null")
    order = Window.partitionBy("listing_id").orderBy(F.desc_nulls_last("loaded_at"), F.asc_nulls_last("title"), F.asc_nulls_last("authors"))
    return settle(b.withColumn("r", F.row_number().over(order)).filter("r = 1").select("listing_id", "seller_id", F.col("book_id").alias("book"), "title", "authors", "publication_year", "publisher"))


def _tables(s, root, join: str):
    """Sellers' first five listings as query views, publishers with twelve listings or more as targets."""
    one = _one(s, root)
    q = L.first_rows(one, "seller_id", "listing_id", 5).select(F.col("seller_id").alias("query"), "row", "book", "title", F.col(join).cast("string").alias("join"))
    t = L.by_value(one, "publisher", 12).filter("part <> 'tail'").select(F.col("part").alias("target"), F.col("listing_id").alias("other"), "book", "title", F.col(join).cast("string").alias("join"), F.col("publication_year").alias("added"))
    return q, t


PAIRS = f"""{ONE}, {TARGETS}, {VIEWS}, ks AS (SELECT authors, k FROM ({R.LISTS}) WHERE k <> ''),
 pr AS (SELECT q.query, t.target, q.row, t.other, CASE WHEN q.book = t.book THEN 'same_book' WHEN {R.words('q.title')} = {R.words('t.title')} THEN 'same_title' ELSE 'different_book' END AS status, t.publication_year IS NOT NULL AS adds
  FROM (SELECT qr.*, k FROM qr JOIN ks USING (authors)) q JOIN (SELECT tg.*, k FROM tg JOIN ks USING (authors)) t ON t.k = q.k)"""


@query(f"WITH {PAIRS} SELECT query, target, row, other, status, adds FROM pr")
def author_join_pairs(s, root):
    return L.author_joins(*_tables(s, root, "authors"))


@query(
    f"""WITH {PAIRS}, z AS (SELECT query, count(*) AS rows FROM qr GROUP BY 1), g AS (SELECT query, target, bool_or(status = 'different_book') AS wrong, bool_or(status = 'same_title') AS unsure, count(DISTINCT row) FILTER (adds) AS covered FROM pr GROUP BY 1, 2)
 SELECT query, target, CASE WHEN wrong OR covered < rows THEN 'negative' WHEN unsure THEN 'unjudged' ELSE 'positive' END AS status, CASE WHEN wrong THEN 'different_book' WHEN covered < rows THEN 'incomplete' WHEN unsure THEN 'same_title' ELSE 'complete' END AS reason FROM g JOIN z USING (query)"""
)
def judged_author_joins(s, root):
    q, t = _tables(s, root, "authors")
    return L.judged_joins(L.author_joins(q, t), q)


@query(
    f"""WITH {ONE}, {TARGETS}, {VIEWS}, yr AS (SELECT q.query, t.target, q.row, q.book = t.book OR {R.words('q.title')} = {R.words('t.title')} AS fits FROM qr q JOIN tg t ON t.publication_year = q.publication_year WHERE regexp_full_match(q.publication_year::VARCHAR, '[12]\\d{{3}}'))
 SELECT query, target FROM yr GROUP BY 1, 2 HAVING bool_and(fits) AND count(DISTINCT row) >= 2"""
)
def year_shortcuts(s, root):
    """Targets that the visible year alone would join to a view without meeting a different book."""
    return L.context_shortcuts(*_tables(s, root, "publication_year"), "publication_year")


@query(
    f"""WITH b AS (SELECT book_id, min(title) AS title, max(authors) AS authors, min(seller_name) AS seller_name FROM abebooks LEFT JOIN sellers USING (seller_id) WHERE book_id IS NOT NULL GROUP BY 1),
 l AS (SELECT DISTINCT book_id, listing_id, title AS lt, authors AS la, seller_name AS ls FROM abebooks LEFT JOIN sellers USING (seller_id) WHERE book_id IS NOT NULL),
 j AS (SELECT book_id, list(DISTINCT listing_id ORDER BY listing_id) FILTER ({K.normalize('seller_name')} <> '' AND {K.normalize('seller_name')} = {K.normalize('ls')}) AS h1, list(DISTINCT listing_id ORDER BY listing_id) FILTER ({K.normalize('title')} <> '' AND {K.normalize('title')} = {K.normalize('lt')} AND {K.normalize('authors')} = {K.normalize('la')}) AS h2 FROM b JOIN l USING (book_id) GROUP BY 1)
 SELECT book_id, CASE WHEN len(h1) > 0 THEN 'seller_name' WHEN len(h2) > 0 THEN 'title_authors' ELSE 'none' END AS method, array_to_string(CASE WHEN len(h1) > 0 THEN h1 WHEN len(h2) > 0 THEN h2 ELSE [] END, ',') AS listings FROM j"""
)
def detail_listings(s, root):
    """Which listings a book's record describes, by the seller's name or by title and authors."""
    l = table(s, root, "abebooks").filter("book_id is not null").join(table(s, root, "sellers").select("seller_id", "seller_name"), "seller_id", "left").withColumn("seller_url", F.lit(None).cast("string"))
    book = l.groupBy("book_id").agg(F.min("title").alias("title"), F.max("authors").alias("authors"), F.min("seller_name").alias("seller_name"), F.first("seller_url").alias("seller_url"))
    return L.detail_listing(book, l.select("book_id", "listing_id", "seller_url", "seller_name", "title", "authors"), "book_id").withColumn("listings", F.array_join("listings", ","))


DIGITS = "regexp_replace(upper(isbn13), '[^0-9X]', '', 'g')"
TEN = "list_sum([(11 - i) * (CASE WHEN dd[i] = 'X' THEN 10 ELSE dd[i]::INT END) FOR i IN range(1, 11)])"
CHECK = "(10 - (38 + list_sum([(CASE WHEN i % 2 = 1 THEN 3 ELSE 1 END) * dd[i]::INT FOR i IN range(1, 10)])) % 10) % 10"
VALID = f"CASE WHEN regexp_full_match(d, '[0-9]{{13}}') AND {R.S13.replace('d[i]', 'dd[i]')} % 10 = 0 THEN d WHEN regexp_full_match(d, '[0-9]{{9}}[0-9X]') AND {TEN} % 11 = 0 THEN '978' || left(d, 9) || {CHECK} END"


@query(f"SELECT isbn13, coalesce('isbn13:' || v, CASE WHEN d <> '' THEN 'isbn10:' || d END) AS key, CASE WHEN v IS NOT NULL THEN 'isbn13' WHEN d <> '' THEN 'isbn10_fallback' ELSE 'unusable' END AS scheme FROM (SELECT *, {VALID} AS v FROM (SELECT isbn13, d, CASE WHEN regexp_full_match(d, '[0-9]{{13}}|[0-9]{{9}}[0-9X]') THEN d ELSE '' END || '0000000000000' AS dd FROM (SELECT DISTINCT isbn13, {DIGITS} AS d FROM abebooks WHERE isbn13 IS NOT NULL)))")
def book_keys(s, root):
    b = table(s, root, "abebooks").filter("isbn13 is not null").select("isbn13").distinct()
    return b.select("isbn13", B.book_key(F.col("isbn13")).alias("k")).select("isbn13", "k.key", "k.scheme")


FILLERS = "[" + ", ".join(f"'{w}'" for w in B.HEADER_FILLERS) + "]"
SINGLE = "CASE WHEN w = 'ranking' THEN 'rank' WHEN length(w) > 4 AND w LIKE '%ies' THEN left(w, -3) || 'y' WHEN length(w) > 3 AND w LIKE '%s' AND w NOT LIKE '%ss' THEN left(w, -1) ELSE w END"


@query(f"SELECT column_name, array_to_string(list_sort(CASE WHEN len(t) > 0 THEN [{SINGLE} FOR w IN t] ELSE ws END), ' ') AS header_key FROM (SELECT column_name, ws, [w FOR w IN ws IF NOT list_contains({FILLERS}, w)] AS t FROM (SELECT column_name, [w FOR w IN string_split(trim(regexp_replace(lower({K.clean('column_name')}), '[^\\pL\\pN]+', ' ', 'g')), ' ') IF w <> ''] AS ws FROM (SELECT DISTINCT column_name FROM distinct_values WHERE column_name IS NOT NULL)))")
def header_keys(s, root):
    d = table(s, root, "distinct_values").filter("column_name is not null").select("column_name").distinct()
    return d.select("column_name", B.header_key(F.col("column_name")).alias("header_key"))


NUM = "'^([+-]?(?:\\d{1,3}(?:,\\d{3})+|\\d+)(?:\\.\\d+)?)\\s*([%a-z°²³/_-]*)$'"


@query(f"SELECT unit, count(*) AS n, round(avg(number), 4) AS mean FROM (SELECT regexp_extract(t, {NUM}, 2) AS unit, replace(regexp_extract(t, {NUM}, 1), ',', '')::DOUBLE AS number FROM (SELECT {K.norm('value')} AS t FROM distinct_values WHERE value IS NOT NULL) WHERE regexp_matches(t, {NUM})) GROUP BY 1")
def numbers_with_units(s, root):
    """Numbers of all values by the unit behind them."""
    n = table(s, root, "distinct_values").filter("value is not null").select(B.number_with_unit(F.col("value")).alias("x")).filter("x is not null").select("x.unit", F.col("x.number").cast("double").alias("number"))
    return n.groupBy("unit").agg(F.count("*").alias("n"), F.round(F.avg("number"), 4).alias("mean"))

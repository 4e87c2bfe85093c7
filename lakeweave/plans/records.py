"""Queries on book records and evidence about entities."""

from __future__ import annotations

from pyspark.sql import functions as F

from lakeweave.functions import books as B
from lakeweave.functions import text as T
from lakeweave.functions import vectors as X
from lakeweave.operators import dedupe as D
from lakeweave.operators import evidence as E
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


@query("SELECT listing_id, book_id, title, r AS place FROM (SELECT *, row_number() OVER (PARTITION BY listing_id ORDER BY loaded_at DESC NULLS LAST, (authors IS NULL)::INT, title) AS r FROM abebooks) WHERE r = 1")
def latest_listings(s, root):
    order = [F.col("loaded_at").desc_nulls_last(), F.col("authors").isNull().cast("int"), F.col("title")]
    return D.winners_and_losers(table(s, root, "abebooks"), ["listing_id"], order).filter("place = 1").select("listing_id", "book_id", "title", "place")


@query("SELECT book_id, listing_id FROM (SELECT *, row_number() OVER (PARTITION BY book_id ORDER BY (authors IS NULL OR trim(authors) = '')::INT, (isbn13 IS NULL)::INT, (publication_year IS NULL)::INT, listing_id) AS r FROM (SELECT DISTINCT book_id, listing_id, authors, isbn13, publication_year FROM abebooks)) WHERE r = 1")
def best_listing_per_book(s, root):
    b = table(s, root, "abebooks").select("book_id", "listing_id", "authors", "isbn13", "publication_year").distinct()
    order = [(F.col("authors").isNull() | (F.trim("authors") == "")).cast("int"), F.col("isbn13").isNull().cast("int"), F.col("publication_year").isNull().cast("int"), F.col("listing_id")]
    return D.winner(b, ["book_id"], order).select("book_id", "listing_id")


S13 = "list_sum([((CASE WHEN i % 2 = 1 THEN 1 ELSE 3 END) * d[i]::INT) FOR i IN range(1, 14)])"


@query(f"SELECT isbn13, CASE WHEN length(d) = 13 AND regexp_full_match(d, '[0-9]{{13}}') AND {S13} % 10 = 0 THEN d END AS valid, count(*) AS n FROM (SELECT isbn13, CASE WHEN regexp_full_match(regexp_replace(upper(isbn13), '[^0-9X]', '', 'g'), '[0-9]{{13}}') THEN regexp_replace(upper(isbn13), '[^0-9X]', '', 'g') END AS d FROM abebooks WHERE isbn13 IS NOT NULL) GROUP BY 1, 2")
def valid_isbns(s, root):
    b = table(s, root, "abebooks").filter("isbn13 is not null")
    return b.groupBy("isbn13", B.isbn13(F.col("isbn13")).alias("valid")).agg(F.count("*").alias("n"))


def words(x: str) -> str:
    """SQL of the words of a text: lower case, apostrophes dropped, letters and digits only."""
    return f"trim(regexp_replace(regexp_replace(lower({x}), '[''’]', '', 'g'), '[^\\pL\\pN]+', ' ', 'g'))"


BRAND = " ".join(f"WHEN regexp_matches(k, '{p}') THEN '{b}'" for p, b in B.BRANDS)
PUBLISHER = f"CASE WHEN k IN {B.NO_PUBLISHER} THEN '' {BRAND} ELSE k END"
LETTERS = "regexp_replace(regexp_replace(lower({}), '\\(\\s*edition\\b[^)]*\\)', '', 'g'), '[^a-z0-9]', '', 'g')"


@query(f"SELECT publisher_key, count(*) AS n, count(DISTINCT publisher) AS spellings FROM (SELECT publisher, {PUBLISHER} AS publisher_key FROM (SELECT publisher, {LETTERS.format('publisher')} AS k FROM abebooks WHERE publisher IS NOT NULL)) GROUP BY 1")
def publisher_keys(s, root):
    b = table(s, root, "abebooks").filter("publisher is not null")
    return b.groupBy(B.publisher_key(F.col("publisher")).alias("publisher_key")).agg(F.count("*").alias("n"), F.countDistinct("publisher").alias("spellings"))


@query("SELECT CASE WHEN regexp_full_match(publication_year::VARCHAR, '[12]\\d{3}') THEN publication_year END AS year, count(*) AS n FROM abebooks GROUP BY 1")
def stated_years(s, root):
    return table(s, root, "abebooks").groupBy(B.stated_year(F.col("publication_year")).alias("year")).agg(F.count("*").alias("n"))


FAMILY = words(f"regexp_replace(regexp_replace(title, '\\([^)]*(?:edition|\\bed\\.?\\b|paperback|hardcover)[^)]*\\)', '', 'gi'), '\\b(?:\\d+(?:st|nd|rd|th)|{B.ORDINALS})\\s+edition\\b', '', 'gi')")


@query(f"SELECT {FAMILY} AS family, count(*) AS n, count(DISTINCT title) AS titles FROM abebooks WHERE title IS NOT NULL GROUP BY 1")
def title_families(s, root):
    b = table(s, root, "abebooks").filter("title is not null")
    return b.groupBy(B.family_title(F.col("title")).alias("family")).agg(F.count("*").alias("n"), F.countDistinct("title").alias("titles"))


#: Full-width signs as NFKC gives them, and blanks of every kind off both ends.
WRITTEN = "regexp_replace(lower(translate(authors, '；，＆：．　', ';,&:. ')), '^\\s+|\\s+$', '', 'g')"
ENDS = "regexp_replace({}, '^\\s+|\\s+$', '', 'g')"
SURE = "regexp_full_match(trim(x), '\\pL+(?:[-''’]\\pL+)*,\\s*[\\pL\\pN_ .''-]+') AND NOT regexp_matches(x, '\\b(?:and|ed|eds|editor|jr|sr)\\b')"
TURN = f"[CASE WHEN {SURE} THEN regexp_replace(trim(x), '^(.*?),\\s*(.*)$', '\\2 \\1') ELSE x END FOR x IN string_split({WRITTEN}, ';')]"


@query(f"SELECT authors, CASE WHEN {WRITTEN} IN {B.NO_AUTHOR} THEN '' ELSE {words(f"array_to_string({TURN}, '; ')")} END AS author_key, count(*) AS n FROM abebooks WHERE authors IS NOT NULL GROUP BY 1, 2")
def author_keys(s, root):
    b = table(s, root, "abebooks").filter("authors is not null").groupBy("authors").agg(F.count("*").alias("n"))
    return b.select("authors", B.author_key(F.col("authors")).alias("author_key"), "n")


PIECES = "[trim(p) FOR p IN string_split(m, ',')]"
N_WORDS = "len(string_split({}, ' '))"
NAMES = f"""SELECT authors, m, CASE WHEN list_contains(ps, '') THEN NULL
  WHEN len(ps) % 2 = 0 AND len([1 FOR p IN [ps[i] FOR i IN range(1, len(ps) + 1, 2)] IF {N_WORDS.format(words('p'))} <> 1 OR {words('p')} = '']) = 0 THEN [ps[2 * i] || ' ' || ps[2 * i - 1] FOR i IN range(1, len(ps) // 2 + 1)]
  WHEN len(ps) = 1 OR len([1 FOR p IN ps IF {N_WORDS.format(words('p'))} < 2]) = 0 THEN ps END AS names
  FROM (SELECT *, {PIECES} AS ps FROM (SELECT authors, unnest(regexp_split_to_array(t, '\\s*;\\s*|\\s+(?:and|et)\\s+|\\s*&\\s*')) AS m FROM (
    SELECT DISTINCT authors, regexp_replace({WRITTEN}, ':+$', '') AS t FROM abebooks WHERE authors IS NOT NULL AND NOT regexp_matches(lower(authors), '\\b(?:editor|edited|eds|professor|et al)\\b'))))"""
LISTS = f"""SELECT authors, array_to_string(list_sort(ks), ' | ') AS k FROM (
  SELECT authors, flatten(list([{words('n')} FOR n IN names])) AS ks, bool_or(names IS NULL) AS bad FROM ({NAMES}) GROUP BY 1)
  WHERE NOT bad AND len(list_distinct(ks)) = len(ks) AND len([1 FOR k IN ks IF NOT contains(k, ' ') OR regexp_matches(k, '[0-9]')]) = 0"""


@query(f"SELECT DISTINCT authors, coalesce(k, '') AS names FROM abebooks LEFT JOIN ({LISTS}) USING (authors) WHERE authors IS NOT NULL")
def author_lists(s, root):
    return table(s, root, "abebooks").filter("authors is not null").select("authors").distinct().select("authors", B.matching_key(F.col("authors")).alias("names"))


CLEAR = f"len(string_split(p, ',')) = 2 AND len([1 FOR q IN string_split(p, ',') IF NOT regexp_full_match({ENDS.format('q')}, '[\\pL .''’-]+')]) = 0 AND NOT regexp_matches(lower(p), '\\b(?:and|ed|eds|editor|jr|sr|et al)\\b')"
NATURAL = f"CASE WHEN len([1 FOR p IN string_split(authors, ';') IF {CLEAR}]) = 0 THEN authors ELSE array_to_string([CASE WHEN {CLEAR} THEN {ENDS.format("split_part(p, ',', 2)")} || ' ' || {ENDS.format("split_part(p, ',', 1)")} ELSE {ENDS.format('p')} END FOR p IN string_split(authors, ';')], '; ') END"


@query(f"SELECT DISTINCT authors, {NATURAL} AS natural FROM abebooks WHERE authors IS NOT NULL")
def natural_author_names(s, root):
    return table(s, root, "abebooks").filter("authors is not null").select("authors").distinct().select("authors", B.natural_names(F.col("authors")).alias("natural"))


STOPS = "[" + ", ".join(f"'{w}'" for w in B.TITLE_STOPS) + "]"
TITLE_WORDS = "list_distinct([w FOR w IN string_split({}, ' ') IF w <> '' AND NOT list_contains(" + STOPS + ", w)])"


@query(f"""SELECT title, source, (len(a) > 0 AND hit >= least(2, len(a)) AND hit / len(a) >= 0.65) AS same FROM (SELECT *, len(list_intersect(a, b)) AS hit FROM (
  SELECT DISTINCT title, source, {TITLE_WORDS.format(words('title'))} AS a, {TITLE_WORDS.format(words('source'))} AS b FROM abebooks JOIN (SELECT book_id, min(title) AS source FROM abebooks WHERE title IS NOT NULL GROUP BY 1) USING (book_id) WHERE title IS NOT NULL))""")
def titles_of_one_book(s, root):
    """Every title of a book against the book's first title."""
    b = table(s, root, "abebooks").filter("title is not null").select("book_id", "title")
    first = b.groupBy("book_id").agg(F.min("title").alias("source"))
    return b.join(first, "book_id").select("title", "source").distinct().select("title", "source", B.same_title(F.col("title"), F.col("source")).alias("same"))


POSSESSIVE = "regexp_replace(title, '[''’]s\\b', '', 'gi')"


@query(f"""SELECT title, authors, publisher, len([1 FOR n IN string_split(coalesce(k, ''), ' | ') IF n <> '' AND contains(' ' || {words(POSSESSIVE)} || ' ', ' ' || string_split(n, ' ')[-1] || ' ')]) > 0 AS shows_author,
  (pk <> '' AND (contains(regexp_replace(lower(title), '[^a-z0-9]', '', 'g'), pk) OR tk = pk)) AS shows_publisher
  FROM (SELECT *, {PUBLISHER.replace('k ', 'pk0 ').replace('(k,', '(pk0,').replace('ELSE k', 'ELSE pk0')} AS pk, {PUBLISHER.replace('k ', 'tk0 ').replace('(k,', '(tk0,').replace('ELSE k', 'ELSE tk0')} AS tk FROM (
    SELECT DISTINCT title, authors, publisher, {LETTERS.format('publisher')} AS pk0, {LETTERS.format('title')} AS tk0 FROM abebooks WHERE title IS NOT NULL AND authors IS NOT NULL AND publisher IS NOT NULL)) LEFT JOIN ({LISTS}) USING (authors)""")
def titles_that_show_names(s, root):
    """Whether a listing's title already shows its author or publisher."""
    b = table(s, root, "abebooks").filter("title is not null and authors is not null and publisher is not null").select("title", "authors", "publisher").distinct()
    return b.select("title", "authors", "publisher", B.visible_author(F.col("title"), B.author_names(F.col("authors"))).alias("shows_author"), B.visible_publisher(F.col("title"), F.col("publisher")).alias("shows_publisher"))


@query("SELECT s.seller_id, s.seller_name, count(l.listing_id) AS listings, count(DISTINCT l.book_id) AS books FROM sellers s LEFT JOIN (SELECT DISTINCT listing_id, seller_id, book_id FROM abebooks) l USING (seller_id) GROUP BY 1, 2")
def listings_per_seller(s, root):
    per = table(s, root, "abebooks").select("listing_id", "seller_id", "book_id").distinct().groupBy("seller_id").agg(F.count("listing_id").alias("listings"), F.countDistinct("book_id").alias("books"))
    return table(s, root, "sellers").select("seller_id", "seller_name").join(per, "seller_id", "left").select("seller_id", "seller_name", F.coalesce("listings", F.lit(0)).alias("listings"), F.coalesce("books", F.lit(0)).alias("books"))


USABLE = "us AS (SELECT * EXCLUDE (r) FROM (SELECT *, row_number() OVER (PARTITION BY asset_id ORDER BY loaded_at DESC NULLS LAST, content DESC NULLS LAST) AS r FROM bridge_assets WHERE asset_id IS NOT NULL AND CASE WHEN asset_type = 'image' THEN coalesce(trim(local_path), '') <> '' ELSE coalesce(trim(content), '') <> '' END) WHERE r = 1)"


@query(f"WITH {USABLE} SELECT asset_type, source, count(*) AS n FROM us GROUP BY ALL")
def usable_assets(s, root):
    return E.usable(table(s, root, "bridge_assets")).groupBy("asset_type", "source").agg(F.count("*").alias("n"))


@query(f"WITH {USABLE}, pe AS (SELECT entity_id, count(*) FILTER (asset_type = 'text') AS t, count(*) FILTER (asset_type = 'image') AS i, min(asset_id) AS f FROM us WHERE entity_id IS NOT NULL GROUP BY 1) SELECT doc_id AS owner, coalesce(t, 0) AS n_text, coalesce(i, 0) AS n_image, f AS first_asset FROM documents LEFT JOIN pe USING (entity_id)")
def document_asset_links(s, root):
    return E.links(table(s, root, "documents"), "doc_id", "entity_id", E.usable(table(s, root, "bridge_assets")))


@query(f"WITH {USABLE}, pe AS (SELECT entity_id, count(*) FILTER (asset_type = 'text') > 0 AS t, count(*) FILTER (asset_type = 'image') > 0 AS i FROM us WHERE entity_id IS NOT NULL GROUP BY 1) SELECT CASE WHEN t AND i THEN 'text_and_image' WHEN t THEN 'text_only' WHEN i THEN 'image_only' ELSE 'none' END AS mode, count(*) AS n FROM pe GROUP BY 1")
def support_modes(s, root):
    per = E.usable(table(s, root, "bridge_assets")).filter("entity_id is not null").groupBy("entity_id").agg((F.count_if(F.col("asset_type") == "text") > 0).alias("t"), (F.count_if(F.col("asset_type") == "image") > 0).alias("i"))
    return per.groupBy(E.support_mode(F.col("t"), F.col("i")).alias("mode")).agg(F.count("*").alias("n"))


@query("WITH d AS (SELECT DISTINCT asset_id, asset_type, sha256(nfc_normalize(replace(replace(content, chr(13) || chr(10), chr(10)), chr(13), chr(10)))) AS h FROM bridge_assets WHERE content IS NOT NULL), m AS (SELECT asset_type, h, min(asset_id) AS canonical, count(*) AS copies FROM d GROUP BY ALL) SELECT asset_id, asset_type, canonical, copies FROM d JOIN m USING (asset_type, h)")
def content_aliases(s, root):
    return D.aliases(table(s, root, "bridge_assets"), "asset_id", "asset_type", "content")


@query("SELECT page_url, CASE WHEN regexp_matches(page_url, '^[A-Za-z][A-Za-z0-9+.\\-]*://') THEN lower(regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)', 1)) || '://' || lower(regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)', 2)) || rtrim(regexp_extract(page_url, '^([A-Za-z][A-Za-z0-9+.\\-]*)://([^/?#]*)([^?#]*)', 3), '/') END AS bare, count(*) AS n FROM bridge_assets GROUP BY 1, 2")
def bare_urls(s, root):
    return table(s, root, "bridge_assets").groupBy("page_url", T.bare_url("page_url").alias("bare")).agg(F.count("*").alias("n"))


@query(f"SELECT column_name, {K.normalize('column_name')} AS name_key, count(*) AS n FROM distinct_values GROUP BY 1, 2")
def normalized_headers(s, root):
    return table(s, root, "distinct_values").groupBy("column_name", T.normalize("column_name").alias("name_key")).agg(F.count("*").alias("n"))


@query("SELECT doc_id, (length(t) - length(replace(t, 'tower', ''))) // 5 + 2 * ((length(t) - length(replace(t, 'bridge', ''))) // 6) AS score FROM (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents)")
def weighted_term_scores(s, root):
    t = F.lower(F.coalesce("text", F.lit("")))
    return table(s, root, "documents").select("doc_id", (E.times(t, F.lit("tower")) + 2 * E.times(t, F.lit("bridge"))).alias("score"))


@query("WITH a AS (SELECT DISTINCT asset_id, content FROM bridge_assets WHERE content IS NOT NULL) SELECT label, count(*) AS n FROM (SELECT CASE WHEN contains(lower(content), 'harbour') AND contains(lower(content), 'ferry') THEN 0.9 WHEN contains(lower(content), 'ferry') THEN 0.8 WHEN contains(lower(content), 'harbour') THEN 0.5 ELSE 0.0 END AS label FROM a) GROUP BY 1")
def weak_labels(s, root):
    a = table(s, root, "bridge_assets").select("asset_id", "content").filter("content is not null").distinct()
    return a.groupBy(E.weak_label(F.col("content"), F.lit("harbour"), F.lit("ferry")).alias("label")).agg(F.count("*").alias("n"))


@query("WITH w AS (SELECT book_id, token, count(*) AS tf FROM (SELECT book_id, unnest(regexp_extract_all(lower(title), '[a-z0-9_]+')) AS token FROM (SELECT book_id, min(title) AS title FROM abebooks WHERE title IS NOT NULL GROUP BY 1)) GROUP BY ALL), d AS (SELECT token, count(*) AS df FROM w GROUP BY 1), n AS (SELECT count(DISTINCT book_id) AS n FROM abebooks WHERE title IS NOT NULL), v AS (SELECT book_id, token, tf * (ln((n + 1) / (df + 1)) + 1) AS x FROM w JOIN d USING (token), n), q AS (SELECT book_id, sqrt(sum(x * x)) AS q FROM v GROUP BY 1) SELECT book_id, token, round(x / q, 6) AS weight FROM v JOIN q USING (book_id)")
def title_tf_idf(s, root):
    titles = table(s, root, "abebooks").filter("title is not null").groupBy("book_id").agg(F.min("title").alias("title"))
    return E.tf_idf(titles, "book_id", "title").select("book_id", "token", F.round("weight", 6).alias("weight"))


@query("SELECT a.vec_id AS a, b.vec_id AS b, round(greatest(0, least(1, (list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) + 1) / 2)), 6) AS score FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1")
def neighbour_cosines(s, root):
    e = table(s, root, "embeddings").select("vec_id", "embedding")
    b = e.select((F.col("vec_id") - 1).alias("a"), F.col("vec_id").alias("b"), F.col("embedding").alias("z"))
    return e.join(b, e["vec_id"] == b["a"]).select("a", "b", F.round(X.unit_cosine("embedding", "z"), 6).alias("score"))


@query("SELECT label, count(*) AS n, round(avg(sqrt(list_sum([x * x FOR x IN embedding::DOUBLE[]]))), 6) AS mean_length FROM embeddings GROUP BY 1")
def vector_lengths(s, root):
    return table(s, root, "embeddings").groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg(X.length("embedding")), 6).alias("mean_length"))


@query("SELECT label, k - 1 AS position, round(avg(x), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS k FROM embeddings) GROUP BY 1, 2")
def group_mean_vectors(s, root):
    p = table(s, root, "embeddings").select("label", F.posexplode("embedding").alias("position", "x"))
    return p.groupBy("label", "position").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


@query()
def text_chunks(s, root):
    d = table(s, root, "documents").filter("text is not null")
    return d.select("doc_id", F.posexplode(T.chunks(800)("text")).alias("pos", "chunk"))


HOST = "regexp_extract(lower(page_url), '^\\s*https?://([^/?#:@]+)', 1)"


@query(f"SELECT page_url, CASE WHEN regexp_matches(page_url, '^\\s*(?i)https?://[^/?#:@]+(?:[/?#]|$)') AND contains({HOST}, '.') AND NOT regexp_matches({HOST}, '(?:^|\\.)(?:localhost|local|internal)$|^[0-9.]+$') THEN regexp_extract(lower(page_url), '^\\s*(https?)://', 1) || '://' || {HOST} || CASE WHEN regexp_matches(page_url, '://[^/?#]+/') THEN '' ELSE '/' END || regexp_extract(trim(page_url), '://[^/?#]+([^#]*)', 1) END AS url FROM (SELECT DISTINCT page_url FROM bridge_assets WHERE page_url IS NOT NULL)")
def public_urls(s, root):
    return table(s, root, "bridge_assets").select("page_url").filter("page_url is not null").distinct().select("page_url", T.public_url("page_url").alias("url"))


PAGES = """n AS (SELECT DISTINCT 's:' || source_table_id AS a, 'p:' || lower(trim(pgtitle)) AS b FROM source_tables WHERE source_table_id IS NOT NULL AND pgtitle IS NOT NULL),
 pp AS (SELECT DISTINCT x.b AS a, y.b AS b FROM n x JOIN n y USING (a)), r(p, c) AS (SELECT DISTINCT b, b FROM n UNION SELECT pp.b, r.c FROM r JOIN pp ON pp.a = r.p), pc AS (SELECT p, min(c) AS c FROM r GROUP BY 1)"""


@query(f"WITH RECURSIVE {PAGES} SELECT p AS node, c AS component FROM pc UNION ALL SELECT a, min(c) FROM n JOIN pc ON p = b GROUP BY a")
def page_components(s, root):
    """Tables that share a page title or an identifier, joined over any number of steps."""
    t = table(s, root, "source_tables").filter("source_table_id is not null and pgtitle is not null").select(F.concat(F.lit("s:"), "source_table_id").alias("a"), F.concat(F.lit("p:"), F.lower(F.trim("pgtitle"))).alias("b")).distinct()
    return D.components(t)

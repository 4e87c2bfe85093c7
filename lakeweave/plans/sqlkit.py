"""Pieces of SQL that the stated equivalents share."""

from __future__ import annotations

BLANK = r"[\t-\r\x1c-\x1f \x{85}\p{Z}]+"
WIDE = "０１２３４５６７８９％．，"
NARROW = "0123456789%.,"


def one_line(x: str) -> str:
    return f"trim(regexp_replace({x}, '{BLANK}', ' ', 'g'))"


def clean(x: str) -> str:
    text = f"coalesce({x}, '')"
    for a, b in (("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "''"), ("&nbsp;", " "), ("&amp;", "&")):
        text = f"replace({text}, '{a}', '{b}')"
    return one_line(text)


def normalize(x: str) -> str:
    return f"trim(regexp_replace(lower(replace({clean(x)}, '_', ' ')), '[^\\p{{L}}\\p{{M}}\\p{{N}}_.%+\\-]+', ' ', 'g'))"


def norm(x: str) -> str:
    return f"lower({one_line(f"translate(coalesce({x}, ''), '{WIDE}‐‑‒–—−', '{NARROW}------')")})"


def number(x: str) -> str:
    t = f"lower(trim(rtrim(replace({x}, ',', ''), '%')))"
    return f"(regexp_full_match({t}, '[+-]?(?:\\d+(?:_\\d+)*\\.?(?:\\d+(?:_\\d+)*)?|\\.\\d+(?:_\\d+)*)(?:e[+-]?\\d+)?') OR regexp_full_match({t}, '[+-]?(?:nan|inf|infinity)'))"


LAKE = """lake AS (
  SELECT * EXCLUDE (rn) FROM (SELECT *, row_number() OVER (PARTITION BY source_table_id
    ORDER BY loaded_at DESC NULLS LAST, pgtitle DESC NULLS LAST, source_file DESC NULLS LAST) AS rn FROM source_tables) WHERE rn = 1
), wide AS (
  SELECT *, greatest(coalesce(num_cols, 0), coalesce(list_max([coalesce(len(r), 0) FOR r IN data]), 0), coalesce(len(title), 0)) AS w FROM lake
)"""

HEADERS = f"""{LAKE}, base AS (
  SELECT source_table_id, column_index, coalesce(nullif({clean('title[column_index + 1]')}, ''), 'col_' || column_index) AS base
  FROM (SELECT source_table_id, title, unnest(range(w)) AS column_index FROM wide WHERE data IS NOT NULL AND w > 0)
), headers AS (
  SELECT source_table_id, column_index, CASE WHEN k = 0 THEN base ELSE base || '_' || k END AS column_name FROM (
    SELECT *, row_number() OVER (PARTITION BY source_table_id, base ORDER BY column_index) - 1 AS k FROM base)
)"""

SPACES = "'category','file','help','image','portal','special','talk','template','user','wikipedia'"

CELLS = f"""{HEADERS}, raw AS (
  SELECT source_table_id, row_id, column_index, coalesce(data[row_id + 1][column_index + 1], '') AS raw FROM (
    SELECT *, unnest(range(w)) AS column_index FROM (
      SELECT source_table_id, data, w, unnest(range(len(data))) AS row_id FROM wide WHERE data IS NOT NULL AND w > 0)
  ) WHERE data[row_id + 1] IS NOT NULL
), parsed AS (
  SELECT *, {clean('raw')} AS c, regexp_full_match({clean('raw')}, '\\[[^\\]|]+(?:\\|[^\\]]+)?\\]') AS linked FROM raw
), titled AS (
  SELECT *, replace({one_line("regexp_extract(c, '^\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]$', 1)")}, '_', ' ') AS t, regexp_extract(c, '^\\[([^\\]|]+)(?:\\|([^\\]]+))?\\]$', 2) AS l FROM parsed
), cells AS (
  SELECT source_table_id, row_id, column_index, column_name, raw,
    CASE WHEN linked THEN replace({one_line("CASE WHEN l <> '' THEN l ELSE t END")}, '_', ' ') ELSE c END AS text,
    CASE WHEN linked AND NOT (contains(t, ':') AND lower(split_part(t, ':', 1)) IN ({SPACES})) THEN t END AS wiki_title,
    linked AS has_wiki_link
  FROM titled JOIN headers USING (source_table_id, column_index)
)"""

PROFILES = f"""{CELLS}, agg AS (
  SELECT source_table_id, column_index, count(*) AS n, count(*) FILTER (text <> '') AS k, count(*) FILTER (coalesce(wiki_title, '') <> '') AS linked,
    count(DISTINCT CASE WHEN text <> '' THEN text END) AS d, count(*) FILTER (text <> '' AND {number('text')}) AS num
  FROM cells GROUP BY ALL
), profiles AS (
  SELECT source_table_id, column_index, round_even(k / n, 6) AS non_empty_ratio, round_even(linked / n, 6) AS wiki_link_ratio,
    round_even(d / greatest(1, k), 6) AS unique_ratio, round_even(num / greatest(1, k), 6) AS numeric_ratio, d AS distinct_count,
    (linked / n >= 0.3 AND k / n >= 0.5 AND d / greatest(1, k) >= 0.2 AND num / greatest(1, k) < 0.5) AS is_entity
  FROM agg
)"""

ENTITY = f"""{PROFILES}, linked_rows AS (
  SELECT source_table_id, column_index, count(*) AS linked_rows FROM cells WHERE coalesce(wiki_title, '') <> '' GROUP BY ALL HAVING count(*) >= 5
), entity AS (
  SELECT source_table_id, column_index AS entity_column, linked_rows FROM (
    SELECT *, row_number() OVER (PARTITION BY source_table_id ORDER BY wiki_link_ratio DESC, column_index) AS r
    FROM profiles JOIN linked_rows USING (source_table_id, column_index) WHERE is_entity) WHERE r = 1
)"""

PAIRS = f"""{CELLS}, side AS (
  SELECT source_table_id, row_id, column_index, {normalize('text')} AS k FROM cells WHERE text <> ''
), pairs AS (
  SELECT x.source_table_id, x.row_id, x.column_index AS x_col, y.column_index AS y_col, x.k AS x, y.k AS y
  FROM side x JOIN side y ON x.source_table_id = y.source_table_id AND x.row_id = y.row_id AND x.column_index <> y.column_index
  WHERE x.k <> '' AND y.k <> ''
)"""


def kind(n: str) -> str:
    num = "[+-]?(?:0|[1-9]\\d*|[1-9]\\d{0,2}(?:,\\d{3})+)(?:\\.\\d+)?"
    return f"""CASE WHEN {n} IN ('', '-', '--', '–', '—', 'null', 'none', 'nan', 'n/a') THEN 'EMPTY' WHEN regexp_full_match({n}, '{num}') THEN 'NUMBER'
      WHEN regexp_full_match({n}, '{num}%') THEN 'PERCENT' WHEN regexp_full_match({n}, '\\d{{4}}-\\d{{2}}-\\d{{2}}') AND try_cast({n} AS DATE) IS NOT NULL THEN 'DATE'
      WHEN starts_with({n}, 'http://') OR starts_with({n}, 'https://') THEN 'URL'
      WHEN regexp_full_match({n}, '\\\\[a-z]') OR regexp_full_match({n}, 'u\\+[0-9a-f]{{4,6}}') OR NOT regexp_matches({n}, '[\\p{{L}}\\p{{N}}]') THEN 'SYMBOL'
      WHEN regexp_full_match({n}, '[+-]?\\d+(?:\\.\\d+)?') THEN 'ID' ELSE 'TEXT' END"""


def decimal(x: str) -> str:
    t = f"regexp_replace(replace({x}, ',', ''), '^\\+', '')"
    t = f"(CASE WHEN contains({t}, '.') THEN regexp_replace({t}, '\\.?0+$', '') ELSE {t} END)"
    return f"(CASE WHEN regexp_full_match({t}, '-?0*') THEN '0' ELSE {t} END)"


def key(n: str) -> str:
    """The typed key of a normalised text, null for empty ones."""
    return f"""CASE ({kind(n)}) WHEN 'EMPTY' THEN NULL WHEN 'NUMBER' THEN 'NUMBER:' || {decimal(n)} WHEN 'PERCENT' THEN 'PERCENT:' || {decimal(f"rtrim({n}, '%')")} ELSE ({kind(n)}) || ':' || {n} END"""


def with_(ctes: str, body: str) -> str:
    return f"WITH {ctes} {body}"

"""Table files: wiki-style JSON, line-delimited web tables, CSV, catalogues, pages.

All readers return rows of the shape the cell model starts from (source_table_id, source_file,
pgtitle, title, num_cols, num_rows, data); nothing is read on the driver.
"""

from __future__ import annotations

import csv
import html
import io
import itertools
import json
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urljoin, urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lakeweave.functions.text import batched, stable_json_hash

TABLE = T.StructType(
    [
        T.StructField("title", T.ArrayType(T.StringType())),
        T.StructField("pgTitle", T.StringType()),
        T.StructField("numCols", T.IntegerType()),
        T.StructField("data", T.ArrayType(T.ArrayType(T.StringType()))),
    ]
)
# Columns that never become cells, and those that name a row's entity, best first.
NO_CELLS = ("row_id", "page_url", "image")
ENTITY_NAMES = ("name", "title", "headline")


def _relative(root: str):
    return F.regexp_replace(F.input_file_name(), r"^.*?" + re.escape(root.rstrip("/").split("/")[-1]) + "/", "")


def wiki_tables(spark: SparkSession, folder: str) -> DataFrame:
    """``*.json`` files that map table ids to {title, pgTitle, numCols, data}; one row per table."""
    files = spark.read.option("wholetext", True).option("recursiveFileLookup", True).option("pathGlobFilter", "*.json").text(folder).select(_relative(folder).alias("source_file"), "value")
    each = files.select("source_file", F.explode(F.from_json("value", T.MapType(T.StringType(), TABLE))).alias("key", "t"))
    return each.select(
        F.concat(F.lit("st_"), stable_json_hash([F.col("source_file"), F.col("key")], 20)).alias("source_table_id"),
        "source_file",
        F.col("t.pgTitle").alias("pgtitle"),
        F.col("t.title").alias("title"),
        F.col("t.numCols").alias("num_cols"),
        F.size("t.data").alias("num_rows"),
        F.col("t.data").alias("data"),
    )


def json_lines(spark: SparkSession, path: str, schema: str, strict: bool = False) -> DataFrame:
    """JSON lines, plain or gzip by suffix. Strict reading fails on a line that is not an object;
    lenient reading drops it."""
    if strict:
        return spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    return spark.read.schema(schema + ", _bad string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").json(path).filter("_bad is null").drop("_bad")


def web_rows(spark: SparkSession, folder: str, max_rows: int | None = None) -> DataFrame:
    """(source_file, pos, line) of ``*.json.gz`` row files; blank and non-object lines are skipped."""
    lines = spark.read.option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz").text(folder)
    rows = lines.select(_relative(folder).alias("source_file"), F.monotonically_increasing_id().alias("at"), F.trim("value").alias("line")).filter(F.col("line").startswith("{"))
    rows = rows.withColumn("pos", F.row_number().over(Window.partitionBy("source_file").orderBy("at")) - 1).drop("at")
    return rows if max_rows is None else rows.filter(F.col("pos") < max_rows)


def web_tables(rows: DataFrame) -> DataFrame:
    """Web rows as tables: the union of keys in the order first seen, excluded keys dropped."""
    kv = rows.select("source_file", "pos", F.posexplode(F.expr("json_object_keys(line)")).alias("k", "name"), "line").filter(~F.col("name").isin(*NO_CELLS))
    names = kv.groupBy("source_file", "name").agg(F.min(F.struct("pos", "k")).alias("first"))
    header = names.groupBy("source_file").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "name"))), lambda x: x["name"]).alias("title"))
    parsed = rows.join(header, "source_file").select("source_file", "pos", "title", F.from_json("line", "map<string,string>").alias("m"))
    cells = parsed.select("source_file", "pos", "title", F.transform("title", lambda n: F.coalesce(F.element_at("m", n), F.lit(""))).alias("row"))
    data = cells.groupBy("source_file", "title").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", "row"))), lambda x: x["row"]).alias("data"))
    kind = F.split("source_file", "/")[0]
    return data.select(
        F.concat(F.lit("st_web_"), stable_json_hash([kind, F.col("source_file")], 16)).alias("source_table_id"),
        "source_file",
        F.lit(None).cast("string").alias("pgtitle"),
        "title",
        F.size("title").alias("num_cols"),
        F.size("data").alias("num_rows"),
        "data",
    )


def entity_column(tables: DataFrame) -> DataFrame:
    """(source_table_id, entity_column): the best of the known entity names, null without one."""
    at = F.coalesce(*[F.nullif(F.array_position("title", n), F.lit(0)) for n in ENTITY_NAMES]) - 1
    return tables.select("source_table_id", at.cast("int").alias("entity_column"))


def csv_tables(spark: SparkSession, folder: str, max_rows: int = 0) -> DataFrame:
    """CSV files as tables: UTF-8 with or without a mark, else Latin-1; blank headers are named later.
    All rows are read, unless ``max_rows`` is above 0."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(folder).select("path", "content")
    schema = "source_table_id string, source_file string, pgtitle string, title array<string>, num_cols int, num_rows int, data array<array<string>>"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"].tolist(), pdf["content"].tolist(), strict=True):
                try:
                    text = content.decode("utf-8-sig")
                except UnicodeDecodeError:
                    text = content.decode("latin-1")
                lines = list(itertools.islice(csv.reader(io.StringIO(text)), max_rows + 1 if max_rows > 0 else None))
                head, data = (lines[0], lines[1:]) if lines else ([], [])
                name = path.rsplit("/", 1)[-1]
                out.append((name.removesuffix(".csv"), name, None, head, len(head), len(data), data))
            yield pd.DataFrame(out, columns=["source_table_id", "source_file", "pgtitle", "title", "num_cols", "num_rows", "data"], dtype=object)

    return files.mapInPandas(run, schema)


def catalogue(spark: SparkSession, folder: str) -> DataFrame:
    """(kind, subset, host, n_rows, n_cols) of ``*_statistics.zip`` archives, else of the row files
    themselves with the subset "unstratified"."""
    schema = "kind string, subset string, host string, n_rows long, n_cols long"
    zips = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*_statistics.zip").load(folder).select("path", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for path, content in zip(pdf["path"].tolist(), pdf["content"].tolist(), strict=True):
                kind = path.rsplit("/", 1)[-1].removesuffix("_statistics.zip")
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    for member in z.namelist():
                        subset = re.search(r"_(top100|minimum3|rest)\.csv$", member)
                        if subset:
                            for row in csv.DictReader(io.TextIOWrapper(z.open(member), "utf-8")):
                                if " ".join((row.get("host") or "").split()):
                                    out.append((kind, subset[1], " ".join(row["host"].split()), int(row["number_of_rows"]), int(row["column_count"])))
            yield pd.DataFrame(out, columns=["kind", "subset", "host", "n_rows", "n_cols"], dtype=object)

    found = zips.mapInPandas(run, schema)
    if not zips.limit(1).count():
        files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.json.gz").load(folder).select("path")
        kind = F.element_at(F.split("path", "/"), -2)
        host = F.regexp_replace(F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.json\.gz$", ""), r"^[^_]*_|_[A-Z][a-z]+\d{4}$", "")
        found = files.select(kind.alias("kind"), F.lit("unstratified").alias("subset"), host.alias("host"), F.lit(None).cast("long").alias("n_rows"), F.lit(None).cast("long").alias("n_cols"))
    return found


class _Page(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.text: list[str] = []
        self.images: list[str] = []
        self.blocks: list[str] = []
        self.quiet, self.ld = 0, None

    def handle_starttag(self, tag, attrs):
        a = dict(attrs)
        if tag in ("script", "style", "noscript"):
            self.quiet += 1
            self.ld = [] if tag == "script" and (a.get("type") or "").lower() == "application/ld+json" else None
        if tag == "img" and a.get("src"):
            self.images.append(a["src"])

    def handle_endtag(self, tag):
        if tag in ("script", "style", "noscript") and self.quiet:
            self.quiet -= 1
            if self.ld is not None:
                self.blocks.append("".join(self.ld))
                self.ld = None

    def handle_data(self, data):
        if self.ld is not None:
            self.ld.append(data)
        elif not self.quiet:
            self.text.append(data)


def _page(source: str) -> _Page:
    p = _Page()
    p.feed(source)
    return p


page_text = batched(lambda x: " ".join(" ".join(_page(x).text).split()))


def _ld(source: str) -> list[str]:
    out = []
    for block in _page(source).blocks:
        try:
            value = json.loads(html.unescape(block) if "&quot;" in block else block)
        except ValueError:
            continue
        out += [json.dumps(v, ensure_ascii=False, sort_keys=True) for v in (value if isinstance(value, list) else [value]) if isinstance(v, dict)]
    return out


json_ld = batched(_ld, T.ArrayType(T.StringType()))


def _image_urls(value, base: str) -> list[str]:
    out: list[str] = []
    todo = [value]
    while todo:
        v = todo.pop(0)
        if isinstance(v, dict):
            todo = [*v.values(), *todo]
        elif isinstance(v, list):
            todo = [*v, *todo]
        elif isinstance(v, str) and v.strip() and not re.search(r"\s", v.strip()):
            try:
                u = urljoin(base, html.unescape(v.strip()))
                ok = urlsplit(u).scheme.lower() in ("http", "https") and urlsplit(u).hostname
            except ValueError:
                continue
            if ok and u not in out:
                out.append(u)
    return out


@F.pandas_udf(T.ArrayType(T.StringType()))
def nested_image_urls(value: pd.Series, base: pd.Series) -> pd.Series:
    """Absolute http(s) URLs anywhere in a JSON value, in the order first seen."""

    def read(x):
        try:
            return json.loads(x)
        except (TypeError, ValueError):
            return x

    return pd.Series([_image_urls(read(v), b if isinstance(b, str) else "") if isinstance(v, str) else [] for v, b in zip(value.tolist(), base.tolist(), strict=True)], dtype=object)

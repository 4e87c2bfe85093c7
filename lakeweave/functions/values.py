"""Typed cell values: the key under which two cells are compared."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lakeweave.functions.text import NO_VALUE, norm

NUMBER = r"^[+-]?(?:0|[1-9]\d*|[1-9]\d{0,2}(?:,\d{3})+)(?:\.\d+)?%?$"


def decimal_text(c: Column) -> Column:
    """A decimal without grouping, plus sign and closing zeros; zero of any sign is 0."""
    t = F.regexp_replace(c, r"[,+]|^(?<![\d.])0+(?=\d)", "")
    t = F.regexp_replace(t, r"\.0*$|(\.\d*[1-9])0+$", "$1")
    return F.regexp_replace(t, r"^-0$", "0")


def digit_tokens(n: Column) -> Column:
    return F.transform(F.regexp_extract_all(n, F.lit(r"\d+(?:\.\d+)?"), F.lit(0)), decimal_text)


def kind_of(n: Column) -> Column:
    """EMPTY, NUMBER, PERCENT, DATE, URL, SYMBOL, ID or TEXT of a normalised text."""
    return (
        F.when(n.isin(*NO_VALUE), "EMPTY")
        .when(n.rlike(NUMBER), F.when(n.endswith("%"), "PERCENT").otherwise("NUMBER"))
        .when(n.rlike(r"^\d{4}-\d{2}-\d{2}$") & F.try_to_timestamp(n, F.lit("yyyy-MM-dd")).isNotNull(), "DATE")
        .when(n.startswith("http://") | n.startswith("https://"), "URL")
        .when(n.rlike(r"^(?:\\[a-z]|u\+[0-9a-f]{4,6}|[^\p{L}\p{N}]*)$"), "SYMBOL")
        .when(n.rlike(r"^[+-]?\d+(?:\.\d+)?$"), "ID")
        .otherwise("TEXT")
    )


def with_value(df: DataFrame, raw: str, prefix: str = "v", empty: bool = True, urls: bool = True) -> DataFrame:
    """Adds ``v_kind``, ``v_text``, ``v_key`` (null exactly for empty cells) and ``v_digits``.

    Each step is a projection of its own: every column is used several times by the next one, so
    the optimizer keeps them apart and the generated code stays small. Rows without a value
    (``empty``) or with a URL (``urls``) are left out on the normalised text itself; a filter on the
    derived columns would be pushed down with their whole definition.
    """
    n, kind, body = F.col(f"{prefix}_n"), F.col(f"{prefix}_kind"), F.col(f"{prefix}_body")
    out = df.withColumn(f"{prefix}_n", norm(raw))
    if not empty:
        out = out.filter(~n.isin(*NO_VALUE))
    if not urls:
        out = out.filter(~n.startswith("http://") & ~n.startswith("https://"))
    out = out.withColumn(f"{prefix}_kind", kind_of(n))
    out = out.withColumn(f"{prefix}_body", F.when(kind.isin("NUMBER", "PERCENT"), decimal_text(F.rtrim(n, F.lit("%")))).otherwise(n))
    digits = F.when(kind.isin("NUMBER", "PERCENT"), F.array(body)).when(kind == "TEXT", digit_tokens(n)).otherwise(F.array().cast("array<string>"))
    return out.withColumns(
        {
            f"{prefix}_key": F.when(kind != "EMPTY", F.concat_ws(":", kind, body)) if empty else F.concat_ws(":", kind, body),
            f"{prefix}_text": F.when(kind == "PERCENT", F.concat(body, F.lit("%"))).otherwise(body),
            f"{prefix}_digits": digits,
        }
    ).drop(f"{prefix}_n", f"{prefix}_body")


def parsed_answer(raw: Column) -> Column:
    """struct(status, value) of a one-string JSON answer, possibly inside one code fence."""
    t = F.trim(F.regexp_replace(F.regexp_replace(raw, r"(?U)^\s+|\s+$", ""), "^﻿", ""))
    fence = r"(?is)^```(?:json)?\s*\n?(.*?)\n?```$"
    t = F.trim(F.when(t.rlike(fence), F.regexp_extract(t, fence, 1)).otherwise(t))
    value = F.when(t.rlike(r'(?s)^".*"$'), F.from_json(F.concat(F.lit('{"v":'), t, F.lit("}")), "v string")["v"])
    nothing = norm(value).isin(*NO_VALUE)
    status = F.when(t == "null", "INSUFFICIENT_EVIDENCE").when(value.isNull() | (F.trim(value) == ""), "PARSE_ERROR").when(nothing, "NORMALIZED_EMPTY").otherwise("VALUE")
    return F.struct(status.alias("status"), F.when(status == "VALUE", value).alias("value"))

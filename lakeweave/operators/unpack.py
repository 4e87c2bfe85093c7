"""Several values packed in one field, split into one row per value with its position.

The field is read by a parsing expression grammar with ordered alternatives:

    field    <- blank* (list / packed) blank*
    list     <- '[' item (',' item)* ']'
    packed   <- slot (strong slot)*
    slot     <- quoted / bare
    quoted   <- '"' ('\\"' / '""' / !'"' .)* '"'      or the same with "'"
    bare     <- names, a comma list in which conjunctions may stand
    names    <- name ((',' conj? / conj) name)*
    name     <- family ',' given / plain (',' suffix)?

An alternative that fails gives back what it read: a quote that never closes, or that does not
stand at the borders of a slot, is read again as a plain character and the value is flagged.
"""

from __future__ import annotations

import html
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Placeholders that stand for no author, and suffixes that belong to a name.
PLACEHOLDERS = frozenset(["", "-", "--", "---", "n/a", "na", "n.a.", "none", "null", "nil", "unknown", "unknown author", "author unknown", "anon", "anon.", "anonymous", "not stated", "no author", "various", "various authors", "?", "tbd", "et al", "et al.", "and others", "[unknown]", "(unknown)"])
SUFFIXES = frozenset(["jr", "sr", "ii", "iii", "iv", "phd", "ph.d", "md", "m.d", "esq"])

STRONG = ";；|\n\r\t·、•¦"
SLASH = regex.compile(r"\s/\s|(?<=\p{L}{2})/(?=\p{Lu}\p{L})|(?<=\.)/(?=\p{Lu})|(?<=\s)/(?=\S)|(?<=\S)/(?=\s)")
CONJ = regex.compile(r"\s+(?:&|and|und|et)\s+", regex.I)
LEADING_CONJ = regex.compile(r"^(?:&|and|und|et)\s+", regex.I)
GIVEN = regex.compile(r"^[\p{L}\p{M}'’\-]+\.?(?:\s+\p{L}\.?(?:-\p{L}\.?)?)*(?:\s*\([^()]*\))?$|^(?:\p{L}\.[\s\-]*)+(?:\s*\([^()]*\))?$|^\p{L}(?:\s\p{L})*(?:\s*\([^()]*\))?$")
FIRM = regex.compile(r"^(?:sons?|daughters?|daughtres|brothers|bros|partners|company|co|associates|cie)\b", regex.I)
LINKS = regex.compile(r"\b(?:on|of|for|für|de)\b", regex.I)


class Value(NamedTuple):
    text: str
    kind: str
    flag: str


def is_placeholder(text: str) -> bool:
    return text.strip().lower() in PLACEHOLDERS


def _quoted(s: str, at: int) -> tuple[str, int] | None:
    """quoted, from ``at``; None if the quote never closes."""
    mark, k, out = s[at], at + 1, []
    while k < len(s):
        c = s[k]
        if c == "\\" and k + 1 < len(s):
            out.append(s[k + 1])
            k += 2
        elif c == mark and mark == '"' and s[k + 1 : k + 2] == mark:
            out.append(mark)
            k += 2
        elif c == mark:
            return "".join(out), k + 1
        else:
            out.append(c)
            k += 1
    return None


def _list(s: str) -> list[Value] | None:
    """list over the whole field, or None."""
    if not (s.startswith("[") and s.endswith("]")):
        return None
    out, k, end = [], 1, len(s) - 1
    while True:
        while k < end and s[k].isspace():
            k += 1
        if k >= end:
            return out
        if s[k] in "\"'":
            got = _quoted(s[:end], k)
            if got is None:
                return None
            text, k = got
            kind = "bracketed"
        else:
            stop = s.find(",", k, end)
            stop = end if stop < 0 else stop
            text, k, kind = s[k:stop], stop, "bare"
        out.append(Value(text.strip(), kind, ""))
        while k < end and s[k].isspace():
            k += 1
        if k < end:
            if s[k] != ",":
                return None
            k += 1


def _slots(s: str) -> list[tuple[str, bool, str, bool]]:
    """packed: (text, was quoted, flag, a comma closed it); strong separators and quotes decide."""
    out: list[tuple[str, bool, str]] = []
    k, begin, flag, n = 0, 0, "", len(s)
    while k <= n:
        opens = k < n and s[k] in "\"“" and not s[begin:k].strip()
        if opens:
            mark_end = _quoted(s, k) if s[k] == '"' else ((s[k + 1 : e], e + 1) if (e := s.find("”", k)) > 0 else None)
            if mark_end is None:
                flag = "unclosed quote"
            else:
                text, after = mark_end
                m = after
                while m < n and s[m] in " \xa0":
                    m += 1
                if m == n or s[m] in STRONG or s[m] == ",":
                    out.append((text, True, ""))
                    k = begin = m + 1
                    flag = ""
                    continue
                flag = "quote inside value" if not CONJ.match(s, after) else flag
        if k == n or s[k] in STRONG:
            out.append((s[begin:k], False, flag))
            begin, flag = k + 1, ""
        k += 1
    return out


def _names(s: str) -> list[tuple[str, str]]:
    """names: (author as written, flag) of one bare stretch."""
    body = LEADING_CONJ.sub("", s.strip(" \xa0,"))
    parts, links = CONJ.split(body), [m.group() for m in CONJ.finditer(body)]
    k = 0
    while len(parts) > 1 and k < len(parts):
        pieces = [x.strip() for x in parts[k].strip(" ,").split(",")]
        first = len(pieces[0].split()) < 2 and (len(pieces) == 1 or not GIVEN.match(pieces[1]))
        last = len(pieces[-1].split()) < 2 and (len(pieces) == 1 or len(pieces[-2].split()) > 1) and pieces[-1].rstrip(".").lower() not in SUFFIXES
        firm = FIRM.match(pieces[0]) is not None
        if k > 0 and (firm or (first and (k == len(parts) - 1 or LINKS.search(parts[k - 1]) is not None))):
            parts[k - 1 : k + 1] = [parts[k - 1] + links.pop(k - 1) + parts[k]]
            k = max(0, k - 1)
        elif last and k + 1 < len(parts):
            parts[k : k + 2] = [parts[k] + links.pop(k) + parts[k + 1]]
        else:
            k += 1
    out: list[tuple[str, str]] = []
    for part in parts:
        raw = part.split(",")
        pieces = [LEADING_CONJ.sub("", x.strip()) for x in raw]
        k = 0
        while k < len(pieces):
            p = pieces[k]
            nxt = pieces[k + 1] if k + 1 < len(pieces) else None
            if not p:
                k += 1
                continue
            n = 1
            if len(p.split()) == 1 and nxt and GIVEN.match(nxt) and nxt.rstrip(".").lower() not in SUFFIXES:
                n = 2
            if k + n < len(pieces) and pieces[k + n].rstrip(".").lower() in SUFFIXES:
                n += 1
            flag = "lone word" if n == 1 and len(p.split()) == 1 and len(pieces) > 1 else ""
            out.append((LEADING_CONJ.sub("", ",".join(raw[k : k + n]).strip()), flag))
            k += n
    return out


def parse_packed(field: str | None) -> list[Value]:
    """Values of one field in the order written; empty slots and placeholders are left out."""
    if field is None or is_placeholder(field):
        return []
    s = field.strip()
    got = _list(s)
    if got is None:
        s = html.unescape(s).strip()
        for m in reversed(list(SLASH.finditer(s))):
            if s[max(0, m.start() - 1) : m.end() + 1].lower() != "n/a":
                s = s[: m.start()] + ";" + s[m.end() :]
        got = []
        for text, quoted, flag in _slots(s):
            if quoted:
                got.append(Value(text.strip(), "quoted", flag))
            elif text.strip():
                got.extend(Value(t, "bare", flag or f) for t, f in _names(text))
    else:
        got = [Value(html.unescape(v.text).strip(), v.kind, v.flag) for v in got]
    return [v for v in got if not is_placeholder(v.text)]


def unpack(df: DataFrame, field: str, keys: tuple[str, ...], out: str = "value") -> DataFrame:
    """``keys``, ``pos`` (from 1), ``out``, ``n_values``, ``kind`` and ``flag``: one row per value.

    A map over partitions without a shuffle. Null, blank and placeholder fields give no rows.
    Repeated input rows give repeated output rows. Extra columns are not read.
    """
    slim = df.select(*[F.col(k) for k in keys], F.col(field).alias("__field")).filter(F.col("__field").isNotNull())
    schema = T.StructType([*[slim.schema[k] for k in keys], T.StructField("pos", T.IntegerType()), T.StructField(out, T.StringType()), T.StructField("n_values", T.IntegerType()), T.StructField("kind", T.StringType()), T.StructField("flag", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            parsed = [parse_packed(f) for f in pdf["__field"]]
            owners = list(zip(*[pdf[k].tolist() for k in keys], strict=True))
            rows = [(*own, k + 1, v.text, len(p), v.kind, v.flag) for own, p in zip(owners, parsed, strict=True) for k, v in enumerate(p)]
            yield pd.DataFrame(rows, columns=[*keys, "pos", out, "n_values", "kind", "flag"])

    return slim.mapInPandas(run, schema)


def latest_field(df: DataFrame, key: str, field: str, at: str) -> DataFrame:
    """One row per key: the field of the latest delivery (map-side combined, no window)."""
    order = F.struct(F.col(at), F.col(field))
    return df.filter(F.col(key).isNotNull()).groupBy(key).agg(F.max(order).getField(field).alias(field))


def packed_authors(listings: DataFrame) -> DataFrame:
    """(listing_id, pos, author) of every listing that names two or more authors."""
    single = latest_field(listings, "listing_id", "authors", "loaded_at")
    return unpack(single, "authors", ("listing_id",), "author").filter("n_values >= 2").select("listing_id", "pos", "author")

"""String functions. Plain ASCII stays in generated JVM code; only values that need Unicode tables
or entity tables go through an Arrow batch, where every other row travels as a null."""

from __future__ import annotations

import html
import json
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

BLANKS = r"(?U)\s+"
DASHES = str.maketrans(dict.fromkeys("‐‑‒–—−", "-"))
# Texts that count as no value, headers that say nothing, months of the year.
NO_VALUE = ("", "-", "--", "–", "—", "null", "none", "nan", "n/a")
EMPTY_HEADERS = ("no", "no.", "#", "rank", "index", "ref", "reference", "note", "notes", "remarks", "source")
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def batched(function, returns: T.DataType | None = None):
    """A pandas UDF of a function on one value; nulls stay null."""

    @F.pandas_udf(returns or T.StringType())
    def run(s: pd.Series) -> pd.Series:
        return pd.Series([None if x is None or x is pd.NA or (isinstance(x, float) and x != x) else function(x) for x in s.tolist()], dtype=object)

    return run


def split_path(c: Column, fast: Column, needs: Column, slow) -> Column:
    """``fast`` where ``needs`` is false, else the batched function; its input is null elsewhere."""
    return F.when(needs, slow(F.when(needs, c))).otherwise(fast)


def one_line(c: Column | str) -> Column:
    """Blanks of any kind collapsed to one space, none at the ends."""
    return F.trim(F.regexp_replace(_col(c), BLANKS, " "))


def beyond_ascii(c: Column) -> Column:
    return c.rlike(r"[^\x00-\x7F]")


_clean = batched(lambda x: " ".join(html.unescape(x).replace("\xa0", " ").split()))


def clean_text(c: Column | str) -> Column:
    """Entities read, blanks collapsed; null becomes the empty text."""
    c = _col(c)
    return F.coalesce(split_path(c, one_line(c), c.contains("&"), _clean), F.lit(""))


_clean_each = batched(lambda xs: [None if x is None else " ".join(html.unescape(x).replace("\xa0", " ").split()) for x in xs], T.ArrayType(T.StringType()))


def clean_each(c: Column | str) -> Column:
    """``clean_text`` of every text of an array; nulls in it stay null."""
    c = _col(c)
    return split_path(c, F.transform(c, lambda x: one_line(x)), F.exists(c, lambda x: F.coalesce(x.contains("&"), F.lit(False))), _clean_each)


_normal = batched(lambda x: " ".join(re.sub(r"[^\w.%+-]+", " ", " ".join(html.unescape(x).replace("\xa0", " ").split()).casefold().replace("_", " ")).split()))


def normalize(c: Column | str) -> Column:
    """Case-folded words with ``.%+-`` kept, underscores as blanks; null becomes the empty text."""
    c = _col(c)
    fast = F.trim(F.regexp_replace(F.lower(F.replace(c, F.lit("_"), F.lit(" "))), r"[^a-z0-9.%+\-]+", " "))
    return F.coalesce(split_path(c, fast, c.contains("&") | beyond_ascii(c), _normal), F.lit(""))


_norm = batched(lambda x: " ".join(unicodedata.normalize("NFKC", x).translate(DASHES).split()).casefold())


def norm(c: Column | str) -> Column:
    """NFKC, one kind of dash, collapsed blanks, case-folded; null becomes the empty text."""
    c = _col(c)
    return F.coalesce(split_path(c, F.lower(one_line(c)), beyond_ascii(c), _norm), F.lit(""))


def cell_text(c: Column | str, longest: int = 1024) -> Column:
    """Cleaned text cut to ``longest`` code points."""
    return F.rtrim(F.substring(clean_text(c), 1, longest))


_fold = batched(lambda x: " ".join(html.unescape(x).casefold().split()))


def fold(c: Column | str) -> Column:
    return F.coalesce(split_path(_col(c), F.lower(one_line(c)), _col(c).contains("&") | beyond_ascii(_col(c)), _fold), F.lit(""))


_nfkc = batched(lambda x: unicodedata.normalize("NFKC", x).casefold())


def folded(c: Column | str) -> Column:
    """NFKC, case-folded; null stays null."""
    c = _col(c)
    return split_path(c, F.lower(c), beyond_ascii(c), _nfkc)


def word_key(c: Column) -> Column:
    """Words of a folded text without apostrophes, one blank between them; usable inside lambdas."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "['’]", ""), r"[^\p{L}\p{N}]+", " "))


def text_key(c: Column | str) -> Column:
    """Words only, NFKC and case-folded, apostrophes dropped; null becomes the empty text."""
    return F.coalesce(word_key(folded(c)), F.lit(""))


_gate = batched(lambda x: " ".join(re.findall(r"[^\W_]+", "".join(ch for ch in unicodedata.normalize("NFKD", __import__("urllib.parse").parse.unquote(x)) if not unicodedata.combining(ch)).casefold())))


def gate_norm(c: Column | str) -> Column:
    """Percent-decoded, without accents, words only."""
    c = _col(c)
    fast = F.trim(F.regexp_replace(F.lower(c), r"[^a-z0-9]+", " "))
    return F.coalesce(split_path(c, fast, beyond_ascii(c) | c.contains("%"), _gate), F.lit(""))


def is_number(c: Column | str) -> Column:
    """What a float parser accepts after commas and a closing percent sign are dropped."""
    t = F.rtrim(F.replace(_col(c), F.lit(","), F.lit("")), F.lit("%"))
    t = F.lower(F.trim(t))
    return t.rlike(r"^[+-]?(?:\d+(?:_\d+)*\.?(?:\d+(?:_\d+)*)?|\.\d+(?:_\d+)*)(?:e[+-]?\d+)?$") | t.rlike(r"^[+-]?(?:nan|inf|infinity)$")


def values_match(a: Column | str, b: Column | str) -> Column:
    """Equal after normalising, close as numbers, or one contained in the other from four characters on."""
    x, y = normalize(a), normalize(b)
    nx, ny = (F.when(is_number(v), F.replace(v, F.lit(","), F.lit("")).try_cast("double")) for v in (x, y))
    close = F.abs(nx - ny) <= 1e-9 * F.greatest(F.abs(nx), F.abs(ny))
    inside = (F.least(F.length(x), F.length(y)) >= 4) & (x.contains(y) | y.contains(x))
    both = nx.isNotNull() & ny.isNotNull()
    return (x != "") & (y != "") & ((x == y) | F.when(both, close).otherwise(inside))


def as_float(c: Column | str) -> Column:
    return F.regexp_extract(F.replace(_col(c), F.lit(","), F.lit("")), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def as_year(c: Column | str) -> Column:
    return F.nullif(F.regexp_extract(_col(c).cast("string"), r"\b(1[0-9]{3}|20[0-9]{2})\b", 1), F.lit("")).cast("int")


def iso_date(c: Column | str) -> Column:
    """``Month D, YYYY`` at the begin, as ISO text; the day is not checked against the month."""
    c = _col(c)
    pattern = r"(?i)^\s*(" + "|".join(MONTHS) + r")\s+(\d{1,2}),\s*(\d{4})"
    month = F.array_position(F.array(*[F.lit(m) for m in MONTHS]), F.lower(F.regexp_extract(c, pattern, 1)))
    return F.when(c.rlike(pattern), F.format_string("%s-%02d-%02d", F.regexp_extract(c, pattern, 3), month, F.regexp_extract(c, pattern, 2).cast("int")))


def percent_encode(c: Column | str) -> Column:
    """As a URL path: unreserved characters and ``/`` stay, a blank is %20."""
    out = F.url_encode(_col(c))
    for a, b in (("+", "%20"), ("%2F", "/"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def bare_url(c: Column | str) -> Column:
    """Lower-case scheme and host, path without a closing slash; query and fragment dropped."""
    c = _col(c)
    p = r"^([A-Za-z][A-Za-z0-9+.\-]*)://([^/?#]*)([^?#]*)"
    return F.when(c.rlike(p), F.concat(F.lower(F.regexp_extract(c, p, 1)), F.lit("://"), F.lower(F.regexp_extract(c, p, 2)), F.rtrim(F.regexp_extract(c, p, 3), F.lit("/"))))


def _public(x: str) -> str | None:
    import ipaddress
    from urllib.parse import urlsplit, urlunsplit

    try:
        u = urlsplit(x.strip())
        host = (u.hostname or "").rstrip(".").encode("idna").decode("ascii").lower()
        port = u.port
    except (ValueError, UnicodeError):
        return None
    if u.scheme.lower() not in ("http", "https") or not host or u.username or u.password or host == "localhost" or host.endswith((".localhost", ".local", ".internal")):
        return None
    try:
        if not ipaddress.ip_address(host).is_global:
            return None
    except ValueError:
        if "." not in host:
            return None
    default = {"http": 80, "https": 443}[u.scheme.lower()]
    place = host if port in (None, default) else f"{host}:{port}"
    return urlunsplit((u.scheme.lower(), place, u.path or "/", u.query, ""))


public_url = batched(_public)


def stable_json_hash(parts: list[Column], length: int = 16) -> Column:
    """SHA-1 of the parts as a JSON list with ``", "`` between them, cut to ``length`` digits."""
    texts = [F.regexp_replace(F.to_json(F.array(p)), r"^\[|\]$", "") for p in parts]
    return F.substring(F.sha1(F.concat(F.lit("["), F.concat_ws(", ", *texts), F.lit("]"))), 1, length)


# What parts paragraphs, and sentences inside one that is too long.
PARAGRAPH_GAP = re.compile(r"(?:\r?\n){2,}")
SENTENCE_GAP = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(\[])")


def _wrapped(sentence: str, longest: int):
    """A sentence cut at blanks; where the last blank is in the first half, at the limit."""
    while len(sentence) > longest:
        cut = sentence.rfind(" ", 0, longest + 1)
        cut = longest if cut < max(1, longest // 2) else cut
        yield sentence[:cut].strip()
        sentence = sentence[cut:].strip()
    yield sentence


def _pieces(text: str, longest: int, most: int) -> list[str]:
    out: list[str] = []
    for paragraph in PARAGRAPH_GAP.split(html.unescape(text)):
        p = " ".join(paragraph.split())
        for unit in [p] if len(p) <= longest else (w for s in SENTENCE_GAP.split(p) for w in _wrapped(s, longest)):
            if not unit:
                continue
            if out and len(out[-1]) + 1 + len(unit) <= longest:
                out[-1] += " " + unit
            else:
                out.append(unit)
    return out[:most] if most > 0 else out


def chunks(longest: int = 800, most: int = 0):
    """Paragraphs packed in order into chunks of at most ``longest`` characters; only a paragraph that
    is too long is cut into sentences, and only such a sentence at blanks. ``most`` 0 keeps all."""
    return batched(lambda x: _pieces(x, max(1, longest), most), T.ArrayType(T.StringType()))


first_json_object = batched(lambda x: _first_json(x))


def _first_json(x: str) -> str | None:
    decoder, at = json.JSONDecoder(), x.find("{")
    while at >= 0:
        try:
            value, _ = decoder.raw_decode(x, at)
        except ValueError:
            at = x.find("{", at + 1)
            continue
        return json.dumps(value, ensure_ascii=False, sort_keys=True)
    return None

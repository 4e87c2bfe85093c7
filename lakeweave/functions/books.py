"""Functions on book records: numbers, names, titles, publishers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lakeweave.functions.text import bare_url, clean_text, folded, normalize, one_line, stable_json_hash, text_key, word_key

# What stands for no author and no publisher, words that qualify a name, and publishers'
# brands with the pattern that tells each; imprints stand before their houses.
NO_AUTHOR = ("", "-", "--", "0", "none", "null", "n/a", "unknown")
NO_PUBLISHER = ("", "0", "na", "none", "null", "unknown")
QUALIFIERS = "and|ed|eds|editor|jr|sr"
LIST_QUALIFIERS = "editor|edited|eds|professor|et al"
BRANDS = (
    ("morgankaufman+n?", "morgankaufmann"),
    ("addisonwesley", "addisonwesley"),
    ("butterworthheinemann", "butterworthheinemann"),
    ("academicpr(?:ess)?(?:inc)?", "academicpress"),
    ("digitalpr(?:ess)?", "digitalpress"),
    ("prenticehall", "prenticehall"),
    ("osborne", "osborne"),
    ("irwin", "irwin"),
    ("newnes", "newnes"),
    ("routledge", "routledge"),
    ("crcpress", "crcpress"),
    ("taylor(?:and)?francis", "taylorfrancis"),
    ("pearson", "pearson"),
    ("elsevier", "elsevier"),
    ("mcgrawhill", "mcgrawhill"),
    ("emerald", "emerald"),
)
ORDINALS = "first|second|third|fourth|fifth|sixth|seventh|eighth|ninth|tenth"
TITLE_STOPS = ("the", "a", "an", "of", "for", "and", "to", "with", "in", "on")

TURNED = r"^(\p{L}+(?:[-'’]\p{L}+)*),\s*([\p{L}\p{N}_ .'-]+)$"
PLAIN_PIECE = r"^[\p{L} .'’-]+$"


def isbn13(c: Column) -> Column:
    """A valid ISBN-13, converted from a valid ISBN-10 where need be; null otherwise."""
    s = F.regexp_replace(F.upper(c), r"[^0-9X]", "")

    def digit(i: int) -> Column:
        ch = F.substring(s, i, 1)
        return F.when(ch == "X", 10).otherwise(ch.try_cast("int"))

    sum13 = sum((digit(i) * (1 if i % 2 else 3) for i in range(1, 14)), F.lit(0))
    sum10 = sum((digit(i) * (11 - i) for i in range(1, 11)), F.lit(0))
    head = sum(((1, 3)[i % 2] * int("978"[i]) for i in range(3)))
    body = F.lit(head) + sum((digit(k + 1) * (3 if k % 2 == 0 else 1) for k in range(9)), F.lit(0))
    check = (10 - body % 10) % 10
    return F.when(s.rlike(r"^[0-9]{13}$") & (sum13 % 10 == 0), s).when(s.rlike(r"^[0-9]{9}[0-9X]$") & (sum10 % 11 == 0), F.concat(F.lit("978"), F.substring(s, 1, 9), check.cast("string")))


def _strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def _says(c: Column, words: str) -> Column:
    return c.rlike(rf"(?iU)\b(?:{words})\b")


def author_key(c: Column) -> Column:
    """A conservative key of an authors field: entries between semicolons, a plain ``Family, Given``
    turned, words only. Lists between commas keep their order. Placeholders and null give ""."""
    text = _strip(folded(c))

    def turned(part: Column) -> Column:
        bare = _strip(part)
        return F.when(bare.rlike(TURNED) & ~_says(part, QUALIFIERS), F.regexp_replace(bare, TURNED, "$2 $1")).otherwise(part)

    key = word_key(F.array_join(F.transform(F.split(text, ";"), turned), "; "))
    return F.when(text.isNull() | text.isin(*NO_AUTHOR), "").otherwise(key)


def author_names(c: Column) -> Column:
    """The sorted keys of an explicit list of authors; empty where the list cannot be told apart,
    holds an editor's or professor's note, a single word, a digit or one name twice."""
    text = F.regexp_replace(_strip(folded(c)), r":+$", "")
    members = F.split(text, r"(?U)\s*;\s*|\s+(?:and|et)\s+|\s*&\s*")
    words = lambda x: F.when(word_key(x) == "", 0).otherwise(F.size(F.split(word_key(x), " ")))

    def names(member: Column) -> Column:
        pieces = F.transform(F.split(member, ","), _strip)
        heads = F.filter(pieces, lambda _, i: i % 2 == 0)
        pairs = F.transform(heads, lambda x, i: F.concat_ws(" ", F.get(pieces, i * 2 + 1), x))
        in_turn = (F.size(pieces) % 2 == 0) & F.forall(heads, lambda x: words(x) == 1)
        plain = (F.size(pieces) == 1) | F.forall(pieces, lambda x: words(x) >= 2)
        return F.when(F.exists(pieces, lambda x: x == ""), None).when(in_turn, pairs).when(plain, pieces)

    found = F.transform(members, names)
    keys = F.transform(F.flatten(found), word_key)
    bad = F.exists(found, lambda x: x.isNull()) | F.exists(keys, lambda k: ~k.contains(" ") | k.rlike(r"\p{Nd}")) | (F.size(F.array_distinct(keys)) != F.size(keys))
    return F.when(text.isNull() | _says(text, LIST_QUALIFIERS) | F.coalesce(bad, F.lit(True)), F.array().cast("array<string>")).otherwise(F.array_sort(keys))


def matching_key(c: Column) -> Column:
    """The author names as one text; "" where there are none."""
    return F.array_join(author_names(c), " | ")


def natural_names(c: Column) -> Column:
    """Entries ``Family, Given`` between semicolons turned, where both parts are plain names without a
    qualifier; a field in which nothing is turned stays as it is."""
    parts = F.split(c, ";")

    def pieces(part: Column) -> Column:
        return F.transform(F.split(part, ","), _strip)

    def clear(part: Column) -> Column:
        return (F.size(F.split(part, ",")) == 2) & F.forall(pieces(part), lambda x: x.rlike(PLAIN_PIECE)) & ~_says(part, f"{QUALIFIERS}|et al")

    turned = F.transform(parts, lambda p: F.when(clear(p), F.concat_ws(" ", F.get(pieces(p), F.lit(1)), F.get(pieces(p), F.lit(0)))).otherwise(_strip(p)))
    return F.when(F.exists(parts, clear), F.array_join(turned, "; ")).otherwise(c)


def without_series(c: Column) -> Column:
    """A title without bracketed notes of a series."""
    return _strip(F.regexp_replace(c, r"(?i)\s*\([^()]*\bseries\b[^()]*\)", ""))


def family_title(c: Column) -> Column:
    """A key that the editions of one title share: notes of edition and binding are left out."""
    bare = F.regexp_replace(c, r"(?i)\([^)]*(?:edition|\bed\.?\b|paperback|hardcover)[^)]*\)", "")
    return text_key(F.regexp_replace(bare, rf"(?i)\b(?:\d+(?:st|nd|rd|th)|{ORDINALS})\s+edition\b", ""))


def publisher_key(c: Column) -> Column:
    """The brand behind a publisher's name, else its letters and digits; "" for no publisher. An imprint
    is never merged with its house."""
    text = F.regexp_replace(folded(c), r"\(\s*edition\b[^)]*\)", "")
    key = F.regexp_replace(text, "[^a-z0-9]", "")
    out = F.when(key.isNull() | key.isin(*NO_PUBLISHER), "")
    for pattern, brand in BRANDS:
        out = out.when(key.rlike(pattern), brand)
    return out.otherwise(key)


def visible_publisher(title: Column, publisher: Column) -> Column:
    """Whether the publisher's brand already stands in the title."""
    key = publisher_key(publisher)
    return (key != "") & (F.regexp_replace(folded(title), "[^a-z0-9]", "").contains(key) | (publisher_key(title) == key))


def visible_author(title: Column, names: Column) -> Column:
    """Whether the last word of one of the names stands in the title, possessives aside."""
    shown = F.split(text_key(F.regexp_replace(title, r"(?i)['’]s\b", "")), " ")
    return F.arrays_overlap(shown, F.transform(names, lambda n: F.element_at(F.split(n, " "), -1)))


def same_title(observed: Column, source: Column) -> Column:
    """Whether enough words of an observed title, small words aside, stand in the source's title: two of
    them (or the only one) and 0.65 of all."""
    stops = F.array(*[F.lit(w) for w in TITLE_STOPS])
    seen, known = (F.array_except(F.filter(F.split(text_key(t), " "), lambda w: w != ""), stops) for t in (observed, source))
    both = F.size(F.array_intersect(seen, known))
    return (F.size(seen) > 0) & (both >= F.least(F.lit(2), F.size(seen))) & (both / F.size(seen) >= 0.65)


def context_key(value: Column, column: Column) -> Column:
    """The key of a context value: a publisher's brand, or a year of four digits; else ""."""
    return F.when(column == "publisher", publisher_key(value)).when(_strip(value).rlike(r"^[12]\d{3}$"), _strip(value)).otherwise("")


def stated_year(c: Column) -> Column:
    return F.when(c.cast("string").rlike(r"^[12]\d{3}$"), c.cast("int"))


# Words that stand for no text; words of a header that say nothing about its content.
NO_TEXT = ("n/a", "na", "n.a.", "not available", "unknown", "none", "null", "-", "--")
HEADER_FILLERS = ("a", "alias", "an", "description", "label", "name", "of", "the", "text", "value")


def book_key(c: Column) -> Column:
    """(key, scheme) of a book: its ISBN-13, else the digits of an invalid number, so that a wrong digit
    shows instead of a missing row; null where there is none."""
    valid, digits = isbn13(c), F.regexp_replace(F.upper(c), "[^0-9X]", "")
    key = F.when(valid.isNotNull(), F.concat(F.lit("isbn13:"), valid)).when(digits != "", F.concat(F.lit("isbn10:"), digits))
    return F.struct(key.alias("key"), F.when(valid.isNotNull(), "isbn13").when(digits != "", "isbn10_fallback").otherwise("unusable").alias("scheme"))


def seller_key(url: Column, name: Column, location: Column, prefix: str = "shop:") -> Column:
    """(key, scheme) of a seller: the number of the shop front in its address, else name and place,
    else the address."""
    bare = bare_url(url)
    number = F.nullif(F.regexp_extract(F.coalesce(bare, F.lit("")), r"/(\d+)/sf$", 1), F.lit(""))
    named = F.concat(F.lit("name_loc:"), stable_json_hash([normalize(name), normalize(F.coalesce(location, F.lit("")))]))
    has_name = clean_text(name) != ""
    key = F.when(number.isNotNull(), F.concat(F.lit(prefix), number)).when(has_name, named).when(bare.isNotNull(), F.concat(F.lit("url:"), stable_json_hash([bare])))
    return F.struct(key.alias("key"), F.when(number.isNotNull(), "storefront_id").when(has_name, "name_location").when(bare.isNotNull(), "url_only").otherwise("missing").alias("scheme"))


def picture_kind(url: Column, photo: str, stock: str) -> Column:
    """What an image address shows by the given marks: a photo of the copy, a stock cover, else a
    placeholder; null for no address."""
    u = F.lower(clean_text(url))
    return F.when(u == "", None).when(u.contains(photo), "seller_photo").when(u.contains(stock), "stock_cover").otherwise("placeholder")


def free_text(c: Column, longest: int = 1024) -> Column:
    """Cleaned text up to ``longest`` characters; null for the empty text and for placeholder words."""
    t = F.rtrim(F.substring(clean_text(c), 1, longest))
    return F.when((t != "") & ~normalize(t).isin(*["n a" if w == "n/a" else w for w in NO_TEXT]), t)


def result_count(c: Column) -> Column:
    return F.replace(F.regexp_extract(clean_text(c), r"(?i)(\d[\d,]*)\s+result", 1), F.lit(","), F.lit("")).try_cast("int")


def header_key(c: Column) -> Column:
    """Words of a header that name its content, in the singular and sorted; all its words if none is left."""
    words = F.filter(F.split(F.trim(F.regexp_replace(folded(clean_text(c)), r"[^\p{L}\p{N}]+", " ")), " "), lambda w: w != "")

    def single(w: Column) -> Column:
        many = (F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss")
        return F.when(w == "ranking", "rank").when((F.length(w) > 4) & w.endswith("ies"), F.concat(F.regexp_replace(w, "ies$", ""), F.lit("y"))).when(many, F.regexp_replace(w, "s$", "")).otherwise(w)

    told = F.transform(F.filter(words, lambda w: ~w.isin(*HEADER_FILLERS)), single)
    return F.array_join(F.array_sort(F.when(F.size(told) > 0, told).otherwise(words)), " ")


def number_with_unit(c: Column) -> Column:
    """(number, unit) of a text that is one number and a unit behind it; null for others."""
    t = one_line(folded(c))
    pattern = r"^([+-]?(?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d+)?)\s*([%a-z°²³/_-]*)$"
    number = F.replace(F.regexp_extract(t, pattern, 1), F.lit(","), F.lit("")).try_cast("decimal(38,10)")
    return F.when(t.rlike(pattern) & number.isNotNull(), F.struct(number.alias("number"), F.regexp_extract(t, pattern, 2).alias("unit")))


def without_suffix(c: Column, suffixes: tuple[str, ...]) -> Column:
    """A folded name without the first of the suffixes it ends with that leaves two letters or more."""
    t = _strip(folded(clean_text(c)))
    out = t
    for s in reversed(suffixes):
        stem = _strip(F.substring(t, F.lit(1), F.length(t) - len(s)))
        out = F.when(t.endswith(s) & (F.length(F.replace(stem, F.lit(" "), F.lit(""))) >= 2), stem).otherwise(out)
    return out


def same_but_suffix(a: Column, b: Column, suffixes: tuple[str, ...]) -> Column:
    """Whether two different names are one but for a suffix of their kind."""
    x, y = _strip(folded(clean_text(a))), _strip(folded(clean_text(b)))
    return (x != "") & (y != "") & (x != y) & (without_suffix(a, suffixes) == without_suffix(b, suffixes))


def without_notice(c: Column, marker: str, tail: str) -> Column:
    """A text up to a notice's marker, without the token ``tail`` (a pattern) before it; null if nothing
    is left. Texts without the marker stay as they are."""
    cut = _strip(F.regexp_replace(F.substring_index(c, marker, 1), tail + r"\s*$", ""))
    return F.when(c.contains(marker), F.nullif(cut, F.lit(""))).otherwise(c)


def escape_markers(c: Column, markers: tuple[str, ...]) -> Column:
    """Cleaned text in which control tokens of a reader are plain text."""
    out = clean_text(c)
    for m in markers:
        out = F.replace(out, F.lit(m), F.lit(m.replace("<", "&lt;", 1)))
    return out

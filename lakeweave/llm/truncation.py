"""Texts that stop before they are finished.

1. Near-copies are found by min-hash banding over five-word shingles. A cut text is contained in its
   full copy, so a text that is not closed is signed by its opening of L words, L the largest step of
   a fixed ladder that it reaches, and every text by its openings at all steps: a cut copy and the
   opening of the full text are as alike as two whole copies are. Pairs are verified (0.8 of the
   shorter text's shingles stand in the longer), their ends are aligned, and a copy whose alignment
   ends early, inside a word or before the other's sentence or list entry ends, is cut off.
2. Texts that meet nothing are scored by how terminal their closing is: hard signs (open mark-up or
   brackets, a split character, a mark such as "[...]"), then counts over all texts of how often the
   closing word ends a sentence or entry, how often the closing entry stands complete elsewhere and
   how often sentences with its opening words go on to a full stop.
"""

from __future__ import annotations

import html
import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeweave.runtime import settle

SHINGLE, SIMILARITY, ROWS, BANDS = 5, 0.8, 4, 8
#: First step of the ladder of openings (words) and the ratio of its steps.
FIRST_STEP, STEP_RATIO = SHINGLE + 1, 1.5
#: In a bucket that would make more pairs, likely partners are tried first.
HOT_PAIRS = 2_000
#: Words at the end of the shorter copy that are aligned.
WINDOW = 24
#: A closing word is terminal if at least this share of its places closes a sentence or entry; a
#: closing entry, if it stands complete so often among the sentences that open with its words.
TERMINAL = 0.02
#: A text of one open sentence of so few words, found so often, is a caption where no count speaks against it.
CAPTION_WORDS, CAPTION_COPIES = 8, 4

STOPS = ".!?。！？"
CLOSERS = "\"'”’»)]）】」』›*★☆"
OPEN_PAIRS = {"(": ")", "[": "]", "“": "”", "«": "»", "（": "）", "「": "」", "„": "“"}
# Marks of a cut, and the names of character entities that a cut can split.
CUT_MARK = regex.compile(r"(?:\s*(?:\[\s*(?:\.{3}|…)\s*\]|\(\s*(?:\.{3}|…)\s*\)|(?:\.{3,}|…)?\s*[(\[]\s*(?:read more|more|continued|continue reading|cont\.|truncated|weiterlesen|lire la suite|leer más|sigue)\s*[)\]]|\.{3,}|…|\s»|\s>>|read more))+\s*$", regex.I | regex.REVERSE)
ENTITY_CUT = regex.compile(r"&(?:#\d{0,5}|#x[0-9a-f]{0,4}|[a-z]{0,6})$", regex.I)
ENTITIES = ("amp", "nbsp", "quot", "apos", "lt", "gt", "eacute", "egrave", "agrave", "ouml", "uuml", "auml", "szlig", "hellip", "mdash", "ndash", "rsquo", "lsquo", "rdquo", "ldquo", "copy", "reg", "euro", "pound")
TAG_CUT = regex.compile(r"<[a-zA-Z/!][^<>]*$")
TAIL_TAGS = regex.compile(r"(?:\s*</[a-zA-Z][^<>]*>|\s*<br\s*/?>)+\s*$")
TAG = regex.compile(r"<[^<>]+>")
SENTENCE = regex.compile(r"(?<!\b\p{Lu}|\b[Nn]o|\b[Cc]f|\b[Vv]ol)[.!?;]+[\"'”’»)\]]*(?=\s|$)|[。！？；]+[”’」』]*|\n+|(?<=[\p{Lu}][.])(?=\s+[\p{Lu}]\p{Ll}{2,}\s+\p{Ll})")
ENTRY_ENDS = regex.compile(r"\s*[.!?;。！？\n]|\s*,\s")
COMMA = regex.compile(r"[,，、]\s")
TOKEN = regex.compile(r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*|\p{N}+(?:[.,]\p{N}+)*")


def plain(text: str) -> str:
    """Text without tags and with entities read, blanks unified."""
    return regex.sub(r"[^\S\n]+", " ", html.unescape(TAG.sub(" \n ", text))).strip()


@lru_cache(maxsize=200_000)
def token(word: str) -> str:
    w = word.lower()
    return "#" if w[0].isdigit() else "@" if len(w) == 1 else w


def tokens(text: str) -> list[str]:
    return [token(w) for w in TOKEN.findall(text)]


def closed(t: str) -> bool:
    """Whether the text ends with a full stop of any kind, closers and list marks behind it allowed."""
    t = TAIL_TAGS.sub("", t).rstrip()
    k = len(t)
    while k and t[k - 1] in CLOSERS:
        k -= 1
    if k < len(t) and k and t[k - 1] not in STOPS + "…":
        return t[-1] in ")]）】★☆*" and _balanced(t)
    return bool(k) and (t[k - 1] in STOPS or (t[k - 1] == "…" and k < len(t)))


def _balanced(t: str) -> bool:
    for a, b in (("(", ")"), ("[", "]"), ("（", "）")):
        if t.endswith(b) and t.rfind(a) < 0:
            return False
    return True


def _unclosed(tail: str) -> bool:
    """Whether a bracket or quote that opens in the last sentence never closes."""
    for a, b in OPEN_PAIRS.items():
        if a != "„" and tail.count(a) > tail.count(b):
            return True
    return False


def parts(text: str) -> list[tuple[str, str]]:
    """Sentences of a plain text with what closes each; the last one may have nothing."""
    out, at = [], 0
    for m in SENTENCE.finditer(text):
        out.append((text[at : m.start()].strip(), m.group().strip() or "\n"))
        at = m.end()
    rest = text[at:].strip()
    if rest:
        out.append((rest, ""))
    return [(s, e) for s, e in out if s or not e]


def entries(sentence: str) -> list[str]:
    """Comma entries of a sentence that reads as a list; else the sentence alone."""
    if "," not in sentence and "，" not in sentence and "、" not in sentence:
        return [sentence]
    pieces = [p.strip() for p in COMMA.split(sentence)]
    if len(pieces) >= 2 and max(len(TOKEN.findall(p)) for p in pieces) <= 5:
        return pieces
    return [sentence]


def key_of(piece: str) -> str:
    return " ".join(tokens(piece))


def verdict(text: str) -> str:
    """'cut' on a hard sign, 'done' where the text is closed, 'open' where counts must tell."""
    t = text.rstrip()
    if not t:
        return "done"
    if TAG_CUT.search(t) or t.endswith("�"):
        return "cut"
    m = ENTITY_CUT.search(t)
    if m and (m.group()[1:2] in ("#", "") or any(e.startswith(m.group()[1:].lower()) for e in ENTITIES)):
        return "cut"
    if len(regex.findall(r"<(?:p|li|ul|ol|td|tr|table|div|b|i|a)\b", t)) > len(regex.findall(r"</(?:p|li|ul|ol|td|tr|table|div|b|i|a)>", t)) and not closed(t):
        return "cut"
    mark = CUT_MARK.match(t)
    if mark:
        before = t[: mark.start()]
        if not (mark.group().strip() == "»" and t.count("«") > before.count("»")):
            return "cut" if not closed(before) else "done" if mark.group().strip() not in ("...", "…") else "cut"
    bare = TAIL_TAGS.sub("", t).rstrip()
    if closed(t):
        return "done"
    if bare[-1:] in ",;:-–—([{“„«&/+":
        return "cut"
    body = plain(bare)
    tail = parts(body)[-1:] or [("", "")]
    if tail[0][1] == "" and _unclosed(tail[0][0]):
        return "cut"
    return "open"


def openers(words: list[str], done: bool) -> tuple[str, str]:
    """The first two words and the first word; the last word of an open sentence may be a part of one
    and is left out, a number is not. Empty where too few words are left."""
    lead = words if done or words[-1:] == ["#"] else words[:-1]
    return " ".join(lead[:2]) if len(lead) > 1 else "", lead[0] if lead else ""


def key(kind: str, text: str) -> int:
    """64-bit key of a counted thing."""
    return xxhash.xxh3_64_intdigest(f"{kind}\x1f{text}") - (1 << 63)


def closing(got: list[tuple[str, str]]) -> dict:
    """What the counts are asked about an open text, given its parts."""
    if not got:
        return dict(bare=True, words=0, earlier=0, keys=[])
    sentence = got[-1][0]
    pieces, words = entries(sentence), tokens(sentence)
    entry = key_of(pieces[-1])
    two, one = openers(words, False)
    asked = [("entry", entry), ("two", two), ("one", one), ("word", (words or [""])[-1])]
    return dict(bare=entry in ("@", ""), words=entry.count(" ") + 1, earlier=sum(1 for s, e in got[:-1] if s) + (len(pieces) > 1), keys=[key(k, t) if t else None for k, t in asked])


def count_parts(got: list[tuple[str, str]], left: Counter, right: Counter, places: Counter) -> None:
    """Add the sentences of a text to the counts.

    entry: complete entries (left). two, one: closed (left) and open (right) sentences by their opening
    words. word: places of a word that close a sentence or entry (left), and all ``places``.
    """
    for sentence, end in got:
        words = tokens(sentence) if sentence else []
        if not words:
            continue
        done = bool(end)
        for kind, text in zip(("two", "one"), openers(words, done), strict=True):
            if text:
                (left if done else right)[kind, text] += 1
        pieces = entries(sentence)
        if len(pieces) == 1:
            keys = [" ".join(words)] if done else []
        else:
            keys = [key_of(p) for p in (pieces if done else pieces[:-1])]
        for k in keys:
            left["entry", k] += 1
            left["word", k[k.rfind(" ") + 1 :]] += 1
        places.update(words)


def unmarked(text: str, body: str) -> str:
    """The plain text ``body`` of a text without a closing mark of a cut."""
    t = text.rstrip()
    mark = CUT_MARK.match(t)
    return plain(t[: mark.start()]) if mark else body


def bare_words(text: str) -> tuple[str, list]:
    """The plain text without a closing mark of a cut, and its words as matches."""
    body = unmarked(text, plain(text))
    return body, list(TOKEN.finditer(body))


_word_hash = lru_cache(maxsize=200_000)(xxhash.xxh3_64_intdigest)


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(_word_hash, words), np.uint64, len(words))


def shingles(h: np.ndarray) -> np.ndarray:
    """Hashes of the five-word shingles of a text of at least five words, in order."""
    out = np.zeros(len(h) - SHINGLE + 1, dtype=np.uint64)
    for k in range(SHINGLE):
        out = out * np.uint64(0x9E3779B97F4A7C15) + h[k : len(h) - SHINGLE + 1 + k]
        out ^= out >> np.uint64(31)
    return out


SEEDS = np.arange(1, ROWS * BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)


def steps(words: int) -> list[int]:
    """The steps of the ladder that a text of so many words reaches."""
    out, at = [], float(FIRST_STEP)
    while at <= words:
        out.append(int(at))
        at *= STEP_RATIO
    return out


def signatures(h: np.ndarray, ladder: list[int]) -> np.ndarray:
    """Band keys (steps x bands) of the openings of these lengths, from running minima."""
    mixed = (shingles(h)[None, :] ^ SEEDS[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    least = np.minimum.accumulate(mixed, axis=1)[:, [n - SHINGLE for n in ladder]].T
    out = np.full((len(ladder), BANDS), 0, dtype=np.uint64)
    for r in range(ROWS):
        out = (out ^ least[:, r::ROWS]) * np.uint64(0xFF51AFD7ED558CCD)
        out ^= out >> np.uint64(32)
    return (out + np.arange(BANDS, dtype=np.uint64)).view(np.int64)


def alignment_end(a: list[str], b: list[str]) -> int:
    """The word of ``b`` that the last word of ``a`` is aligned with, or -1.

    The closing words of ``a`` are aligned with ``b``, which may start and end anywhere, at the least
    number of words replaced, inserted or left out; at most a fifth of them may differ, the last word
    of ``a`` may be a part of its partner and its partner is the last one aligned. Of equal ends the
    one nearest to the place that the length of ``a`` gives is taken.
    """
    tail = a[-WINDOW:]
    m, n = len(tail), len(b)
    lead = tail[:-1]
    cost = np.zeros(n + 1, dtype=np.int32)
    column = np.arange(n + 1, dtype=np.int32)
    codes: dict[str, int] = {}
    coded = np.fromiter((codes.setdefault(w, len(codes)) for w in b), np.int32, n)
    for i, w in enumerate(lead, start=1):
        same = coded == codes.get(w, -1)
        step = np.minimum(cost[:-1] + ~same, cost[1:] + 1)
        # Words of b left out in between: a running minimum of cost minus position.
        row = np.concatenate(([i], step)).astype(np.int32)
        cost = np.minimum.accumulate(row - column) + column
    fits = [p for p in range(n) if b[p].startswith(tail[-1]) and cost[p] * 5 <= m - 1]
    return min(fits, key=lambda p: (cost[p], abs(p - len(a) + 1)), default=-1)


def ends_early(short: str, long: str) -> bool:
    """Whether the alignment of two near-copies ends inside a word, sentence or entry of the longer.

    They are near-copies if 0.8 of the shorter one's shingles, its last word left out, stand in the
    longer. Texts of less than six words are none.
    """
    (_, x), (body, y) = bare_words(short), bare_words(long)
    a, b = [m.group().lower() for m in x], [m.group().lower() for m in y]
    if len(a) <= SHINGLE or len(b) <= SHINGLE:
        return False
    own = np.unique(shingles(word_hashes(a[:-1])))
    if np.isin(own, shingles(word_hashes(b))).sum() < SIMILARITY * len(own):
        return False
    at = alignment_end(a, b)
    if at < 0:
        return False
    if a[-1] != b[at]:
        return True
    return at < len(b) - 1 and not ENTRY_ENDS.match(body, y[at].end())


def text_assets(assets: DataFrame) -> DataFrame:
    """(asset_id, source, content): the latest delivery of every text asset with visible content."""
    text = assets.filter(F.col("asset_id").isNotNull() & (F.lower(F.trim("asset_type")) == "text"))
    last = F.max(F.struct(F.col("loaded_at"), F.col("content"), F.col("source")))
    return text.groupBy("asset_id").agg(last.alias("x")).select("asset_id", "x.source", "x.content")


READ = "kind string, cls string, verdict string, bare boolean, words int, earlier int, keys array<long>, own array<long>, every array<long>, key long, a long, b long"


def read_texts(classes: DataFrame) -> DataFrame:
    """One pass over all distinct texts: a row of kind text for each, with its verdict, the keys its
    closing is asked by and its band keys (``own`` of a text that is not closed, ``every`` of all
    openings), and rows of the counted kinds, summed per batch before any shuffle. Every distinct text
    counts once: its copies are no evidence that it is finished."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in READ.split(", ")]
        for pdf in batches:
            left: Counter = Counter()
            right: Counter = Counter()
            places: Counter = Counter()
            rows = []
            for c, t in zip(pdf["cls"].tolist(), pdf["content"].tolist(), strict=True):
                v = verdict(t)
                body = plain(t)
                got = parts(body)
                count_parts(got[:-1] if v == "cut" else got, left, right, places)
                x = closing(got) if v == "open" else dict(bare=None, words=None, earlier=None, keys=None)
                h = word_hashes([w.lower() for w in TOKEN.findall(unmarked(t, body))])
                ladder = steps(len(h))
                every = signatures(h, ladder) if ladder else None
                reached = len(steps(len(h) - 1))
                own = every[reached - 1] if reached and v != "done" else None
                rows.append(("text", c, v, x["bare"], x["words"], x["earlier"], x["keys"], own, None if every is None else np.unique(every), None, None, None))
            for w, n in places.items():
                right["word", w] = n
            for k in left.keys() | right.keys():
                rows.append((k[0], None, None, None, None, None, None, None, None, key(*k), left[k], right[k]))
            yield pd.DataFrame(rows, columns=columns, dtype=object)

    return classes.select("cls", "content").mapInPandas(run, READ)


def scored(read: DataFrame, copies: DataFrame) -> DataFrame:
    """(cls, cut) of every open text by how terminal its closing is; ``copies`` (cls, n)."""
    counts = read.filter("kind <> 'text'").groupBy("kind", "key").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    open_ = read.filter("kind = 'text' and verdict = 'open'").select("cls", "bare", "words", "earlier", "keys").join(copies, "cls")
    kinds = F.array(*[F.lit(k) for k in ("entry", "two", "one", "word")])
    asked = open_.select("cls", F.explode(F.arrays_zip(kinds.alias("kind"), F.col("keys").alias("key"))).alias("x")).select("cls", "x.kind", "x.key").filter("key is not null")
    told = asked.join(counts, ["kind", "key"])
    pick = lambda kind, c: F.coalesce(F.max(F.when(F.col("kind") == kind, F.col(c))), F.lit(0))
    found = told.groupBy("cls").agg(pick("entry", "a").alias("ea"), pick("two", "a").alias("ta"), pick("two", "b").alias("tb"), pick("one", "a").alias("oa"), pick("one", "b").alias("ob"), pick("word", "a").alias("wa"), pick("word", "b").alias("wb"))
    j = open_.join(found, "cls", "left").na.fill(0, ["ea", "ta", "tb", "oa", "ob", "wa", "wb"])
    two, one = F.col("tb") / (F.col("ta") + F.col("tb")), F.col("ob") / (F.col("oa") + F.col("ob"))
    terminal = F.col("wa") >= TERMINAL * F.col("wb")
    stands = (F.col("ea") >= 2) & (F.col("ea") >= TERMINAL * F.col("ta"))
    cut = (
        F.when(F.col("bare"), True)
        .when(stands & terminal, False)
        .when(F.col("ta") + F.col("tb") >= 4, two < 0.85)
        .when(F.col("earlier") > 0, True)
        .when(F.col("oa") + F.col("ob") >= 4, one < 0.5)
        .when((F.col("n") >= CAPTION_COPIES) & (F.col("words") <= CAPTION_WORDS), False)
        .otherwise(~terminal | (F.col("wb") == 0))
    )
    return j.select("cls", cut.alias("cut"))


def _places(text: str) -> list[tuple[int, str, bool]]:
    """(tail, word, goes) of every place of a text where a near-copy may be cut: the hash of the five
    words before it, its word, and whether the entry goes on behind it."""
    body, found = bare_words(text)
    words = [m.group().lower() for m in found]
    if len(words) <= SHINGLE:
        return []
    tails = shingles(word_hashes(words)).view(np.int64).tolist()
    last = len(words) - 1
    return [(tails[p - SHINGLE], words[p], p < last and not ENTRY_ENDS.match(body, found[p].end())) for p in range(SHINGLE, len(words))]


def buckets(read: DataFrame, hot_pairs: int = HOT_PAIRS) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs (cls, other) of the cool buckets; of the hot ones, the texts that ask (cls, band) and the
    texts that stand in them (band, other)."""
    text = read.filter("kind = 'text'")
    asks = text.filter("own is not null").select("cls", F.explode("own").alias("band"))
    asked = asks.groupBy("band").agg(F.count("*").alias("na"))
    offers = settle(text.filter("every is not null").select(F.col("cls").alias("other"), F.explode("every").alias("band")).join(asked, "band"))
    load = offers.groupBy("band").agg((F.first("na") * F.count("*")).alias("pairs"), F.count("*").alias("nb")).filter("nb > 1 or pairs > 1")
    asks = settle(asks.join(load.select("band", (F.col("pairs") > hot_pairs).alias("hot")), "band"))
    cool = asks.filter("not hot").join(offers.select("band", "other"), "band").filter("cls <> other").select("cls", "other").distinct()
    hot = asks.filter("hot").select("cls", "band")
    return cool, hot, offers.join(hot.select("band").distinct(), "band").select("band", "other")


def first_pairs(classes: DataFrame, hot: DataFrame, crowd: DataFrame) -> DataFrame:
    """(cls, other) of hot buckets that are tried first: a text meets, for each next word, the shortest text
    of the bucket in which the same five words stand before the place of its cut."""

    def places(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, len(t), *x) for c, t in zip(pdf["cls"].tolist(), pdf["content"].tolist(), strict=True) for x in _places(t)]
            yield pd.DataFrame(rows, columns=["cls", "n", "tail", "word", "goes"])

    def ends(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = [(c, x[-1][0], x[-1][1]) for c, t in zip(pdf["cls"].tolist(), pdf["content"].tolist(), strict=True) if (x := _places(t))]
            yield pd.DataFrame(rows, columns=["cls", "tail", "end"])

    full = classes.select("cls", "content")
    cut = settle(full.join(hot.select("cls").distinct(), "cls", "left_semi").mapInPandas(ends, "cls string, tail long, end string"))
    at = full.join(crowd.select(F.col("other").alias("cls")).distinct(), "cls", "left_semi").mapInPandas(places, "cls string, n int, tail long, word string, goes boolean")
    shared = at.join(cut.select("tail").distinct(), "tail", "left_semi").withColumnRenamed("cls", "other")
    first = crowd.join(shared, "other").groupBy("band", "tail", "word", "goes").agg(F.min(F.struct("n", "other")).alias("top"))
    early = F.col("word").startswith(F.col("end")) & ((F.col("word") != F.col("end")) | F.col("goes"))
    met = hot.join(cut, "cls").join(first, ["band", "tail"]).filter(early).select("cls", F.col("top.other").alias("other")).filter("cls <> other")
    return met.distinct()


def further_pairs(classes: DataFrame, read: DataFrame, rest: DataFrame, crowd: DataFrame) -> DataFrame:
    """(cls, other): all pairs of ``rest`` (cls) and ``crowd`` (other) of one bucket that can be near-copies.

    A near-copy holds 0.8 of the shingles that ``ends_early`` asks for, so at least one of the rarest fifth
    and one more: the pairs without one of these are left out, and no others."""

    def shingled(name: str, asks: bool):  # noqa: ANN202
        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                out = [pd.DataFrame({name: [], "need": [], "shingle": []}).astype({name: object, "need": "i4", "shingle": "i8"})]
                for c, t in zip(pdf["cls"].tolist(), pdf["content"].tolist(), strict=True):
                    words = [m.group().lower() for m in bare_words(t)[1]]
                    if len(words) > SHINGLE:
                        h = np.unique(shingles(word_hashes(words[:-1] if asks else words)))
                        out.append(pd.DataFrame({name: c, "need": np.int32(len(h) - math.ceil(SIMILARITY * len(h) - 1e-9) + 1), "shingle": h.view(np.int64)}))
                yield pd.concat(out)

        return run, f"{name} string, need int, shingle long"

    text = classes.select("cls", "content")
    held = settle(text.join(crowd.select(F.col("other").alias("cls")).distinct(), "cls", "left_semi").mapInPandas(*shingled("other", False)).drop("need"))
    own = text.join(rest, "cls", "left_semi").mapInPandas(*shingled("cls", True))
    counted = own.join(held.groupBy("shingle").agg(F.count("*").alias("n")), "shingle", "left").fillna(0, ["n"])
    rare = counted.withColumn("r", F.row_number().over(Window.partitionBy("cls").orderBy("n", "shingle"))).filter("r <= need and n > 0")
    met = rare.select("cls", "shingle").join(held, "shingle").filter("cls <> other").select("cls", "other").distinct()
    bands = read.filter("kind = 'text'")
    met = met.join(bands.select("cls", "own"), "cls").join(bands.select(F.col("cls").alias("other"), "every"), "other")
    return met.filter(F.arrays_overlap("own", "every")).select("cls", "other")


def aligned(classes: DataFrame, read: DataFrame, hot_pairs: int = HOT_PAIRS) -> DataFrame:
    """(cls) of texts that are not closed and whose alignment with a near-copy ends early.

    One such copy is enough. So texts of hot buckets, which may hold a third of all texts, try their most
    likely partners first, and only those for whom none of these is one meet all that can be."""
    text = classes.select("cls", "content")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(c,) for c, a, b in zip(pdf["cls"].tolist(), pdf["content"].tolist(), pdf["long"].tolist(), strict=True) if ends_early(a, b)], columns=["cls"], dtype=object)

    def early(pairs: DataFrame) -> DataFrame:
        both = pairs.join(text, "cls").join(text.select(F.col("cls").alias("other"), F.col("content").alias("long")), "other")
        return both.select("cls", "content", "long").mapInPandas(run, "cls string").distinct()

    cool, hot, crowd = buckets(read, hot_pairs)
    if hot.isEmpty():
        return early(cool)
    hot, crowd = settle(hot), settle(crowd)
    found = settle(early(cool.unionByName(first_pairs(classes, hot, crowd)).distinct()))
    rest = settle(hot.select("cls").distinct().join(found, "cls", "left_anti"))
    return found.unionByName(early(further_pairs(classes, read, rest, crowd))).distinct()


def truncated_assets(assets: DataFrame) -> DataFrame:
    """(asset_id, source, cut, evidence): every text asset, whether its content is cut off, and by
    what this was seen: alignment, sign or score; null where it is not cut.

    Null, empty and blank contents are not cut off. Equal contents are judged once. A redelivered
    asset counts once, by its latest delivery. A text that closes with a full stop is finished. Empty
    input gives no rows; extra columns are not read.
    """
    texts = settle(text_assets(assets).withColumn("cls", F.base64(F.unhex(F.md5("content")))))
    classes = settle(texts.filter(F.length(F.trim("content")) > 0).groupBy("cls").agg(F.first("content").alias("content"), F.count("*").alias("n")))
    read = settle(read_texts(classes))
    copies = aligned(classes, read).withColumn("early", F.lit(True))
    marks = read.filter("kind = 'text' and verdict <> 'done'").select("cls", "verdict")
    by = F.when(F.col("early"), "alignment").when(F.col("verdict") == "cut", "sign").when(F.col("cut"), "score")
    judged = marks.join(copies, "cls", "left").join(scored(read, classes.select("cls", "n")), "cls", "left").select("cls", by.alias("evidence"))
    return texts.join(judged, "cls", "left").select("asset_id", "source", F.col("evidence").isNotNull().alias("cut"), "evidence")


def truncation_report(judged: DataFrame) -> DataFrame:
    """Texts, cut texts and their share per source; a null source is a group of its own."""
    return judged.groupBy("source").agg(F.count("*").alias("n_texts"), F.sum(F.col("cut").cast("long")).alias("n_cut")).withColumn("share", F.col("n_cut") / F.col("n_texts"))

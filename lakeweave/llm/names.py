"""Variant spellings of people and organisations.

1. Every spelling is read into a signature: its core (the family name, or the word that tells an
   organisation from others of its kind), the given name or initial, a middle initial and a suffix.
   Spellings of one signature (case, order, accents, titles, roles) are one node from here on.
2. Distinct cores meet by MinHash banding over their padded q-grams. Rows per band and bands come
   from the collision curve 1 - (1 - s^r)^b: the least noise that still reaches the wanted recall at
   the overlap that two slips leave in fourteen letters. One slip leaves short cores less overlap than
   that, so they meet by the core with one letter left out, which misses no slip.
3. Signatures whose cores are equal or met, and which share a given name, a known short form or slip
   of it, or an initial, are compared by Monge-Elkan similarity: the mean over their parts of the best
   graded match. A group of one core and initial is never paired as a whole.
4. Star clustering: the heaviest signature takes its neighbours, then the next; a signature that
   fits two stars which do not know each other (an initial, a shared short form) joins neither.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeweave.operators import unpack
from lakeweave.runtime import settle

# Words that tell what an organisation is, titles and roles before or behind a name.
KIND_WORDS = (
    "society association institute committee council commission board office bureau department ministry university college school academy library librarians museum "
    "archive press publishers publishing books company corporation limited group club union guild league trust foundation federation church studies historical "
    "bridges roads map maps daughters sons brothers partners friends staff editors team service services agency authority center centre laboratory"
).split()
SMALL_WORDS = frozenset("the of for on and in to a an & de la le du des der die das und et".split())
TITLES = frozenset("dr prof professor mr mrs ms miss sir rev st dame lord lady".split())
SUFFIXES = unpack.SUFFIXES
THRESHOLD = 0.82
#: Wanted recall of the banding for cores of SIMILARITY, and the overlap of unrelated cores.
RECALL, SIMILARITY, NOISE = 0.99, 0.33, 0.15
#: Cores up to SHORT letters meet by leaving a letter out, from SHORT on by bands. Names from
#: TWO_SLIPS letters on may differ by two slips, names from ONE_SLIP letters on by one.
SHORT, ONE_SLIP, TWO_SLIPS = 8, 3, 14
#: Most known short forms of given names (a small fixed table that every worker holds).
MOST_FORMS = 20_000

BRACKETED = regex.compile(r"\([^()]*\)|\[[^\[\]]*\]|[\"“][^\"“”]*[\"”]")
WORD = regex.compile(r"[\p{L}\p{M}]+(?:['’\-][\p{L}\p{M}]+)*\.?|&")


def fold(text: str) -> str:
    """Lower case without accents."""
    return "".join(c for c in unicodedata.normalize("NFKD", text).casefold() if not unicodedata.combining(c))


def near(a: str, b: str) -> int:
    """Optimal string alignment distance (insertions, deletions, replacements, swaps), cut off at 3."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 2:
        return 3
    k = 0
    while k < len(a) and k < len(b) and a[k] == b[k]:
        k += 1
    x, y = a[k:], b[k:]
    while x and y and x[-1] == y[-1]:
        x, y = x[:-1], y[:-1]
    if max(len(x), len(y)) <= 1 or (len(x) == 2 == len(y) and x[0] == y[1] and x[1] == y[0]):
        return 1
    two, one = [], list(range(len(y) + 1))
    for i, c in enumerate(x, start=1):
        row = [i]
        for j, d in enumerate(y, start=1):
            v = min(one[j - 1] + (c != d), one[j] + 1, row[j - 1] + 1)
            if i > 1 and j > 1 and c == y[j - 2] and x[i - 2] == d:
                v = min(v, two[j - 2] + 1)
            row.append(v)
        if min(row) > 2:
            return 3
        two, one = one, row
    return min(3, one[-1])


def slips(a: str, b: str) -> int | None:
    """Slips of typing between two names if their length allows so many, else None."""
    d = near(a, b)
    short = min(len(a), len(b))
    most = 2 if short >= TWO_SLIPS else 1 if short >= ONE_SLIP else 0
    return d if d <= most else None


def shortened(a: str, b: str) -> bool:
    """Whether ``a`` is ``b`` cut off or without inner letters (soc, off, cttee)."""
    if len(a) >= len(b) or len(a) < 3 or a[0] != b[0]:
        return False
    at = iter(b)
    return b.startswith(a) or all(c in at for c in a)


@lru_cache(maxsize=100_000)
def _kind_word(word: str) -> str | None:
    for k in KIND_WORDS:
        if word == k or (len(word) > 4 and near(word, k) == 1):
            return k
    return None


def padded_grams(word: str, q: int = 3) -> set[str]:
    s = "^" * (q - 1) + word + "$" * (q - 1)
    return {s[k : k + q] for k in range(len(s) - q + 1)}


def banding(recall: float = RECALL, similarity: float = SIMILARITY, noise: float = NOISE, most: int = 160) -> tuple[int, int]:
    """Rows per band and bands of least noise whose collision curve reaches ``recall``."""
    best = (1.0, 1, 1)
    for rows in range(1, 9):
        bands = math.ceil(math.log(1 - recall) / math.log(1 - similarity**rows))
        if bands <= most:
            best = min(best, (1 - (1 - noise**rows) ** bands, rows, bands))
    return best[1], best[2]


def read_name(text: str, givens: frozenset, formals: dict) -> tuple | None:
    """(kind, core, given, middle, suffix, rest, known): the signature of one spelling, ``known`` telling
    that the given name is one of ``givens``; None for no name."""
    if unpack.is_placeholder(text):
        return None
    t = regex.sub(r"\([^()]*\)|\[[^\[\]]*\]", " ", unicodedata.normalize("NFKC", text))
    nick = regex.search(r"[\"“]([^\"“”]+)[\"”]", t)
    quoted = fold(nick.group(1)).strip() if nick and t.replace(nick.group(0), "").strip() else ""
    if quoted:
        t = t.replace(nick.group(0), " ")
    parts = [[w for w in WORD.findall(fold(p))] for p in t.split(",")]
    parts = [p for p in parts if p]
    suffix = ""
    if len(parts) > 1 and len(parts[-1]) == 1 and parts[-1][0].rstrip(".") in SUFFIXES:
        suffix = parts.pop()[0].rstrip(".")
    words = [w.rstrip(".") for p in parts for w in p]
    if not words:
        return None
    if words[-1] in SUFFIXES and len(words) > 2:
        suffix = words.pop()
    kinds = [k for w in words if (k := _kind_word(w.rstrip("'’")))]
    if kinds and (len(words) > 2 or len(kinds) == len(words) - 1):
        rest = [w for w in words if w not in SMALL_WORDS and w not in ("&",)]
        known = {w: _kind_word(w.rstrip("'’")) for w in rest}
        own = [w for w in rest if not known[w] and not any(shortened(w, k) for k in KIND_WORDS)]
        if own:
            core = max(own, key=len)
            others = sorted({known[w] or next((k for k in KIND_WORDS if shortened(w, k)), w) for w in rest if w != core})
            return ("org", core, "", "", "", " ".join(others), "")
    words = [w for w in words if w not in TITLES and w != "&"] or words
    if len(parts) > 1:
        head = [w.rstrip(".") for w in parts[0] if w.rstrip(".") not in TITLES]
        tail = [w.rstrip(".") for p in parts[1:] for w in p if w.rstrip(".") not in TITLES]
        if not head or not tail:
            return ("person", words[-1], "", "", suffix, quoted, "")
        family, rest = head[-1] if len(head) == 1 else " ".join(head), tail
    else:
        long = [w for w in words if len(w) > 1]
        if not long:
            return ("person", " ".join(words), "", "", suffix, quoted, "")
        family = words[-1] if len(words[-1]) > 1 else long[0]
        if len(long) > 1 and words[0] == long[0]:
            first, last = long[0], long[-1]
            if (last in givens or last in formals) and not (first in givens or first in formals):
                family = first
        rest = list(words)
        rest.remove(family)
    given = rest[0] if rest else ""
    middle = "".join(w[0] for w in rest[1:2])
    return ("person", family, given, middle, suffix, quoted, "known" if given in givens else "")


def given_similarity(x: tuple, y: tuple, formals: dict) -> float:
    """Similarity of the given names of two signatures: equal, known short form, slip of typing (two
    in long names, none between two known given names), initial; else 0."""
    a, b, qa, qb = x[2], y[2], x[5], y[5]
    if not a or not b:
        return 0.0
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        short, full = (a, b) if len(a) == 1 else (b, a)
        starts = {full[0]} | {f[0] for f in formals.get(full, ())}
        return 0.8 if short in starts else 0.0
    fa, fb = formals.get(a, frozenset()), formals.get(b, frozenset())
    if b in fa or a in fb:
        return 0.95
    if fa & fb:
        return 0.9
    if qa and (qa == b or b in formals.get(qa, ())) or qb and (qb == a or a in formals.get(qb, ())):
        return 0.95
    if x[6] and y[6]:
        return 0.0
    d = slips(a, b)
    return 0.0 if d is None else 0.9 if d == 1 else 0.8


def word_similarity(p: str, q: str) -> float:
    """Graded similarity of two words of an organisation's name."""
    if p == q:
        return 1.0
    if shortened(p, q) or shortened(q, p):
        return 0.9
    d = slips(p, q)
    return 0.0 if d is None else 1.0 - 0.1 * d


def monge_elkan(x: tuple, y: tuple, formals: dict) -> float:
    """Mean over the parts of the best graded match of each part; 0 where two parts contradict.

    The core counts 0.1 less for each slip, and one slip more where it is short. Slips in both parts
    need two long parts to pass the threshold."""
    if x[0] != y[0] or x[4] != y[4]:
        return 0.0
    core = slips(x[1], y[1])
    if core is None:
        return 0.0
    c = 1.0 - 0.1 * (core + (core > 0 and min(len(x[1]), len(y[1])) < 5))
    if x[0] == "org":
        a, b = x[5].split(), y[5].split()
        if not a or not b:
            return 0.0
        best = [max(word_similarity(p, q) for q in b) for p in a]
        back = [max(word_similarity(p, q) for p in a) for q in b]
        return min((c + sum(best)) / (1 + len(best)), (c + sum(back)) / (1 + len(back)))
    if x[3] and y[3] and x[3] != y[3]:
        return 0.0
    g = given_similarity(x, y, formals)
    return 0.0 if g == 0.0 else (c + g) / 2


def _min_hashes(word: str, n: int, q: int) -> np.ndarray:
    grams = padded_grams(word, q)
    base = np.fromiter((xxhash.xxh3_64_intdigest(g) for g in grams), np.uint64, len(grams))
    seeds = np.arange(1, n + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (base[None, :] ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
    mixed ^= mixed >> np.uint64(29)
    mixed *= np.uint64(0x94D049BB133111EB)
    return (mixed ^ (mixed >> np.uint64(32))).min(axis=1)


def one_left_out(word: str) -> set[str]:
    """The word and the word with each of its letters left out: words one slip apart share one."""
    return {word} | {word[:k] + word[k + 1 :] for k in range(len(word))}


def core_keys(core: str, rows: int, bands: int, q: int) -> list[int]:
    """Keys by which a core meets others: letters left out up to SHORT, bands from SHORT on."""
    keys = [xxhash.xxh3_64_intdigest(w) - (1 << 63) for w in one_left_out(core)] if len(core) <= SHORT else []
    if len(core) >= SHORT:
        h = _min_hashes(core, rows * bands, q).reshape(bands, rows)
        keys += [xxhash.xxh3_64_intdigest(h[k].tobytes(), seed=k + 1) - (1 << 63) for k in range(bands)]
    return keys


def core_pairs(cores: DataFrame, q: int = 3) -> DataFrame:
    """(core_a, core_b) of different cores that are as many slips apart as their lengths allow."""
    rows, bands = banding()

    def sign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(w, h) for w in pdf["core"].tolist() for h in core_keys(w, rows, bands, q)]
            yield pd.DataFrame(out, columns=["core", "band"])

    def close(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(a, b) for a, b in zip(pdf["core_a"].tolist(), pdf["core_b"].tolist(), strict=True) if slips(a, b)], columns=["core_a", "core_b"], dtype=object)

    spread = int(cores.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    signed = settle(cores.filter(F.length("core") >= ONE_SLIP).repartition(spread, F.xxhash64("core")).mapInPandas(sign, "core string, band long"))
    left, right = signed.withColumnRenamed("core", "core_a"), signed.withColumnRenamed("core", "core_b")
    met = left.join(right, "band").filter("core_a < core_b and abs(length(core_a) - length(core_b)) <= 2").filter(F.levenshtein("core_a", "core_b", 4) >= 0).select("core_a", "core_b")
    return met.mapInPandas(close, "core_a string, core_b string").distinct()


def stars(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, star) by star clustering of nodes (id, weight) and undirected edges (a, b, sim).

    A node is a star once no free neighbour outweighs it (ties to the smaller id); it takes every
    free neighbour, and a node wanted by several stars goes to the most similar, then heaviest one.
    Every round makes the heaviest free node a star, so the rounds end.
    """
    wa = nodes.select(F.col("id").alias("a"), F.col("weight").alias("wa"))
    wb = nodes.select(F.col("id").alias("b"), F.col("weight").alias("wb"))
    both = edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    live = settle(both.join(wa, "a").join(wb, "b").select("a", "b", "sim", "wa", "wb"))
    found: list[DataFrame] = []
    while not live.isEmpty():
        top = live.groupBy("a").agg(F.min(F.struct(-F.col("wb"), F.col("b"))).alias("rival"), F.first("wa").alias("wa"))
        heads = top.filter(F.struct(-F.col("wa"), F.col("a")) < F.col("rival")).select(F.col("a").alias("head"))
        taken = live.join(heads, live["b"] == heads["head"]).groupBy("a").agg(F.max(F.struct("sim", "wb", "b")).getField("b").alias("star"))
        done = settle(heads.select(F.col("head").alias("id"), F.col("head").alias("star")).unionByName(taken.select(F.col("a").alias("id"), "star")))
        found.append(done)
        gone = done.select("id")
        live = settle(live.join(gone.withColumnRenamed("id", "a"), "a", "left_anti").join(gone.withColumnRenamed("id", "b"), "b", "left_anti").select("a", "b", "sim", "wa", "wb"))
    out = nodes.select("id")
    if not found:
        return out.withColumn("star", F.col("id"))
    every = found[0]
    for part in found[1:]:
        every = every.unionByName(part)
    return out.join(every, "id", "left").select("id", F.coalesce("star", "id").alias("star"))


def name_spellings(listings: DataFrame) -> DataFrame:
    """(name, n): every spelling that a listing names, with its number of listings."""
    single = unpack.latest_field(listings, "listing_id", "authors", "loaded_at")
    values = unpack.unpack(single, "authors", ("listing_id",), "name")
    return values.filter("name <> ''").groupBy("name").agg(F.countDistinct("listing_id").alias("n"))


def name_words(spellings: DataFrame) -> DataFrame:
    """(name, n, words, pair): the folded words of every spelling, and of one of just two words, not
    counting what is bracketed or quoted, the word in the given name's place and the other one."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, n in zip(pdf["name"].tolist(), pdf["n"].tolist(), strict=True):
                folded = fold(name)
                two = [w for w in WORD.findall(BRACKETED.sub(" ", folded)) if len(w.rstrip(".")) > 1 and w != "&"]
                pair = (two[::-1] if "," in name else two) if len(two) == 2 else None
                rows.append((name, n, sorted({w.rstrip(".") for w in WORD.findall(folded)}), pair))
            yield pd.DataFrame(rows, columns=["name", "n", "words", "pair"], dtype=object)

    return spellings.select("name", "n").mapInPandas(run, "name string, n long, words array<string>, pair array<string>")


def given_names(worded: DataFrame) -> DataFrame:
    """(word): words that mostly stand where given names stand, beside many different words."""
    pair = worded.filter("pair is not null").select(F.element_at("pair", 1).alias("x"), F.element_at("pair", 2).alias("y"))
    seen = pair.select(F.col("x").alias("word"), F.lit(1).alias("g"), F.col("y").alias("beside")).unionByName(pair.select(F.col("y").alias("word"), F.lit(0).alias("g"), F.col("x").alias("beside")))
    return seen.groupBy("word").agg(F.sum("g").alias("g"), F.count("*").alias("n"), F.countDistinct("beside").alias("d")).filter("d >= 8 and g >= 0.7 * n").select("word")


def meeting_keys(got: tuple, formals: dict) -> tuple[list[str], list[str]]:
    """(whole, initials): keys by which signatures of one core meet.

    Whole given names meet by the name, its known long forms, a quoted name and its long forms, and the
    name with a letter left out (two, if it is long); initials meet all that may start with them;
    organisations meet by the first letters of their other words.
    """
    if got[0] == "org":
        return sorted({"o" + w[0] for w in got[5].split()}), []
    given = got[2]
    if len(given) <= 1:
        return [], ["i" + given] if given else []
    keys = {given} | formals.get(given, frozenset())
    if got[5]:
        keys |= {got[5]} | formals.get(got[5], frozenset())
    if len(given) >= ONE_SLIP:
        keys |= one_left_out(given)
    if len(given) >= TWO_SLIPS:
        keys |= {w for v in one_left_out(given) for w in one_left_out(v)}
    return sorted("g" + k for k in keys), sorted({"i" + given[0]} | {"i" + f[0] for f in formals.get(given, ())})


def link_names(spellings: DataFrame, nicknames: DataFrame) -> DataFrame:
    """(name, star): spellings with the cluster they belong to; names that cannot be read are left out.

    Which of a spelling's words are given names comes from a join with all words that stand like given
    names. The known short forms are a small fixed table; more than ``MOST_FORMS`` are refused.
    """
    known = nicknames.filter("formal_name is not null and short_name is not null").select("formal_name", "short_name").distinct().limit(MOST_FORMS + 1).collect()
    if len(known) > MOST_FORMS:
        raise ValueError(f"more than {MOST_FORMS} short forms")
    formals: dict[str, set[str]] = {}
    for r in known:
        formals.setdefault(fold(r[1]), set()).add(fold(r[0]))
    formals = {k: frozenset(v) for k, v in formals.items()}
    named = frozenset(f for v in formals.values() for f in v) | frozenset(formals)

    worded = settle(name_words(spellings))
    word = worded.select("name", F.explode("words").alias("word")).join(given_names(worded), "word").groupBy("name").agg(F.collect_set("word").alias("given"))
    # Few bytes but much work: the reading is spread by count, which adaptive execution leaves alone.
    spread = int(spellings.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    flagged = worded.select("name", "n").join(word, "name", "left").repartition(spread, F.xxhash64("name"))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for name, n, own in zip(pdf["name"].tolist(), pdf["n"].tolist(), pdf["given"].tolist(), strict=True):
                got = read_name(name, named if own is None else named.union(own), formals)
                if got:
                    rows.append((name, n, "\x1f".join(got), got[0], got[1], *meeting_keys(got, formals), len(got[2]) > 1 and not formals.get(got[2])))
            yield pd.DataFrame(rows, columns=["name", "n", "id", "kind", "core", "keys", "initials", "whole"], dtype=object)

    read_names = settle(flagged.mapInPandas(read, "name string, n long, id string, kind string, core string, keys array<string>, initials array<string>, whole boolean"))
    nodes = settle(
        read_names.groupBy("id").agg(F.first("kind").alias("kind"), F.first("core").alias("core"), F.first("keys").alias("keys"), F.first("initials").alias("initials"), F.sum("n").alias("n"), F.first("whole").alias("whole"))
    )
    pairs = settle(core_pairs(nodes.select("core").distinct()))
    # Cores that met others lend their signatures to them; every signature also stands under its own.
    wide = pairs.select(F.col("core_a").alias("core"), F.col("core_b").alias("under")).unionByName(pairs.select(F.col("core_b").alias("core"), F.col("core_a").alias("under")))
    full, short = F.size("keys") > 0, F.size("keys") == 0

    def under(side: DataFrame, keys: str, name: str) -> DataFrame:
        keyed = side.select(F.col("id").alias(name), "core", F.explode(keys).alias("key"))
        lent = keyed.join(wide, "core").select(name, F.col("under").alias("core"), "key")
        return keyed.unionByName(lent)

    own = lambda side, keys, name: side.select(F.col("id").alias(name), "core", F.explode(keys).alias("key"))
    # A pair of met cores is found from either side, so one side stands under its own core only.
    met = own(nodes.filter(full), "keys", "a").join(under(nodes.filter(full), "keys", "b"), ["core", "key"]).select("a", "b")
    met = met.unionByName(under(nodes.filter(short), "initials", "a").join(own(nodes, "initials", "b"), ["core", "key"]).select("a", "b"))
    met = met.filter("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()

    def verify(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for a, b in zip(pdf["a"].tolist(), pdf["b"].tolist(), strict=True):
                s = monge_elkan(tuple(a.split("\x1f")), tuple(b.split("\x1f")), formals)
                if s >= THRESHOLD:
                    rows.append((a, b, s))
            yield pd.DataFrame(rows, columns=["a", "b", "sim"])

    edges = settle(met.mapInPandas(verify, "a string, b string, sim double"))
    weight = F.when(F.col("whole") | (F.col("kind") == "org"), 1_000_000_000).otherwise(0) + F.col("n")
    weighed = nodes.select("id", weight.alias("weight"), "whole", "kind")
    clear = _without_ambiguous(weighed, edges)
    star = stars(weighed, clear)
    return read_names.join(star, "id").select("name", "star")


def _without_ambiguous(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Edges without those of initials and short forms that fit whole names which contradict each other."""
    both = edges.select("a", "b", "sim").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))
    part = F.split("id", "\x1f")
    whole = nodes.filter("whole").select(F.col("id").alias("b"), part[2].alias("given"), part[3].alias("middle"), F.col("weight"))
    vague = nodes.filter("not whole and kind = 'person'").select(F.col("id").alias("a"))
    around = both.join(vague, "a").join(whole, "b")
    heaviest = around.groupBy("a").agg(F.max(F.struct("weight", "given", "middle", "b")).alias("top"))
    given, middle, top = F.col("given"), F.col("middle"), F.col("top")

    @F.pandas_udf("boolean")
    def differ(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([x != y and not slips(x, y) for x, y in zip(a.tolist(), b.tolist(), strict=True)], dtype="bool")

    clash = differ(given, top["given"]) | ((middle != "") & (top["middle"] != "") & (middle != top["middle"]))
    torn = around.join(heaviest, "a").filter(clash).select("a").distinct()
    marked = edges.join(torn.withColumn("ta", F.lit(True)), "a", "left").join(torn.select(F.col("a").alias("b"), F.lit(True).alias("tb")), "b", "left")
    return marked.filter("ta is null and tb is null").select("a", "b", "sim")


def name_pairs(clusters: DataFrame) -> DataFrame:
    """(name_a, name_b) of different spellings of one cluster, the smaller one first."""
    left = clusters.select(F.col("name").alias("name_a"), "star")
    right = clusters.select(F.col("name").alias("name_b"), "star")
    return left.join(right, "star").filter("name_a < name_b").select("name_a", "name_b").distinct()

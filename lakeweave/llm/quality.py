"""Per-document text quality statistics, and which documents are not natural prose.

A text is read in runs of lines: lines with a lead sign, a leader, cell tags or a delimiter that their
neighbours share, and the lines between them, which are joined to paragraphs so that wrapped prose is
judged as a whole. Each run gets a layout weight from the vertical alignment of its delimiters, the
period after which its indentation and lead signs come back, and the autocorrelation of its line
lengths; and a reading weight from its share of common words, of closing punctuation and of letters in
words of usual length. A run is prose if reading outweighs layout, a document if enough of it is.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WORD = regex.compile(r"\p{Han}|[[\p{L}\p{M}]--\p{Han}]+(?:['’\-][[\p{L}\p{M}]--\p{Han}]+)*", regex.V1)
HAN = regex.compile(r"\p{Han}")
HAN_STOP = regex.compile(r"[。，！？；：]")
#: Bullets and enumerators that open a list entry.
LEAD = regex.compile(r"^\s*(?:[-*+•–—·▪◦‣»>]\s+|\(?\d{1,4}[.)\]]\s+|\[\d{1,4}\]\s*|\(?[a-zA-Z][.)]\s+|\w[\w ]{0,20}:\s)")
BLOCK_TAG = regex.compile(r"</?(?:table|tr|td|th|li|ul|ol|dl|dt|dd|select|option)\b[^>]*>", regex.I)
TAG = regex.compile(r"<[^<>]{0,200}>|(?:https?://|www\.)\S+")
GAP = regex.compile(r"(?<=\S)(?: {2,}|\t+)(?=\S)")
LEADER = regex.compile(r"(?:\.\s?){4,}|_{4,}")
ENDS = regex.compile(r"[.!?。！？…;:][\"'”’»)\]]*$")
DELIMITERS = "|\t,;:="
CLOSE = regex.compile(r"[.!?…][\"'”’»)\]]*(?=\s|$)|[。！？]")
NOT_ALNUM = re.compile(r"[\W_]+")
#: Common words from this share on give the full weight; cells of a list or table hold few words.
COMMON_SHARE, CELL_WORDS, LETTER_SHARE = 0.17, 4, 0.8
#: Words that one closing mark covers, and lengths of usual words on average.
SENTENCE_WORDS, WORD_LENGTHS = 40, (1.8, 12.0)
#: Weights of reading (common words, closing marks, letters), of layout and of length autocorrelation;
#: what reading must reach after layout is taken off, and the share of a document that must be prose.
COMMON_WEIGHT, CLOSE_WEIGHT, LETTER_WEIGHT, LAYOUT_WEIGHT, LENGTH_WEIGHT = 1.0, 0.5, 0.5, 1.2, 0.3
PROSE_WEIGHT, DOCUMENT_SHARE = 1.0, 0.34
#: The common words of all languages go to every worker; a larger table is refused.
MOST_WORDS = 100_000


def visible_size(text: str) -> int:
    return len("".join(text.split()))


def spread(line: str) -> int:
    """Words of a line; two Han characters count as one."""
    return len(line.split()) + (0 if line.isascii() else len(HAN.findall(line)) // 2)


def cells(line: str) -> float:
    """Part of a line that stands in short cells: 1 for five entries of few words, less for fewer."""
    best = 0.0
    for d in ",;|\t":
        n = line.count(d)
        if n >= 2 and spread(line) <= CELL_WORDS * (n + 1):
            best = max(best, min(1.0, (n + 1) / 5))
    return best


def alignment(lines: list[str]) -> float:
    """Largest share of lines in which one delimiter stands equally often between short cells, or gaps
    in equal columns; of a single line, the part that stands in short cells."""
    n = len(lines)
    if n < 2:
        return cells(lines[0]) if lines else 0.0
    words = [spread(line) for line in lines]
    best = 0
    for d in DELIMITERS:
        counts = Counter(c for c, w in ((line.count(d), w) for line, w in zip(lines, words, strict=True)) if c and w <= CELL_WORDS * (c + 1))
        if counts:
            best = max(best, max(counts.values()))
    starts = Counter(m.end() for line in lines for m in GAP.finditer(line))
    if starts:
        best = max(best, max(starts.values()))
    return max(best / n, sum(cells(line) * w for line, w in zip(lines, words, strict=True)) / max(1, sum(words)))


def periodicity(lines: list[str]) -> float:
    """Share of lines whose indentation and lead sign come back after the best period of 1 to 6."""
    n = len(lines)
    if n < 3:
        return 0.0
    marks = [(len(line) - len(line.lstrip()), bool(LEAD.match(line))) for line in lines]
    if not any(m != (0, False) for m in marks):
        return 0.0
    return max(sum(marks[k] == marks[k - p] and marks[k] != (0, False) for k in range(p, n)) / (n - p) for p in range(1, min(7, n)))


def length_autocorrelation(lines: list[str]) -> float:
    """Largest autocorrelation of the line lengths at lags 1 to 6; 1 if all are equal."""
    n = len(lines)
    if n < 4:
        return 0.0
    x = np.fromiter((len(line) for line in lines), "f8", n)
    x = x - x.mean()
    power = float(x @ x)
    if power < 1e-9:
        return 1.0
    return max(float(x[p:] @ x[:-p]) / power for p in range(1, min(7, n - 1)))


def runs(lines: list[str]) -> list[list[str]]:
    """Lines cut into runs: marked lines (a lead sign, a leader, cell tags, a delimiter or gaps that a
    neighbour shares) and the lines between them."""
    out: list[list[str]] = []
    before = None
    shape = [(line.count("|"), line.count("\t"), len(GAP.findall(line))) for line in lines]
    for k, line in enumerate(lines):
        near = [shape[j] for j in (k - 1, k + 1) if 0 <= j < len(lines)]
        marked = bool(LEAD.match(line) or LEADER.search(line) or BLOCK_TAG.search(line))
        marked |= any(shape[k][i] and any(s[i] == shape[k][i] for s in near) for i in (0, 1)) or shape[k][2] >= 2
        if marked == before:
            out[-1].append(line)
        else:
            out.append([line])
        before = marked
    return out


def layout(lines: list[str]) -> float:
    """Weight of the layout of a run: 0 for text, about 1 for a table or list."""
    text = "\n".join(lines)
    tags = len(BLOCK_TAG.findall(text))
    tagged = float(tags >= 4 and tags * 12 > len(TAG.sub(" ", text).split()))
    led = len(LEADER.findall(text)) / len(lines)
    return max(alignment(lines), periodicity(lines), tagged, min(1.0, led)) + LENGTH_WEIGHT * max(0.0, length_autocorrelation(lines))


def reading(text: str, common: frozenset) -> float:
    """Weight of a run as text to be read: common words, closing marks, letters in usual words."""
    bare = TAG.sub(" ", text)
    words = WORD.findall(bare)
    visible = visible_size(bare)
    if not words or not visible:
        return 0.0
    han = len(HAN.findall(bare))
    if han > 0.4 * visible:
        known = 1.0 if HAN_STOP.search(bare) or han >= 12 else 0.0
        return COMMON_WEIGHT * known + CLOSE_WEIGHT * min(1.0, len(HAN_STOP.findall(bare)) * SENTENCE_WORDS / han) + LETTER_WEIGHT
    lowered = [w.lower() for w in words]
    hits = [w for w in lowered if len(w) > 1 and w in common]
    known = min(1.0, len(hits) / (COMMON_SHARE * len(words))) if len(set(hits)) >= min(2, len(words)) else 0.0
    closes = min(1.0, len(CLOSE.findall(bare)) * SENTENCE_WORDS / len(words))
    letters = sum(map(len, words))
    usual = letters >= LETTER_SHARE * visible and WORD_LENGTHS[0] <= letters / len(words) <= WORD_LENGTHS[1]
    return COMMON_WEIGHT * known + CLOSE_WEIGHT * closes + LETTER_WEIGHT * usual


def prose_size(run: list[str], common: frozenset) -> int:
    """Visible characters of the run's paragraphs whose reading weight outweighs the run's layout. A
    paragraph ends with a line that closes a sentence."""
    least = PROSE_WEIGHT + LAYOUT_WEIGHT * layout(run)
    out, paragraph = 0, []
    for k, line in enumerate(run):
        paragraph.append(line)
        if k == len(run) - 1 or ENDS.search(line.rstrip()):
            if reading(" ".join(LEAD.sub("", x, count=1) for x in paragraph), common) >= least:
                out += sum(map(visible_size, paragraph))
            paragraph = []
    return out


def statistics(text: str | None, common: frozenset) -> dict:
    """All statistics of one text; a null, empty or blank text has zeros and counts as prose."""
    zero = dict(n_words=0, mean_word_length=0.0, symbol_ratio=0.0, punct_line_share=0.0, common_share=0.0, alignment=0.0, periodicity=0.0, length_autocorrelation=0.0, prose_share=0.0, not_prose=False)
    if not text or not text.strip():
        return zero
    words = WORD.findall(text)
    visible = visible_size(text)
    lines = [line for line in text.splitlines() if line.strip()]
    prose = 0
    for part in regex.split(r"\n[^\S\n]*\n", text):
        for run in runs([line for line in part.splitlines() if line.strip()]):
            prose += prose_size(run, common)
    share = prose / visible
    return dict(
        n_words=len(words),
        mean_word_length=sum(map(len, words)) / len(words) if words else 0.0,
        symbol_ratio=(visible - len(NOT_ALNUM.sub("", text))) / visible,
        punct_line_share=sum(bool(ENDS.search(line.rstrip())) for line in lines) / max(1, len(lines)),
        common_share=sum(w.lower() in common for w in words) / max(1, len(words)),
        alignment=alignment(lines),
        periodicity=periodicity(lines),
        length_autocorrelation=length_autocorrelation(lines),
        prose_share=share,
        not_prose=share < DOCUMENT_SHARE,
    )


SCHEMA = "n_words int, mean_word_length double, symbol_ratio double, punct_line_share double, common_share double, alignment double, periodicity double, length_autocorrelation double, prose_share double, not_prose boolean"


def document_quality(documents: DataFrame, words: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key`` and the statistics of each row's whole text, one map over the partitions.

    The common words of all languages are one fixed, small table and go to the workers as a set; more
    than ``MOST_WORDS`` of them are refused. Null, empty and blank texts get zeros. Repeated rows stay; extra columns are not read.
    """
    found = words.select("word").filter("word is not null").distinct().limit(MOST_WORDS + 1).collect()
    if len(found) > MOST_WORDS:
        raise ValueError(f"the table of common words holds more than {MOST_WORDS} words")
    common = frozenset(r[0].lower() for r in found)
    slim = documents.select(F.col(key).alias("__key"), F.col(text).alias("__text"))
    schema = f"__key {slim.schema['__key'].dataType.simpleString()}, {SCHEMA}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            got = pd.DataFrame([statistics(t if isinstance(t, str) else None, common) for t in pdf["__text"]], columns=[c.split()[0] for c in SCHEMA.split(", ")])
            got.insert(0, "__key", pdf["__key"].to_numpy())
            yield got

    return slim.mapInPandas(run, schema).withColumnRenamed("__key", key)

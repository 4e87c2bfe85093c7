"""Encoding of a corpus with a public byte-level BPE by monoid tree reduction.

A text is halved until a piece is at most ``leaf_chars`` long. Leaves are encoded directly.
Two neighbours are joined by encoding a window around their seam again: it begins at the first
word of the left part whose extent could still change, and grows to the right until one of its
word ends falls on a word start of the right part. The word splitter of these vocabularies looks
at nothing before the place where a word starts, so from such a meeting point on the right part's
tokens are those of the whole text, and tokens before the window never saw the seam.
"""

from __future__ import annotations

import json
import os
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Code points a leaf holds at most.
LEAF_CHARS = 4096
#: The longest look-ahead of the word splitter: a contraction is an apostrophe and two letters.
AHEAD = 3


def vocabulary_path(name: str = "byte_bpe_50k.json", folder: str | None = None) -> str:
    """Place of a public vocabulary file; ``folder`` or LAKEWEAVE_TOKENIZERS overrides it."""
    return os.path.join(folder or os.environ.get("LAKEWEAVE_TOKENIZERS", "/opt/tokenizers"), name)


class Piece:
    """Tokens of one stretch of text: word starts (code points from its begin) and each word's ids."""

    __slots__ = ("end", "ids", "starts", "text", "words")

    def __init__(self, text: str, starts: list[int], words: list[list[int]]):
        self.text, self.starts, self.words = text, starts, words

    def flat(self) -> list[int]:
        return [i for w in self.words for i in w]


class Coder:
    """Encodes by leaves and seams. One per Python worker; the vocabulary is read once."""

    _loaded: dict[str, Coder] = {}

    def __init__(self, path: str, leaf_chars: int = LEAF_CHARS):
        from tokenizers import Tokenizer

        self.path, self.leaf_chars = path, leaf_chars
        self.model = Tokenizer.from_file(path)
        self._check()
        self.model.encode_special_tokens = True

    @classmethod
    def of(cls, path: str, leaf_chars: int = LEAF_CHARS) -> Coder:
        key = f"{path}|{leaf_chars}"
        if key not in cls._loaded:
            os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
            cls._loaded[key] = cls(path, leaf_chars)
        return cls._loaded[key]

    def _check(self) -> None:
        """Refuse vocabularies for which ``settled`` does not hold: it is proved for byte-level pieces
        of the contraction splitter, without a normaliser and without a blank put in front."""
        with open(self.path, encoding="utf-8") as f:
            known = json.load(f)
        splitter = known.get("pre_tokenizer") or {}
        if splitter.get("type") != "ByteLevel" or not splitter.get("use_regex", True) or splitter.get("add_prefix_space") or known.get("normalizer"):
            raise ValueError(f"{self.path}: only byte-level vocabularies with the contraction splitter and no normaliser can be encoded in parts")

    def scan(self, text: str) -> Piece:
        got = self.model.encode(text, add_special_tokens=False)
        return self._piece(text, got)

    @staticmethod
    def _piece(text: str, got) -> Piece:
        starts, words, last = [], [], None
        for i, w, (a, _) in zip(got.ids, got.word_ids, got.offsets, strict=True):
            if w != last:
                starts.append(a)
                words.append([i])
                last = w
            else:
                words[-1].append(i)
        return Piece(text, starts, words)

    @staticmethod
    def settled(piece: Piece) -> int:
        """Number of leading words that no following text can change: the splitter saw their end.

        A word whose end is the end of the text may go on. White space takes its extent from the
        whole run behind it. A word that begins with an apostrophe looks two letters ahead.
        """
        text, starts, n = piece.text, piece.starts, len(piece.text)
        solid = len(text.rstrip())
        k = len(starts)
        while k:
            end = starts[k] if k < len(starts) else n
            if end < n and starts[k - 1] + AHEAD <= n and end <= solid:
                break
            k -= 1
        return k

    def join(self, left: Piece, right: Piece) -> Piece:
        if not left.text:
            return right
        if not right.text:
            return left
        keep = self.settled(left)
        begin = left.starts[keep] if keep < len(left.starts) else len(left.text)
        tail, width = left.text[begin:], 64
        while True:
            width = min(width, len(right.text))
            window = self.scan(tail + right.text[:width])
            whole = width == len(right.text)
            sure = len(window.starts) if whole else self.settled(window)
            for k in range(sure):
                end = window.starts[k + 1] if k + 1 < len(window.starts) else len(window.text)
                at = end - len(tail)
                if at < 0:
                    continue
                j = bisect_left(right.starts, at)
                meets = at == len(right.text) or (j < len(right.starts) and right.starts[j] == at)
                if meets:
                    return self._glue(left, keep, begin, window, k + 1, right, j if at < len(right.text) else len(right.starts))
            width *= 2

    @staticmethod
    def _glue(left: Piece, keep: int, begin: int, window: Piece, upto: int, right: Piece, j: int) -> Piece:
        shift = len(left.text)
        starts = left.starts[:keep] + [begin + s for s in window.starts[:upto]] + [shift + s for s in right.starts[j:]]
        return Piece(left.text + right.text, starts, left.words[:keep] + window.words[:upto] + right.words[j:])

    def reduce(self, text: str) -> Piece:
        """Leaves are encoded, then neighbours are joined level by level (a balanced tree)."""
        size = self.leaf_chars
        level = [self.scan(text[a : a + size]) for a in range(0, len(text), size)] or [Piece("", [], [])]
        while len(level) > 1:
            level = [self.join(level[i], level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
        return level[0]

    def encode_many(self, texts: list[str | None]) -> list[list[int]]:
        """Ids of each text; null and empty texts give an empty list."""
        out: list[list[int]] = [[] for _ in texts]
        short = [k for k, t in enumerate(texts) if t and len(t) <= self.leaf_chars]
        for k, got in zip(short, self.model.encode_batch_fast([texts[k] for k in short], add_special_tokens=False), strict=True):
            out[k] = got.ids
        for k, t in enumerate(texts):
            if t and len(t) > self.leaf_chars:
                out[k] = self.reduce(t).flat()
        return out

    def bytes_of(self) -> list[bytes]:
        """The bytes each id stands for, from the vocabulary's printable alphabet."""
        if not hasattr(self, "_bytes"):
            keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
            rest = [b for b in range(256) if b not in set(keep)]
            back = {chr(b): b for b in keep} | {chr(256 + k): b for k, b in enumerate(rest)}
            with open(self.path, encoding="utf-8") as f:
                vocab = json.load(f)["model"]["vocab"]
            table = [b""] * (max(vocab.values()) + 1)
            for piece, i in vocab.items():
                table[i] = bytes(back[c] for c in piece) if all(c in back for c in piece) else piece.encode()
            self._bytes = table
        return self._bytes

    def decode(self, ids: list[int]) -> str:
        """Bytes of the halves are concatenated up the tree and read as UTF-8 at its root."""
        table = self.bytes_of()

        def up(a: int, b: int) -> bytes:
            if b - a <= 1024:
                return b"".join(table[i] for i in ids[a:b])
            m = (a + b) // 2
            return up(a, m) + up(m, b)

        return up(0, len(ids)).decode("utf-8", errors="replace")


def encode_documents(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), out: str = "ids", tokenizer: str | None = None, leaf_chars: int = LEAF_CHARS) -> DataFrame:
    """``keys`` and the ids of ``text`` (array<int>), one row per input row, without special tokens.

    A map over partitions: no shuffle, and only the key and text columns are read. Null and empty
    texts give an empty list; the strings of special tokens in a text are ordinary text; other
    columns, whatever their names, are dropped before the map. Repeated rows stay.
    """
    path = tokenizer or vocabulary_path()
    slim = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    schema = T.StructType([*[slim.schema[k] for k in keys], T.StructField(out, T.ArrayType(T.IntegerType(), False), False)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder.of(path, leaf_chars)
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["__text"]]
            yield pdf.drop(columns="__text").assign(**{out: coder.encode_many(texts)})

    return slim.mapInPandas(run, schema)


def count_tokens(df: DataFrame, text: str = "text", keys: tuple[str, ...] = ("doc_id",), out: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """``keys`` and the number of tokens of ``text``; the ids never leave the Python worker."""
    path = tokenizer or vocabulary_path()
    slim = df.select(*[F.col(k) for k in keys], F.col(text).alias("__text"))
    schema = T.StructType([*[slim.schema[k] for k in keys], T.StructField(out, T.LongType(), False)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder.of(path)
        for pdf in batches:
            texts = [t if isinstance(t, str) else None for t in pdf["__text"]]
            yield pdf.drop(columns="__text").assign(**{out: [len(x) for x in coder.encode_many(texts)]})

    return slim.mapInPandas(run, schema)


def decode_documents(df: DataFrame, ids: str = "ids", keys: tuple[str, ...] = ("doc_id",), out: str = "text", tokenizer: str | None = None) -> DataFrame:
    """The texts back from their ids; an empty or null list gives the empty text."""
    path = tokenizer or vocabulary_path()
    slim = df.select(*[F.col(k) for k in keys], F.col(ids).alias("__ids"))
    schema = T.StructType([*[slim.schema[k] for k in keys], T.StructField(out, T.StringType(), False)])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        coder = Coder.of(path)
        for pdf in batches:
            yield pdf.drop(columns="__ids").assign(**{out: [coder.decode(list(x)) if x is not None else "" for x in pdf["__ids"]]})

    return slim.mapInPandas(run, schema)

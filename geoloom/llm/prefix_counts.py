"""Operator 11: exact token counts of every prefix of a text, by dynamic programming.

The encoding of a prefix ends in the one token that stands next to the encoding of what is before
it as the vocabulary's own merges leave the two: then count(prefix) = count(before) + 1.  So one
walk over a text counts all its prefixes, and questions of budgets and truncation are answered
from the stored counts, without encoding again.

Nulls: a null text is empty, a null doc_id stays null.  Empty texts have no prefix but the empty
one, of 0 tokens.  Repeated rows are counted each by itself, an empty table gives an empty one, and
of the table only doc_id and text are read, so further columns clash with nothing.  Texts of any
length are worked on whole.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from .chunks import Remembered, by_size, cut, open_ended
from .staging import small_batches

#: Contractions that are one piece but whose first two characters are two (fixed values).
LONG_CONTRACTIONS = ("'re", "'ve", "'ll")
#: Pairs of tokens whose outcome a process remembers; bytes of texts that are worked on at once.
PAIRS, AT_ONCE = 1_000_000, 1 << 20
_RUN = re.compile(r"\s\s+")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def check_byte_level(path: str) -> dict:
    """The file of a byte-level BPE as this module counts it; ValueError for any other."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    pre, model = said.get("pre_tokenizer") or {}, said["model"]
    plain = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space", True)
    odd = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
    added = [t for t in said.get("added_tokens", []) if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]]
    if model.get("type", "BPE") != "BPE" or said.get("normalizer") or not plain or odd or added:
        raise ValueError(f"{path} is no plain byte-level BPE")
    return said


class PrefixTokens:
    """Token counts of all prefixes, in a worker process."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        said = check_byte_level(path)
        tokenizer = Tokenizer.from_file(path)
        self.model, self.pre = tokenizer.model, tokenizer.pre_tokenizer
        names = said["model"]["vocab"]
        # tokens that the merges reach: only those end an encoding
        self.names = {i: name for name, i in names.items() if [t.id for t in self.model.tokenize(name)] == [i]}
        self.ends = ahocorasick.Automaton()
        for i, name in self.names.items():
            self.ends.add_word(name, (i, len(name)))
        self.ends.make_automaton()
        self.special = re.compile("|".join(re.escape(t["content"]) for t in sorted(said.get("added_tokens", []), key=lambda t: -len(t["content"]))) or r"(?!)")
        self.beside: dict[int, bool] = {}
        self.pieces = Remembered(self._pieces)
        self.chunks = Remembered(self._chunks)

    def _stay(self, key: int) -> bool:
        """Whether the merges leave two tokens, key >> 32 and key's lower half, as they are side by side."""
        a, b = key >> 32, key & 0xFFFFFFFF
        if len(self.beside) > PAIRS:
            self.beside.clear()
        known = self.beside[key] = [t.id for t in self.model.tokenize(self.names[a] + self.names[b])] == [a, b]
        return known

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        """Counts of the prefixes of 1, 2, ... bytes of each piece, in which a character stands for a byte."""
        # all pieces in a row, behind one character each that is in no token
        row = "\n" + "\n".join(pieces)
        begins = np.cumsum([1] + [len(x) + 1 for x in pieces])
        last, count = [-1] * (len(row) + 1), [0] * (len(row) + 1)
        for k in begins[:-1].tolist():
            last[k] = -2
        beside, stay = self.beside, self._stay
        for end, (token, size) in self.ends.iter(row):  # longest first at each end
            p = end + 1
            if last[p] == -1:
                before = last[p - size]
                if before == -2:
                    last[p], count[p] = token, 1
                elif before >= 0:
                    key = before << 32 | token
                    known = beside.get(key)
                    if known or (known is None and stay(key)):
                        last[p], count[p] = token, count[p - size] + 1
        raw, at = np.array(count, "<u4").tobytes(), (4 * begins).tolist()
        return [raw[a + 4 : b] for a, b in zip(at, at[1:])]

    def _walk(self, text: str) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... characters of a text, piece by piece."""
        if not text:
            return np.empty(0, np.int64)
        found = self.pre.pre_tokenize_str(text)
        pieces = [x for x, _ in found]
        parts = self.pieces.of([pieces])[0]
        counts = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
        sizes = np.fromiter(map(len, pieces), np.int64, len(pieces))
        ends = np.cumsum(sizes)
        base = np.cumsum(counts[ends - 1]) - counts[ends - 1]
        counts += np.repeat(base, sizes)
        raw = np.frombuffer(text.encode(), np.uint8)
        if len(raw) > len(text):  # a character's count is that of its last byte
            counts = counts[np.append((raw[1:] & 0xC0) != 0x80, True)]
        for k in [k for k, x in enumerate(pieces) if x in LONG_CONTRACTIONS]:
            # cut behind two characters it is none: a mark and a letter
            a = found[k][1][0]
            counts[a + 1] = base[k] + self._walk(text[a])[-1] + self._walk(text[a + 1])[-1]
        for run in _RUN.finditer(text):  # white space at the end of a prefix is one piece
            a, b = run.span()
            if b < len(text):
                counts[a:b] = (counts[a - 1] if a else 0) + self._walk(text[a:b])
        return counts

    def _chunks(self, chunks: list[str]) -> list[bytes]:
        """Counts of the prefixes of 1, 2, ... characters of each chunk with its space in front."""
        if any(map(open_ended, chunks)):
            alone = {k: self._walk(" " + c).astype("<u4").tobytes() for k, c in enumerate(chunks) if open_ended(c)}
            rest = iter(self._chunks([c for k, c in enumerate(chunks) if k not in alone]))
            return [alone[k] if k in alone else next(rest) for k in range(len(chunks))]
        if not chunks:
            return []
        counts = self._walk(" " + " ".join(chunks))
        ends = np.cumsum([len(x) + 1 for x in chunks])
        base = np.append(0, counts[ends[:-1] - 1])
        raw = (counts - np.repeat(base, np.diff(ends, prepend=0))).astype("<u4").tobytes()
        at = (4 * np.append(0, ends)).tolist()
        return [raw[a:b] for a, b in zip(at, at[1:])]

    def _plain(self, text: str, chunks: list[str] | None = None) -> np.ndarray:
        """Counts of the prefixes of 1, 2, ... characters, special strings as plain text."""
        if not text:
            return np.empty(0, np.int64)
        first, *rest = chunks or cut(text)
        parts = [self._walk(first).astype("<u4").tobytes(), *self.chunks.of([rest])[0]]
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        counts = np.frombuffer(b"".join(parts), "<u4").astype(np.int64)
        totals = counts[np.cumsum(sizes) - 1]
        return counts + np.repeat(np.cumsum(totals) - totals, sizes)

    def counts(self, text: str, chunks: list[str] | None = None) -> np.ndarray:
        """Token counts of the prefixes of 1, 2, ... characters, each as the library encodes that prefix."""
        if not self.special.search(text):
            return self._plain(text, chunks)
        out, base, begin = [], 0, 0
        for found in self.special.finditer(text):
            # cut inside the special string, a prefix ends in plain characters
            part = self._plain(text[begin : found.end() - 1])
            whole = (part[found.start() - begin - 1] if found.start() > begin else 0) + 1
            out += [base + part, np.array([base + whole])]
            base, begin = base + int(whole), found.end()
        return np.concatenate([*out, base + self._plain(text[begin:])]).astype(np.int64)

    def of(self, texts: list[str]) -> list[np.ndarray]:
        """``counts`` of each text; their chunks are learned together, which is quicker than one text after another."""
        cuts = [cut(t) for t in texts]
        self.chunks.learn(set().union(*[c[1:] for c in cuts]))
        return [self.counts(t, c) for t, c in zip(texts, cuts)]


_loaded: dict[str, PrefixTokens] = {}


def prefix_tokens(path: str) -> PrefixTokens:
    """The counter of this worker process, with the chunks it has met in earlier tasks."""
    if path not in _loaded:
        _loaded[path] = PrefixTokens(path)
    return _loaded[path]


def prefix_counts(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes (UTF-8), n_chars, and ``counts``: of every prefix of 1 .. n_chars characters
    its exact number of tokens, as big-endian unsigned 32-bit integers.

    No shuffle; ``tokenizer`` is the file of a byte-level BPE, added special tokens inside a text count
    as the library's default has them: one token each.
    """
    path = tokenizer or default_tokenizer()
    check_byte_level(path)
    schema = "doc_id long, n_bytes long, n_chars long, counts binary"
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = prefix_tokens(path)
        for batch in by_size(batches, AT_ONCE):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            counts = [c.astype(">u4").tobytes() for c in counter.of(texts)]
            columns = [batch.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(list(map(len, texts)), pa.int64()), pa.array(counts, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "n_chars", "counts"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(work, schema)


def tokens_at(chars: Column | str, counts: Column | str = "counts") -> Column:
    """The tokens of the prefix of so many characters, from the stored counts; null beyond the text."""
    counts, chars = (F.col(c) if isinstance(c, str) else c for c in (counts, chars))
    at = F.conv(F.hex(F.substring(counts, (4 * chars - 3).cast("int"), F.lit(4))), 16, 10).cast("long")
    return F.when(chars == 0, F.lit(0).cast("long")).when((chars > 0) & (4 * chars <= F.octet_length(counts)), at)


@F.pandas_udf(LongType())
def chars_within(counts: pd.Series, budget: pd.Series) -> pd.Series:
    """The longest prefix, in characters, of at most so many tokens, from the stored counts."""

    def longest(raw: bytes | None, most: float) -> int | None:
        if raw is None or most is None or most != most:
            return None
        fits = np.flatnonzero(np.frombuffer(raw, ">u4") <= most)
        return int(fits[-1]) + 1 if len(fits) else 0

    return pd.Series([longest(c, b) for c, b in zip(counts, budget)], dtype="Int64")


def token_totals(docs: DataFrame, limit: int = 512, tokenizer: str | None = None) -> DataFrame:
    """Per row: doc_id, n_bytes, n_tokens of the whole text, over_limit (n_tokens > limit), from the counts of its prefixes."""
    counted = prefix_counts(docs, tokenizer).select("doc_id", "n_bytes", tokens_at("n_chars").alias("n_tokens"))
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)

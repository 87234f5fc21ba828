"""Token ids of whole texts, by the tokenizers library, inside tasks.

With a tokenizer that lower-cases, drops white space and ends words with ``</w>``, as
``word_bpe_49k`` does, a text is cut at ASCII white space, and each distinct lower-cased word is
encoded by the library once per worker process and remembered.  Any other tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from .words import slices, texts

#: Words that a process remembers as recent; past it, these become the older ones and the older go.
MAX_WORDS = 400_000
#: A special token of the vocabulary, used between words that are encoded in one call.
BETWEEN, MARK = "<|endoftext|>", b"<|"


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _kinds(part: dict | None) -> list[str]:
    """The types of a normalizer or pre-tokenizer, a sequence's in order."""
    if not part:
        return []
    return [k for p in part.get("normalizers", part.get("pretokenizers", [])) for k in _kinds(p)] if part["type"] == "Sequence" else [part["type"]]


def words_alone(path: str) -> bool:
    """Whether a tokenizer's file says that words are lower-cased, cut at white space and encoded each by itself."""
    with open(path, encoding="utf-8") as f:
        said = json.load(f)
    special = {t["content"] for t in said.get("added_tokens", [])}
    folded = "Lowercase" in _kinds(said.get("normalizer"))
    cut = any(p.get("type") == "Split" and p.get("invert") and p.get("behavior") == "Removed" for p in (said.get("pre_tokenizer") or {}).get("pretokenizers", []))
    return folded and cut and said["model"].get("end_of_word_suffix") == "</w>" and BETWEEN in special


class WordTokens:
    """bytes of a text -> its ids as little-endian unsigned 32-bit integers, without special tokens."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.by_words = words_alone(path)
        self.between = self.tokenizer.token_to_id(BETWEEN)
        names = self.tokenizer.get_vocab()
        self.ends_word = np.zeros(max(names.values()) + 1, bool)
        self.ends_word[[i for name, i in names.items() if name.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _whole(self, text: bytes) -> bytes:
        ids = self.tokenizer.encode(text.decode("utf-8", "replace"), add_special_tokens=False).ids
        return np.array(ids, "<u4").tobytes()

    def _learn(self, words: list[bytes]) -> None:
        """Encode words that are new: those of letters only are one pre-token each, so the ends of
        words mark them; the others stand between special tokens.  A word with one comma or full
        stop behind a letter is that word and that mark."""
        known, plain, other, marked = self.known, set(), [], []
        for w in words:
            if w[-1] in b".," and w[:-1].decode("utf-8", "replace").lower()[-1:].isalpha():
                marked.append(w)
                w = w[:-1]
                if w in known:
                    continue
            (plain.add if w.decode("utf-8", "replace").isalpha() else other.append)(w)
        plain = list(plain)
        for i in range(0, len(plain), 2000):
            some = plain[i : i + 2000]
            ids, raw = self._ids(some, " ")
            ends = np.flatnonzero(self.ends_word[ids]) + 1
            if len(ends) == len(some):
                self._keep(some, raw, np.concatenate([[0], ends[:-1]]), ends)
            else:  # a letter that becomes more than letters in lower case
                other += some
        other += [b".", b","]
        for i in range(0, len(other), 2000):
            some = other[i : i + 2000]
            ids, raw = self._ids(some, BETWEEN)
            cuts = np.flatnonzero(ids == self.between)
            self._keep(some, raw, np.concatenate([[0], cuts + 1]), np.append(cuts, len(ids)))
        for w in marked:
            known[w] = known[w[:-1]] + known[w[-1:]]

    def _ids(self, words: list[bytes], between: str) -> tuple[np.ndarray, bytes]:
        text = between.join([w.decode("utf-8", "replace") for w in words])
        ids = np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, "<u4")
        return ids, ids.tobytes()

    def _keep(self, words: list[bytes], raw: bytes, starts: np.ndarray, ends: np.ndarray) -> None:
        for w, a, b in zip(words, (4 * starts).tolist(), (4 * ends).tolist(), strict=True):
            self.known[w] = raw[a:b]

    def encode(self, docs: list[bytes]) -> list[bytes]:
        if not self.by_words:
            return [self._whole(d) for d in docs]
        # a text that holds a special token's string is encoded as a whole: there, case and cuts matter
        split = [None if MARK in d else d.lower().split() for d in docs]
        if len(self.known) > MAX_WORDS:
            self.older, self.known = self.known, {}
        got = [[] if s is None else list(map(self.known.get, s)) for s in split]
        holes = [(s, g, [i for i, ids in enumerate(g) if ids is None]) for s, g in zip(split, got) if None in g]
        if holes:
            new = []
            for w in {s[i] for s, _, at in holes for i in at}:
                if (ids := self.older.get(w)) is None:
                    new.append(w)
                else:
                    self.known[w] = ids
            if new:
                self._learn(new)
            for s, g, at in holes:
                for i in at:
                    g[i] = self.known[s[i]]
        return [self._whole(d) if s is None else b"".join(g) for d, s, g in zip(docs, split, got)]


_loaded: dict[str, WordTokens] = {}


def word_tokens(path: str) -> WordTokens:
    """The tokenizer of this worker process, with the words it has met in earlier tasks."""
    if path not in _loaded:
        _loaded[path] = WordTokens(path)
    return _loaded[path]


def forget() -> None:
    """Let go of this worker process's tokenizers and their words, when its texts are encoded: an idle worker would keep them."""
    if _loaded:
        _loaded.clear()
        pa.default_memory_pool().release_unused()


def encoded(batches: Iterator[pa.RecordBatch], path: str, end_id: int, at_once: int = 200) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Each batch with the ids of its texts, each with ``end_id`` behind; null texts count as empty."""
    tokens, end = word_tokens(path), int(end_id).to_bytes(4, "little")
    for part in slices(batches, at_once):
        yield part, [x + end for x in tokens.encode(texts(part))]

"""Words, shingles and their 64-bit hashes; used inside tasks, on Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

U64 = np.uint64
#: Entries that a task's dictionary of word hashes holds at most; past it, it starts anew.
MAX_WORDS = 150_000


class WordHashes(dict):
    """word (bytes) -> 64-bit hash, remembered for frequent words."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh3_64_intdigest(word)
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > MAX_WORDS:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=U64, count=len(words))


def split_words(text: bytes) -> list[bytes]:
    """``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z: bytes.lower() and bytes.split() do just that."""
    return text.lower().split()


def mix(h: np.ndarray) -> np.ndarray:
    """A bijective 64-bit finaliser."""
    h = (h ^ (h >> U64(31))) * U64(0x7FB5D329728EA185)
    h = (h ^ (h >> U64(27))) * U64(0x81DADEF4BC2DD44D)
    return h ^ (h >> U64(33))


def _odd(n: int, seed: int) -> np.ndarray:
    return np.random.default_rng(seed).integers(0, 2**63, n, dtype=np.uint64) * U64(2) + U64(1)


POSITION = _odd(64, 11)
#: Which bytes split words; by the number of a word's bytes in a block of eight, the bits that count.
_SPACE = bytes(b in b" \t\n\x0b\x0c\r" for b in range(256))
_COUNTS = np.array([(1 << 8 * k) - 1 for k in range(9)], dtype=U64)


def word_hashes(text: bytes) -> np.ndarray:
    """The 64-bit hashes of the words of a text, as ``split_words`` gives them, without an object per word.

    A word is the blocks of eight bytes that it fills, the last one with zeros behind it: each is
    mixed with its number, and their sum with the length of the word.
    """
    raw = b" " + text.lower() + b" " * 8  # a block may be read over the end
    outside = np.frombuffer(raw.translate(_SPACE), bool)
    edges = np.flatnonzero(outside[1:] != outside[:-1]) + 1
    if not len(edges):
        return np.empty(0, U64)
    begin, end = edges[::2], edges[1::2]
    size = end - begin
    blocks = (size + 7) >> 3
    last = np.cumsum(blocks)
    first = last - blocks
    of = np.repeat(np.arange(len(size)), blocks)
    number = np.arange(len(of)) - first[of]
    at = begin[of] + 8 * number
    left = np.minimum(end[of] - at, 8)
    value = np.ndarray(len(raw) - 7, "<u8", raw, strides=(1,))[at] & _COUNTS[left]
    with np.errstate(over="ignore"):
        mixed = mix(value + number.astype(U64) * POSITION[60])
        return mix(np.add.reduceat(mixed, first) + size.astype(U64) * POSITION[61])


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of the k words from each position on; fewer than k words: one hash of them all."""
    n = len(hashes)
    if n == 0:
        return np.empty(0, U64)
    with np.errstate(over="ignore"):
        if n < k:
            return mix(np.array([(hashes * POSITION[:n]).sum(dtype=U64) + U64(n)], dtype=U64))
        h = hashes[: n - k + 1] * POSITION[0]
        for i in range(1, k):
            h = h + hashes[i : n - k + 1 + i] * POSITION[i]
        return mix(h + U64(k))


def texts(batch: pa.RecordBatch, name: str = "text") -> list[bytes]:
    """A string column as bytes; null as empty."""
    return [x or b"" for x in batch.column(batch.schema.get_field_index(name)).cast(pa.binary()).to_pylist()]


def slices(batches: Iterator[pa.RecordBatch], rows: int = 200) -> Iterator[pa.RecordBatch]:
    """The batches in parts of at most ``rows``, so that few texts are held as Python objects at once."""
    for batch in batches:
        for i in range(0, batch.num_rows, rows):
            yield batch.slice(i, rows)


def signed(h: np.ndarray) -> np.ndarray:
    return h.astype(U64, copy=False).view(np.int64)


def batches_of(rows: Iterator[tuple], schema: pa.Schema, size: int = 20_000) -> Iterator[pa.RecordBatch]:
    """Tuples as record batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)
            held = []
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*held), schema)], schema=schema)

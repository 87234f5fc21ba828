import numpy as np
import pyarrow.parquet as pq

from geoloom.llm.words import split_words, word_hashes


def same(texts):
    """Words are equal where their hashes are, over all texts."""
    words, hashes = [], []
    for t in texts:
        w, h = split_words(t), word_hashes(t).tolist()
        assert len(w) == len(h)
        words += w
        hashes += h
    assert len(set(words)) == len(set(hashes)) == len(set(zip(words, hashes)))


def test_hashes_tell_words_apart():
    odd = [b"", b" ", b"\t\n\x0b\x0c\r ", b"a", b" a ", b"a\0 a a\0\0 \0 \0\0", b"12345678 123456789 1234567 12345678\0", b"A a \x1c \x1f x\x85y\xa0z"]
    same([*odd, "Ünï ünï İ i　j".encode(), b"x" * 10_000, b"x" * 10_001, b"xxxxxxxx " * 50])
    rng = np.random.default_rng(5)
    same([bytes(rng.choice(list(b"aAb \t\0\xc3"), 400).tolist()) for _ in range(300)])


def test_hashes_of_the_given_texts():
    same([(t or "").encode() for t in pq.read_table("/root/testdata/sf0.01/documents.parquet").column("text").to_pylist()])

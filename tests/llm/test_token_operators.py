"""Token files and packing: exact round trips, odd rows, and the plan's own rules."""

import io
import random
import struct
import zlib
from bisect import bisect_right
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from geoloom.llm import packing, token_files, tokens
from geoloom.llm.tokens import default_tokenizer, word_tokens

ODD = [
    (5, "The quick, brown fox. İ. ﬁ é́ 日本語。 12² <|endoftext|> <|ENDOFTEXT|>"), (3, None), (9, ""), (None, "no id"),
    (5, "same id, other text"), (7, "twice"), (7, "twice"), (1, "word " * 9000), (2, "\x0b\x1c\x00 a b"),
]


@pytest.fixture(scope="module")
def direct():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(default_tokenizer())
    return lambda text, end: t.encode(text or "", add_special_tokens=False).ids + [end]


def raw(ids):
    return struct.pack(f"<{len(ids)}I", *ids)


@pytest.fixture(scope="module")
def odd(spark):
    df = spark.createDataFrame(ODD, "doc_id long, text string")
    return df.withColumns({"start": F.lit(1), "ids": F.lit("x"), "uid": F.lit(2)})  # clashing names


def test_words_are_the_library_s(direct):
    random.seed(1)
    docs = [t or "" for _, t in ODD] + ["".join(random.choice("ab é,.'śͅſKÅ<|> \n\tıİ9²½ⅷ_") for _ in range(40)) for _ in range(500)]
    assert word_tokens(default_tokenizer()).encode([d.encode() for d in docs]) == [raw(direct(d, 0)[:-1]) for d in docs]


def test_file_round_trip_and_seek():
    out, rng = io.BytesIO(), random.Random(2)
    docs = [(k if k else None, raw([rng.randrange(50_000) for _ in range(rng.choice([0, 1, 5, 300]))])) for k in range(60)]
    w = token_files.TokenFileWriter(out, frame_ids=64)
    for d in docs:
        w.add(*d)
    w.close()
    r = token_files.read_bytes(out.getvalue())
    assert [(int(i) if v else None, r.ids(k)) for k, (i, v) in enumerate(zip(r.doc_ids, r.valid))] == docs
    read = []
    r.last, frame = (-1, b""), r.frame
    r.frame = lambda i: read.append(i) or frame(i)
    k = r.find(30)[0]
    assert r.ids(k) == docs[30][1] and len(set(read)) <= len(docs[30][1]) // 256 + 2  # only its frames
    data = bytearray(out.getvalue())
    data[20] ^= 1
    with pytest.raises(Exception):  # noqa: B017 - zstandard or the checksum finds it
        bad = token_files.read_bytes(bytes(data))
        [bad.ids(k) for k in range(60)]


def test_token_files(spark, odd, direct):
    got = [tuple(r) for r in token_files.token_digests(odd).orderBy("start").collect()]
    want, at = [], 0
    for doc_id, text in sorted(ODD, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = direct(text, 1)
        want.append((doc_id, at, len(ids), zlib.crc32(raw(ids))))
        at += len(ids)
    assert got == want
    assert token_files.token_digests(odd.where("false")).count() == 0


def test_packing(spark, odd, direct):
    rows = packing.pack_documents(odd, window=256).collect()
    by_sequence = {}
    for r in rows:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in by_sequence.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at == 256 or at & (at - 1) == 0
    assert sorted(by_sequence) == list(range(len(by_sequence)))
    texts = {}
    for r in rows:
        texts.setdefault((r.doc_id, r.doc_tokens), []).append((r.start, bytes(r.ids)))
    whole = sorted(b"".join(x for _, x in sorted(p)) for k, p in texts.items() if k[0] not in (7,))
    assert whole == sorted(raw(direct(t, 2)) for i, t in ODD if i != 7)
    assert sum(r.length for r in rows if r.doc_id == 7) == 2 * len(direct("twice", 2))
    assert packing.pack_documents(odd.where("false")).count() == 0


@pytest.mark.parametrize("window", [16, 64, 128])
def test_plan_places_every_token_once(window):
    rng = random.Random(window)
    for _ in range(80):
        h = {rng.randint(1, window - 1): rng.randint(1, 30) for _ in range(rng.randint(0, 25))}
        plan, following = packing.make_plan(h, window, 3)
        held = {}
        for n, (los, pieces) in plan.items():
            for rank in range(h[n]):
                at = 0
                for start, length, lo, sequence, offset in pieces[bisect_right(los, rank) - 1]:
                    assert start == at
                    at += length
                    held.setdefault(sequence + rank - lo, []).append((offset, length))
                assert at == n
        assert sorted(held) == list(range(3, following))
        short = 0
        for pieces in held.values():
            at = 0
            for offset, length in sorted(pieces):
                assert offset == at
                at += length
            short += at != window
        assert short <= window.bit_length()


def test_packing_leaves_no_words_in_workers(spark):
    """An idle worker would keep its words, and a list of rows as a table would start further workers."""
    word_tokens(default_tokenizer())
    assert list(packing._place(SimpleNamespace(value={}), 16)(iter([]))) == []
    assert not tokens._loaded
    rows = packing._local(spark, [(3, 0), (5, 2)])
    assert sorted(map(tuple, rows.collect())) == [(3, 0), (5, 2)]
    assert "ExistingRDD" not in rows._jdf.queryExecution().toString()
    assert packing._local(spark, []).dtypes == [("r", "bigint"), ("first", "bigint")]

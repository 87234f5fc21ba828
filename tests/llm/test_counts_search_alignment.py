"""Prefix counts, reversed search and token alignment against the libraries and brute force."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import alignment, chunks, lexical, prefix_counts
from geoloom.llm.queries import QUERIES

DATA = "/root/testdata/sf0.001"
ODD = [
    "", "a", " ", "  a", "we're they'll I've 're'r", "don't  \n\n x", "\n\n\nfoo", "a  b  c \t d", "<|endoftext|>", "x <|endoftext|> y<|endoftext|><|endoft",
    "!!<|endoftext|>!! a", "日本語 漢字", "émigré naïve 😀😀 👩‍👩‍👧", "a\x1c\x1d b", "x" * 300, " " * 50 + "y" + " " * 33, "'ll''ve !'re", "  're", "▁ a▁b", "<s> <0x41> </s>", "\x00\x01 x", "ﬁ ½ ① Å",
]


def noise(n, seed=1, alphabet="ab 'strevl\n\t  é漢<|endoftext|>1.!😀"):
    rng = random.Random(seed)
    return ["".join(rng.choice(alphabet) for _ in range(60)) for _ in range(n)]


@pytest.fixture(scope="module")
def byte_level():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(prefix_counts.default_tokenizer())


def of_prefixes(tokenizer, text):
    return [len(tokenizer.encode(text[:k], add_special_tokens=False).ids) for k in range(1, len(text) + 1)]


def test_chunks_end_where_no_token_crosses():
    assert chunks.cut("a b\nc d") == ["a", "b\nc", "d"]
    assert chunks.cut(" a  b c ") == [" a  b", "c "]
    assert chunks.cut("") == [""]


def test_every_prefix_is_counted_as_the_library_encodes_it(byte_level):
    counter = prefix_counts.PrefixTokens(prefix_counts.default_tokenizer())
    texts = ODD + noise(150) + noise(150, 2, "ab  \n.")
    # chunks of all texts together, those with white space at their ends among them
    for text, counts in zip(texts, counter.of(texts)):
        assert counts.tolist() == of_prefixes(byte_level, text), text


def test_prefix_counts_answer_budgets(spark, byte_level):
    rows = list(enumerate(ODD)) + [(None, "a b"), (3, None), (3, "  a"), (3, "  a"), (99, "word " * 30_000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumns({"counts": F.lit(1), "n_bytes": F.lit("x"), "n_tokens": F.lit(0)})
    got = prefix_counts.prefix_counts(df)
    assert sorted((r.n_bytes, r.n_chars) for r in got.collect()) == sorted((len((t or "").encode()), len(t or "")) for _, t in rows)
    asked = got.where("doc_id = 4").select(prefix_counts.tokens_at(F.lit(5)).alias("five"), prefix_counts.tokens_at(F.lit(0)).alias("none"), prefix_counts.tokens_at(F.lit(999)).alias("beyond"), prefix_counts.chars_within("counts", F.lit(4)).alias("fit")).first()
    want = of_prefixes(byte_level, ODD[4])
    assert (asked.five, asked.none, asked.beyond) == (want[4], 0, None)
    assert asked.fit == max(k for k, n in enumerate(want, 1) if n <= 4)
    totals = prefix_counts.token_totals(df, limit=20).collect()
    brute = [(d, len(byte_level.encode(t or "", add_special_tokens=False).ids)) for d, t in rows]
    assert Counter((r.doc_id, r.n_tokens, r.over_limit) for r in totals) == Counter((d, n, n > 20) for d, n in brute)
    assert prefix_counts.token_totals(df.where("false")).count() == 0
    import public_tokenizers

    with pytest.raises(ValueError):
        prefix_counts.prefix_counts(df, public_tokenizers.path("word_bpe_49k.json"))


def test_op11_on_all_documents(spark, byte_level):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in QUERIES["op11_prefix_counts"](spark, DATA).collect()}
    want = {d: (len(t.encode()), len(byte_level.encode(t, add_special_tokens=False).ids)) for d, t in texts.items()}
    assert got == {d: (b, n, n > 512) for d, (b, n) in want.items()}


def ranked(docs, items, k):
    """The contract of the search, word by word."""
    words = lambda t: re.findall("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))
    counted = [(d, Counter(w), len(w)) for d, t in docs if (w := words(t))]
    n_docs, length = len(counted), sum(n for _, _, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for d, c, n in counted:
            m = 10 + 90 * n * n_docs // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (10**9 * c[t] // (1000 * c[t] + 8 * m)) for t in set(words(text)) if t in c)
            if s > 0:
                scores.append((-s, d is None, d))
        out += [(item, r, d, -s) for r, (s, _, d) in enumerate(sorted(scores, key=lambda x: (x[0], x[1], x[2] or 0))[:k], 1)]
    return sorted(out, key=str)


def test_ranked_search(spark):
    rng = random.Random(5)
    vocabulary = [f"w{k}" for k in range(60)] + ["Äb", "x_y", "É", "a-b"]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    docs = [(i, text(rng.randint(1, 40))) for i in range(300)]
    docs += [(400 + i, docs[7][1]) for i in range(25)] + [(7, docs[7][1]), (None, docs[7][1]), (500, None), (501, ""), (502, "!!! ---"), (503, "w1 " * 20_000)]
    items = [(1, text(12)), (2, docs[7][1]), (3, None), (4, "nowhere"), (5, text(30)), (1, text(5)), (None, "w1 W2")]
    d = spark.createDataFrame(docs, "doc_id long, text string").repartition(7).withColumns({"score": F.lit(1), "rank": F.lit(1), "item": F.lit(0)})
    b = spark.createDataFrame(items, "item_id long, text string").withColumn("doc_id", F.lit(1))
    want = ranked(docs, items, 10)
    assert len(want) == 50
    for postings in (lexical.POSTINGS, 15):  # one block of items, and several
        got = lexical.rank_documents(d, b, 10, postings).collect()
        assert sorted(((r.item_id, r["rank"], r.doc_id, r.score) for r in got), key=str) == want
    assert lexical.rank_documents(d.where("false"), b).count() == 0
    assert lexical.rank_documents(d, b.where("false")).count() == 0


def aligned(docs):
    """Every overlap and every common end, token by token."""
    import sentencepiece
    from tokenizers import Tokenizer, decoders

    a = Tokenizer.from_file(prefix_counts.default_tokenizer())
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=alignment.default_pieces())
    plain = list(range(33, 127)) + list(range(161, 173)) + list(range(174, 256))
    rest = [x for x in range(256) if x not in plain]
    byte_of = {chr(x): x for x in plain} | {chr(256 + k): x for k, x in enumerate(rest)}
    spans = lambda parts: list(zip(np.cumsum([0] + [len(p) for p in parts]).tolist(), np.cumsum([len(p) for p in parts]).tolist()))
    rows, pairs, of = [], Counter(), []
    for d, t in docs:
        ids_a, ids_b = (a.encode(" " + t, add_special_tokens=False).ids, b.encode(t)) if t else ([], [])
        bytes_a = [bytes(byte_of[c] for c in a.id_to_token(i)) for i in ids_a]
        bytes_b = [bytes([int(b.id_to_piece(i)[3:5], 16)]) if b.is_byte(i) else b.id_to_piece(i).replace("▁", " ").encode() for i in ids_b]
        if not t or b"".join(bytes_a) != (" " + t).encode() or b"".join(bytes_b) != (" " + t).encode():
            rows.append([d, 0, 0, 0, 0, 0, 0, ""])
            of.append([])
            continue
        at_a, at_b = spans(bytes_a), spans(bytes_b)
        links = [(x, y) for (p, q), x in zip(at_a, ids_a) for (r, s), y in zip(at_b, ids_b) if p < s and r < q]
        ends = sorted({q for _, q in at_a} & {s for _, s in at_b})
        side = lambda spots, ids, lo, hi: ",".join(str(i) for (_, q), i in zip(spots, ids) if lo < q <= hi)
        text = ";".join(side(at_a, ids_a, lo, hi) + "|" + side(at_b, ids_b, lo, hi) for lo, hi in zip([0, *ends], ends))
        pairs.update(set(links))
        of.append(links)
        rows.append([d, len(ids_a), len(ids_b), len(ends), len(links), 0, 0, hashlib.sha256(text.encode()).hexdigest()])
    most = defaultdict(int)
    for (x, _), n in pairs.items():
        most[x] = max(most[x], n)
    for row, links in zip(rows, of):
        row[5], row[6] = sum(pairs[p] == most[p[0]] for p in links), sum(pairs[p] for p in links)
    return sorted(map(tuple, rows), key=str)


def test_alignment_of_odd_texts(spark, monkeypatch):
    docs = list(enumerate(ODD + noise(60, 3, "ab 'st\n\t  é漢<|endoftext|>1.!▁😀"))) + [(None, "a b"), (1, None), (5, ODD[4]), (5, ODD[4])]
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3).withColumns({"batch": F.lit(1), "pair": F.lit(1), "n_a": F.lit("x")})
    want = aligned(docs)
    assert sum(r[1] == 0 for r in want) > 5
    assert sorted((tuple(r) for r in alignment.align_tokens(df).collect()), key=str) == want
    assert alignment.align_tokens(df.where("false")).count() == 0


def test_op13_on_all_documents(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{DATA}/documents.parquet").where("length(text) < 1500").collect()]
    got = alignment.align_tokens(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got), key=str) == aligned(docs)


def test_batches_by_size_keep_rows_in_order():
    import pyarrow as pa

    texts = ["a" * n for n in (5, 0, 30, 7, 7, 7, 100, 1)] + [None]
    given = [pa.RecordBatch.from_arrays([pa.array(range(k, k + 3)), pa.array(texts[k : k + 3], pa.string())], ["n", "text"]) for k in (0, 3, 6)]
    out = list(chunks.by_size(iter(given), 40))
    assert [n for b in out for n in b.column(0).to_pylist()] == list(range(9))
    assert all(b.num_rows == 1 or sum(len(t or "") for t in b.column(1).to_pylist()) <= 40 for b in out)


def test_staged_alignments_are_in_small_row_groups(spark, monkeypatch):
    """A reader's batch ends with its row group, so rows of some MB never come by the thousand."""
    import glob

    import pyarrow.parquet as pq

    rng, paths, plain = random.Random(3), [], alignment.stage
    docs = [(d, " ".join(f"w{rng.randrange(10**6)}" for _ in range(2500))) for d in range(48)]
    monkeypatch.setattr(alignment, "AT_ONCE", 1 << 14)
    monkeypatch.setitem(alignment.SMALL_GROUPS, "parquet.block.size", str(1 << 19))
    monkeypatch.setattr(alignment, "stage", lambda *a: paths.append(out := plain(*a)) or out)
    got = alignment.align_tokens(spark.createDataFrame(docs, "doc_id long, text string").coalesce(1))
    assert {r.doc_id for r in got.collect() if r.n_links} == set(range(48))
    groups = [g for f in glob.glob(f"{paths[0]._staged_path.removeprefix('file://')}/*.parquet") for m in [pq.ParquetFile(f).metadata] for g in map(m.row_group, range(m.num_row_groups))]
    assert sum(g.num_rows for g in groups) == 48 and max(g.num_rows for g in groups) < 24
    assert max(g.total_byte_size for g in groups) < 1 << 20


def test_places_alone_say_what_overlaps():
    """Documents lie end to end, so neither side is dealt by document; one has no tokens, one of each side is a single token."""
    rng = random.Random(4)
    ends = lambda n, k: sorted(rng.sample(range(1, n), k)) + [n] if n else []
    sizes = [np.diff([0, *e]) for e in (ends(40, 17), [], ends(9, 0), ends(300, 80), ends(1, 0))], [np.diff([0, *e]) for e in (ends(40, 11), [], ends(9, 5), ends(300, 120), ends(1, 0))]
    frames = [alignment._frame([s.astype(np.int64) for s in side], np.arange(400)) for side in sizes]
    a, b = frames
    x, y = alignment.overlaps(*(f[["id", "at", "end", "token"]] for f in frames))
    want = [(i, j) for i, (p, q) in enumerate(zip(a["at"], a["end"])) for j, (r, s) in enumerate(zip(b["at"], b["end"])) if p < s and r < q]
    assert list(zip(x.tolist(), y.tolist())) == want
    groups, digests = alignment._groups(a, b, 5, [f"{i}{mark}" for i in range(400) for mark in (",", "|", ";", "")])
    for d in range(5):
        of = [f[f["doc"] == d] for f in frames]
        both = sorted({*of[0]["end"]} & {*of[1]["end"]})
        part = lambda f, lo, hi: ",".join(map(str, f["id"][(f["end"] > lo) & (f["end"] <= hi)]))
        lows = [0 if not len(both) else int(of[0]["at"].min()), *both]
        text = ";".join(part(of[0], lo, hi) + "|" + part(of[1], lo, hi) for lo, hi in zip(lows, both))
        assert groups[d] == len(both) and digests[d] == (hashlib.sha256(text.encode()).hexdigest() if text else "")

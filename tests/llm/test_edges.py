"""Few labels, other tokenizers, many rows of one id, and the pipeline's stages on odd rows with clashing names."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from geoloom.llm import prefix_counts, quality, token_files, tokens

DATA = "/root/testdata/sf0.001"


@pytest.mark.parametrize("n", [0, 2, 30, 60, 120])
def test_quality_with_few_labels(spark, n):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(i, i % 3 // 2) for i in range(n)]
    labels = spark.createDataFrame(rows, "doc_id long, quality int")
    scores = [r.score for r in quality.score_quality(docs, labels).collect()]
    assert len(scores) == docs.count() and all(0 <= s <= 1 for s in scores)
    if n in (30, 60):  # too few to split: everywhere the share of the label 1
        assert max(scores) - min(scores) < 1e-12 and 0.2 < scores[0] < 0.5


def test_repeated_documents_are_one_row_to_learn_from(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    labels = spark.read.parquet(f"{DATA}/labels.parquet")
    once, thrice = quality.fit(docs, labels), quality.fit(docs.unionAll(docs).unionAll(docs), labels)
    assert once.rules == thrice.rules and np.allclose(once.weights, thrice.weights)


def test_other_tokenizers_get_whole_texts():
    from tokenizers import Tokenizer

    path = prefix_counts.default_tokenizer()
    assert tokens.words_alone(tokens.default_tokenizer()) and not tokens.words_alone(path)
    texts = ["Upper Case  and\n\nlines", "", " x ", "don't<|endoftext|>"]
    library = Tokenizer.from_file(path)
    got = tokens.WordTokens(path).encode([t.encode() for t in texts])
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [library.encode(t, add_special_tokens=False).ids for t in texts]


def test_many_rows_of_one_id_lie_in_their_order(spark):
    rows = [(5, f"text {k % 150}") for k in range(400)] + [(1, "b"), (9, None), (None, "z")]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    before = spark.conf.get("spark.sql.adaptive.enabled")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        files = token_files.write_token_files(df)
        assert files.count() > 1
        back = token_files.read_token_files(files).orderBy("start").collect()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", before)
    order = df.orderBy(F.asc_nulls_first("doc_id"), F.xxhash64("text"), "text").collect()
    encode = tokens.word_tokens(tokens.default_tokenizer()).encode
    end = (1).to_bytes(4, "little")
    assert [(r.doc_id, bytes(r.ids)) for r in back] == [(r.doc_id, encode([(r.text or "").encode()])[0] + end) for r in order]


def test_stages_on_odd_rows_with_clashing_names(spark):
    rng = random.Random(3)
    text = lambda n: " ".join(f"w{rng.randrange(900)}" for _ in range(n))
    passage, item, long = text(80), text(30), text(200)
    rows = [(1, long), (2, long + " end"), (3, text(60) + " " + passage + " " + text(60)), (4, text(60) + " " + passage + " " + text(60)), (5, item), (6, "short"), (7, None), (8, ""), (None, long), (None, None), (6, "short"), (1, text(90))]
    names = ["__doc", "__crc", "__spans", "__version", "_0_doc", "_0_crc", "_0_spans", "_1_spans", "score", "kept", "version", "begin", "h"]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({n: F.lit(k) for k, n in enumerate(names)})
    benchmark = spark.createDataFrame([(1, item), (2, None)], "item_id long, text string")
    at = spark.conf.get("spark.checkpoint.dir") + "/odd"
    benchmark.write.mode("overwrite").parquet(f"{at}/benchmark.parquet")
    spark.createDataFrame([], "doc_id long, quality int").write.mode("overwrite").parquet(f"{at}/labels.parquet")
    kept = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    out = {name: step(spark, docs, at) for name, step in corpus_pipeline.STAGES[:-1]}
    assert all(df.columns == docs.columns for df in out.values())
    assert kept(out["quality"]) == sorted(rows, key=str)  # without labels every score is 0.5
    assert kept(out["near_dedup"]) == sorted([r for r in rows if r != (2, long + " end")][:-2] + [rows[-1]], key=str)
    after = dict((d, t) for d, t in kept(out["substring_dedup"]) if d in (3, 4))
    assert after[3] == rows[2][1] and after[4].split() == rows[3][1].split()[:60] + rows[3][1].split()[-60:]
    assert kept(out["decontamination"]) == sorted([r for r in rows if r != (5, item)], key=str)
    pieces = corpus_pipeline.packing(spark, docs, at)
    assert pieces.agg(F.count_distinct(F.struct("sequence_id", "offset"))).first()[0] == pieces.count() >= len(rows)
    for name, step in corpus_pipeline.STAGES:
        assert step(spark, docs.where("false"), at).count() == 0

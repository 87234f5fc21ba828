"""Nearest neighbours, sharding, preferences, and the registered queries against SQL."""

import glob
import os
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import nearest, preferences, sharding
from geoloom.llm.queries import ORACLES, QUERIES
from geoloom.llm.staging import stage

DATA = "/root/testdata/sf0.001"


def brute(ids, vectors, k, every):
    out = {}
    for q, v in zip(ids, vectors):
        if q % every == 0:
            d = np.sqrt(((vectors - v) ** 2).sum(axis=1))
            out[q] = [(int(ids[i]), d[i]) for i in np.lexsort((ids, d)) if ids[i] != q][:k]
    return out


def test_visits_cells_by_summed_distance():
    rng = np.random.default_rng(1)
    a, b, counts = rng.random(9), rng.random(7), rng.integers(0, 5, 63)
    cells = nearest.visit(a, b, counts, 10**9)
    assert sorted(cells) == list(range(63))
    sums = [a[c // 7] + b[c % 7] for c in cells]
    assert sums == sorted(sums)
    few = nearest.visit(a, b, counts, 20)
    assert few == cells[: len(few)] and counts[few].sum() >= 20 > counts[few[:-1]].sum()


def test_neighbours_in_turns_and_salts_are_the_same(spark, monkeypatch):
    rng = np.random.default_rng(6)
    rows = [(int(i), [float(v) for v in x]) for i, x in enumerate(rng.normal(size=(1500, 8)))]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    want = sorted(map(tuple, nearest.nearest_neighbours(df, every=10).collect()))
    monkeypatch.setattr(nearest, "SALTED", 40)
    assert sorted(map(tuple, nearest.nearest_neighbours(df, every=10).collect())) == want


def test_neighbours_recall_and_odd_rows(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(6000, 16))
    x[100:900] = x[100]  # many equal vectors
    rows = [(i, [float(v) for v in x[i]]) for i in range(6000)]
    odd = [(6100, None), (6200, [0.0] * 16), (6300, [float("nan")] * 16), (6400, [None] * 16), (None, rows[1][1]), (6500, [1.0, 2.0]), (6600, [])]
    df = spark.createDataFrame(rows + odd, "vec_id long, embedding array<double>").withColumns({"cell": F.lit(1), "rank": F.lit(1)})
    got = {}
    for r in nearest.nearest_neighbours(df, centroids=32).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    want = brute(np.arange(6000), x, 10, 100)
    assert set(got) == set(want)
    hits = sum(len({a for a, _ in got[q]} & {a for a, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    assert got[100] == [(101 + k, 0.0) for k in range(10)]
    few = nearest.nearest_neighbours(df.where("vec_id < 4 OR vec_id > 6050")).collect()
    assert sorted((r["rank"], r.vec_id) for r in few) == [(k + 1, v) for k, (v, _) in enumerate(brute(np.arange(4), x[:4], 10, 100)[0])]
    assert nearest.nearest_neighbours(df.where("false")).count() == 0


@pytest.mark.parametrize("sf", ["sf0.01", "sf0.1"])
def test_recall_on_the_given_vectors(spark, sf):
    folder = f"/root/testdata/{sf}"
    rows = spark.read.parquet(f"{folder}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, x = np.array([r.vec_id for r in rows]), np.array([r.embedding for r in rows], float)
    want = brute(ids, x, 10, 100)
    got = {q: set() for q in want}
    for r in QUERIES["op3_multi_index"](spark, folder).collect():
        got[r.query_id].add(r.vec_id)
    recall = sum(len(got[q] & {a for a, _ in want[q]}) for q in want) / sum(map(len, want.values()))
    assert recall >= 0.9, recall


def test_shards(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), "é" * int(n), str(rng.choice(["a", "b"]))) for i, n in enumerate(rng.lognormal(4, 1, 4000))]
    rows += [(5000 + i, "copy " * 20, "a") for i in range(2000)] + [(None, None, None), (7, "", "a"), (7, "", "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumns({"size": F.lit(1), "uid": F.lit(1), "shard": F.lit(0)})
    got = sharding.shard_documents(df, shards=11).toPandas()
    assert len(got) == len(rows) and set(got["law"]) == {"bytes"} and got["grown_shard"].isna().all()
    size = got.groupby("shard")["size"].sum()
    assert sorted(size.index) == list(range(11)) and size.max() <= 1.03 * size.mean() and size.min() >= 0.97 * size.mean()
    assert all(sorted(s) == list(range(len(s))) for _, s in got.groupby("shard")["slot"])
    want = sorted((len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for _, t, _ in rows)
    assert sorted(zip(got["size"], got["text_crc32"])) == want
    assert sharding.shard_documents(df.where("false")).count() == 0
    one = sharding.shard_documents(df.limit(3), shards=40).collect()
    assert len({r.shard for r in one}) == 3
    assert sharding.shard_documents(df, shards=None, target_bytes=200_000).select("shard").distinct().count() == -(-int(size.sum()) // 200_000)


def test_preferences(spark):
    rows = [
        (0, 1, "assistant", "hi"), (0, 0, "user", "a"), (0, 2, "user", "b"), (1, 0, "user", "a"), (1, 1, "assistant", "ho"),
        (2, 0, "user", "q"), (3, 0, "user", "q"), (4, 0, None, None), (4, None, "user", "z"), (5, 0, "user", "é\n"), (5, 0, "user", "é\n"),
        (6, 0, "user", "alone"), (None, 0, "user", "none"),
    ]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"turns": F.lit(1), "c": F.lit(1), "pair_id": F.lit(1)})
    got = {r.pair_id: r for r in preferences.format_preferences(turns, preferences.adjacent_pairs(turns)).collect()}
    assert set(got) == {0, 1, 2}
    r = got[0]
    assert r.prompt_turns == 1 and r.prompt == "<|user|>\na<|end|>\n" and r.rejected == "<|assistant|>\nho<|end|>\n"
    assert r.chosen == "<|assistant|>\nhi<|end|>\n<|user|>\nb<|end|>\n"
    assert [r.chosen[s.begin : s.end] for s in r.chosen_loss] == ["hi<|end|>\n"] and [r.rejected[s.begin : s.end] for s in r.rejected_loss] == ["ho<|end|>\n"]
    assert (got[1].prompt_turns, got[1].chosen, got[1].rejected) == (1, "", "")
    assert got[2].prompt == "" and got[2].rejected.count("é\n") == 2 and got[2].chosen.startswith("<|user|>\nz")
    assert preferences.format_preferences(turns.where("false"), preferences.adjacent_pairs(turns.where("false"))).count() == 0


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_against_sql(spark, name):
    con = duckdb.connect()
    for f in glob.glob(f"{DATA}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(f)[:-8]} AS SELECT * FROM '{f}'")
    got, want = QUERIES[name](spark, DATA).toPandas(), con.execute(ORACLES[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda df: sorted(tuple(map(str, r)) for r in df[cols].itertuples(index=False))
    assert key(got) == key(want)


def test_pipeline(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    counts = [docs.count()]
    for name, step in corpus_pipeline.STAGES:
        out = stage(step(spark, docs, DATA), name)
        if name != "packing":
            assert out.columns == docs.columns
            assert out.join(docs, "doc_id", "left_anti").count() == 0
            counts.append(out.count())
            docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > 0
    tokens = out.groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("m"))
    assert tokens.where("n <> m").count() == 0 and tokens.count() == counts[-1]


def test_rows_that_share_a_vec_id_are_queries_and_candidates(spark):
    rows = [(100, [1.0, 0.0]), (100, [5.0, 5.0]), (1, [1.0, 1.0]), (2, [4.0, 5.0])]
    got = nearest.nearest_neighbours(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), k=3, share=1.0).collect()
    assert sorted((r.rank, r.vec_id) for r in got) == [(1, 1), (1, 2), (2, 1), (2, 2), (3, 100), (3, 100)]


def test_search_measures_entries_of_visited_cells_only(spark, tmp_path):
    """Fewer distances than pairs, and nine of ten true neighbours, on vectors without clusters."""
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    counts = np.bincount(rng.integers(0, 256, 3000), minlength=256)
    seen = nearest.visit(rng.random(16), rng.random(16), counts, int(0.6 * 3000))
    assert 0.6 * 3000 <= counts[seen].sum() < 0.65 * 3000
    got = {}
    for r in nearest.nearest_neighbours(df).collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    hits = 0
    for q, found in got.items():
        d = np.linalg.norm(x - x[q], axis=1)
        d[q] = np.inf
        hits += len(set(np.argsort(d)[:10].tolist()) & set(found))
    assert len(got) == 30 and hits >= 0.9 * 300

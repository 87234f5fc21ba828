"""Near-duplicates, passages, contamination, quality, language, pipeline: brute force and odd rows."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from geoloom.llm import decontaminate, language, near_dedup, passages, quality
from geoloom.llm.words import mix

WORDS = [f"w{i}" for i in range(400)]


def text(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def changed(rng, t, share):
    return " ".join(rng.choice(WORDS) if rng.random() < share else w for w in t.split(" "))


@pytest.fixture(scope="module")
def corpus():
    rng = random.Random(7)
    rows = [(i, text(rng, rng.randint(1, 160))) for i in range(60)]
    hub = text(rng, 120)
    rows += [(100 + i, changed(rng, hub, rng.uniform(0, 0.12))) for i in range(60)]  # near copies of one text, linked in chains
    rows += [(200 + i, hub) for i in range(12)] + [(300, None), (301, ""), (302, " \n\t"), (303, "one"), (304, "one"), (305, "One two"), (None, hub), (303, "one")]
    long = text(rng, 30_000)
    return rows + [(400, long), (401, long + " tail"), (402, "rep eat " * 4000)]


@pytest.fixture(scope="module")
def documents(spark, corpus):
    df = spark.createDataFrame(corpus, "doc_id long, text string").repartition(3)
    return df.withColumns({"node": F.lit(1), "key": F.lit("k"), "lang": F.lit("en"), "n": F.lit(0.5), "a": F.lit(1), "begin": F.lit(3)})


def shingle_sets(corpus, k):
    out = {}
    for i, t in corpus:
        w = (t or "").encode().lower().split()
        out[i] = {tuple(w)} if 0 < len(w) < k else {tuple(w[j : j + k]) for j in range(len(w) - k + 1)}
    return out


def test_near_duplicates_are_the_brute_force_ones(documents, corpus):
    sets = shingle_sets([r for r in corpus if r[0] is not None], 4)
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    rows = near_dedup.near_duplicates(documents).collect()
    assert len(rows) == len(corpus)
    for r in rows:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.component_id, r.n_shingles, r.kept) == (find(r.doc_id), len(sets[r.doc_id]), find(r.doc_id) == r.doc_id)
    assert near_dedup.near_duplicates(documents.where("false")).count() == 0


def test_keys_meet_within_the_distance(spark):
    rng = np.random.default_rng(1)
    a = rng.integers(0, 2**16, (40, 32), dtype=np.uint16)
    b = a.copy()
    for row in b:  # fifteen symbols of 32 differ
        row[rng.choice(32, 15, replace=False)] ^= 1
    sig = lambda m, p: [(p * 100 + k, *map(int, m[k].view(np.int64))) for k in range(40)]
    schema = "node long, " + ", ".join(f"sig{i} long" for i in range(8))
    df = spark.createDataFrame(sig(a, 0) + sig(b, 1), schema).select("node", F.explode(F.array(*near_dedup.chunk_keys())).alias("key"))
    pairs = df.alias("x").join(df.alias("y"), "key").where("y.node = x.node + 100").select("x.node").distinct()
    assert pairs.count() == 40


def test_compact_windows():
    """Against the recursion: the first minimum of a stretch is its node, left and right of it follow its children."""

    def nodes(h, begin, end, width):
        if end - begin < width:
            return []
        c = begin + int(np.argmin(h[begin:end]))
        return [(begin, c, end - 1), *nodes(h, begin, c, width), *nodes(h, c + 1, end, width)]

    rng = np.random.default_rng(2)
    for width in (3, 20):
        parts = [rng.integers(0, top, n).astype(np.uint64) for top, n in ((1 << 40, 300), (1 << 40, width), (5, 150), (1 << 40, 61))]
        s, ends = np.concatenate(parts), np.cumsum([len(x) for x in parts])
        text, h, *places = passages.compact_windows(s, ends, width)
        for f in range(passages.FUNCTIONS):
            with np.errstate(over="ignore"):
                value = mix(s * passages._MULTIPLY[f] + passages._ADD[f])
            for k, end in enumerate(ends):
                mine = (text == k) & (h & np.uint64(passages.FUNCTION) == f)
                got = sorted(zip(*(x[mine].tolist() for x in places)))
                assert got == sorted(nodes(value[end - len(parts[k]) : end] >> np.uint64(passages.PLACE), 0, len(parts[k]), width))


def test_overlaps_against_all_pairs():
    rng = np.random.default_rng(3)
    l = rng.integers(0, 80, 60)
    c, f = l + rng.integers(0, 30, 60), rng.integers(0, 3, 60)
    r = c + rng.integers(0, 30, 60)
    want = {
        frozenset((i, j)) for i in range(60) for j in range(i)
        if f[i] != f[j] and abs(c[i] - c[j]) < 24 and min(r[i], r[j]) - max(l[i], l[j]) + 1 >= 12 and all(max(l[i], l[j]) <= x <= min(r[i], r[j]) for x in (c[i], c[j]))
    }
    got = [frozenset(p) for p in zip(*(x.tolist() for x in passages.overlaps(f, l, c, r, 12)))]
    assert set(got) == want and len(got) == len(want)
    some = rng.random(60) < 0.3
    assert {frozenset(p) for p in zip(*(x.tolist() for x in passages.overlaps(f, l, c, r, 12, some)))} == {p for p in want if any(some[list(p)])}


def test_overlaps_beyond_what_spans_hold():
    """Pairs that a span holds are left out before they are made."""
    rng = np.random.default_rng(4)
    for many in (0, 1, 2, 5):
        l = rng.integers(0, 80, 60)
        c, f = l + rng.integers(0, 30, 60), rng.integers(0, 3, 60)
        r = c + rng.integers(0, 30, 60)
        begin = rng.integers(0, 90, many)
        spans = begin, begin + rng.integers(5, 60, many)
        held = lambda lo, hi: any(a <= lo and hi + passages.SHINGLE <= b for a, b in zip(*spans))
        pairs = zip(*(x.tolist() for x in passages.overlaps(f, l, c, r, 12)))
        want = {frozenset(p) for p in pairs if not held(min(c[list(p)]), max(c[list(p)]))}
        got = [frozenset(p) for p in zip(*(x.tolist() for x in passages.overlaps(f, l, c, r, 12, beyond=passages._reach(spans, c))))]
        assert set(got) == want and len(got) == len(want)


def test_heaviest_stretch_over_a_bound():
    """The same stretch as without a bound where it weighs more, none where it does not."""
    rng = np.random.default_rng(5)
    for _ in range(200):
        y, n = rng.integers(0, 12, 40), 40
        common, before = np.isin(y, rng.integers(0, 12, 7)), np.array([max(np.flatnonzero(y[:k] == y[k]), default=-1) for k in range(n)])
        begin = np.arange(n) - 9
        weights = {(i, j): sum(100 if common[np.flatnonzero(y == v)[0]] else -80 for v in set(y[i : j + 1].tolist())) for j in range(n) for i in range(max(0, begin[j] + 1))}
        top = max(weights.values())
        weight, i, j = passages._heaviest(common, before, begin, 80, top - 1) if top > 0 else (top, 0, 0)
        assert weight == top and (top <= 0 or weights[i, j] == top)
        assert passages._heaviest(common, before, begin, 80, max(top, 0)) == (max(top, 0), 0, 0)


def test_repeated_passages(spark):
    rng = random.Random(11)
    common, near = text(rng, 60), text(rng, 80)
    rows = [(i, text(rng, 100)) for i in range(30)]
    rows += [(50 + i, f"{text(rng, 40)} {common} {text(rng, 40)}") for i in range(8)]
    words = near.split(" ")
    words[40] = "other"
    rows += [(70, f"{text(rng, 30)} {near}"), (71, f"{' '.join(words)} {text(rng, 30)}"), (80, None), (81, ""), (None, common), (82, common[:100]), (90, "x y " * 5000), (91, "x y " * 5000)]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit(1))
    found = passages.repeated_passages(df)
    held = {}
    for r in found.collect():
        assert r.match_id < r.doc_id
        held.setdefault(r.doc_id, []).append((r.begin, r.end))
    assert set(held) == {*range(51, 58), 71, 91}
    assert all(any(a <= 40 and b >= 100 for a, b in held[i]) for i in range(51, 58)) and any(a == 0 and b >= 80 for a, b in held[71])
    cut = {r.doc_id: r.text for r in passages.cut_passages(df.drop("key"), found).collect()}
    assert all(common not in cut[i] for i in range(51, 58)) and common in cut[50] and 91 not in cut and 80 in cut
    assert cut[0] == rows[0][1] and len(cut[51].split()) == 80
    assert passages.repeated_passages(df.where("false")).count() == 0


def brute_contamination(doc, items):
    w, hit, names = decontaminate.item_words(doc.encode()), set(), set()
    for name, t in items:
        x = decontaminate.item_words((t or "").encode())
        for win in {tuple(x[k : k + 13]) for k in range(max(1, len(x) - 12))} if x else ():
            for p in range(len(w) - len(win) + 1):
                if tuple(w[p : p + len(win)]) == win:
                    hit |= set(range(p, p + len(win)))
                    names.add(name)
    return len(w), len(hit), len(names), len(hit) > 0 and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [decontaminate.BLOCK, 7])
def test_contamination(spark, block):
    rng = random.Random(5)
    items = [(k, text(rng, rng.choice([3, 12, 13, 14, 40]))) for k in range(12)] + [(50, None), (51, "..."), (None, text(rng, 20)), (60, "one"), (61, "one")]
    docs = [(k, text(rng, 60)) for k in range(10)]
    for k, (_, t) in enumerate(items[:12]):
        part = t.split(" ")
        a = rng.randint(0, max(0, len(part) - 13))
        docs.append((100 + k, f"{text(rng, 50)}; {' '.join(part[a : a + 20]).upper()}!{text(rng, 50)}"))
    docs += [(200, None), (201, ""), (202, "ONE"), (None, items[4][1]), (203, items[3][1] * 3)]
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumns({"uid": F.lit(1), "item_id": F.lit(2), "spans": F.lit("")})
    bench = spark.createDataFrame(items, "item_id long, text string").withColumn("window", F.lit(1))
    got = sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, r.contaminated) for r in decontaminate.contamination(df, bench, block=block).collect())
    known = [(i, t) for i, t in items if i is not None]
    assert got == sorted((str(i), *brute_contamination(t or "", known)) for i, t in docs)
    assert {r.contaminated for r in decontaminate.contamination(df, bench.where("false")).collect()} == {False}


def test_quality_rules(spark):
    rng = random.Random(3)
    good = [(i, text(rng, 80) + ".") for i in range(300)]
    bad = [(1000 + i, "!! ".join(text(rng, 60).upper().split(" ")) if i % 2 else "### ".join(text(rng, 50).split(" "))) for i in range(150)]
    docs = spark.createDataFrame(good + bad + [(5000, None), (5001, ""), (None, "x"), (5002, "z" * 200_000)], "doc_id long, text string").withColumns({"upper": F.lit(1), "y": F.lit(2)})
    labels = spark.createDataFrame([(i, 1) for i, _ in good] + [(i, 0) for i, _ in bad] + [(5001, None), (None, 1), (3, 1)], "doc_id long, quality int")
    rows = {r.doc_id: r for r in quality.score_quality(docs, labels).collect()}
    assert len(rows) == 454 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in rows.values())
    held = [(r, i < 1000) for i, r in rows.items() if r.held_out and i is not None and i < 5000]
    assert held and np.mean([bool(r.predicted) == g for r, g in held]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in rows.items() if i is not None)
    model = quality.fit(docs, labels)
    assert 0 < len(model.rules) < 200 and all(1 <= len(r) <= 3 for r in model.rules)
    # scores change neither with labels of held-out rows nor with lang or source
    twisted = labels.withColumn("quality", F.when(language.held_out(), 1 - F.col("quality")).otherwise(F.col("quality")))
    again = {r.doc_id: r.score for r in quality.score_quality(docs.withColumn("lang", F.lit("x")), twisted).collect()}
    assert again == {i: r.score for i, r in rows.items()}
    assert {r.score for r in quality.score_quality(docs, labels.where("false")).collect()} == {0.5}
    assert quality.score_quality(docs.where("false"), labels).count() == 0
    assert quality.keep_good(docs, labels).columns == docs.columns


def test_language(spark):
    rng = random.Random(9)
    parts = {"xx": ["ka", "lo", "mi", "tu"], "yy": ["sch", "ung", "eit", "ver"], "zz": ["ção", "ñe", "ará", "lh"]}
    make = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(60))
    rows = [(k, make(lang), lang) for k, lang in enumerate(rng.choice(list(parts)) for _ in range(150))]
    odd = [(900, None, "xx"), (901, "", "yy"), (902, "123 !?", None), (None, make("yy"), None), (903, "KALO" * 30_000, None), (0, rows[0][1], "xx")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string").withColumns({"score": F.lit(1), "gram": F.lit(1), "h": F.lit(1)})
    got = language.identify_language(docs).collect()
    assert len(got) == 156 and all(0 <= r.score <= 1 for r in got)
    by = {r.doc_id: r.lang_pred for r in got}
    assert all(by[k] == lang for k, _, lang in rows[1:]) and by[900] == by[901] == by[902] == "und" and by[None] == "yy" and by[903] == "xx"
    assert {r.lang_pred for r in language.identify_language(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identify_language(docs.where("false")).count() == 0

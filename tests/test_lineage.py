import pytest

from geoloom.operators import lineage


def test_closure_tells_what_it_cannot_reach(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(7)], "src long, dst long")
    start = spark.createDataFrame([(0,)], "node long")
    assert sorted(map(tuple, lineage.closure(edges, start).collect())) == [(i, i) for i in range(8)]
    assert lineage.closure(edges, start, most=7).count() == 8
    with pytest.raises(ValueError):
        lineage.closure(edges, start, most=6)


@pytest.fixture
def files(spark):
    def make(edges, times, targets):
        return (
            spark.createDataFrame(edges, "src string, dst string"),
            spark.createDataFrame([(t,) for t in targets], "node string"),
            spark.createDataFrame(times, "node string, mtime long"),
        )

    return make


def test_order_follows_the_longest_way(files):
    # a needs c both at once and by way of b: b is made before a, c before b
    edges, targets, times = files([("a", "b"), ("a", "c"), ("b", "c"), ("b", "c"), ("x", "c"), (None, "c"), ("a", None)], [("a", 9), ("b", 8), ("c", 7), ("x", 1)], ["a"])
    rows = lineage.build_order(edges, targets, times).collect()
    assert [(r.node, r.level, r.newest, r.stale) for r in rows] == [("c", 0, None, False), ("b", 1, 7, False), ("a", 2, 8, False)]


def test_a_new_file_far_below_makes_all_above_stale(files):
    edges, targets, times = files([("a", "b"), ("b", "c"), ("c", "d"), ("a", "e")], [("a", 5), ("b", 4), ("c", 3), ("d", 6), ("e", 1)], ["a"])
    rows = {r.node: (r.level, r.newest, r.stale, r.build) for r in lineage.build_order(edges, targets, times).collect()}
    assert rows == {"d": (0, None, False, False), "e": (0, None, False, False), "c": (1, 6, True, True), "b": (2, 6, True, True), "a": (3, 6, True, True)}


def test_missing_files(files):
    chain = [("a", "b"), ("b", "c")]
    # a product that is missing is stale; what stands between is not made if the target is newer than all that is there
    edges, targets, times = files(chain, [("a", None), ("c", 1)], ["a"])
    assert {r.node: r.build for r in lineage.build_order(edges, targets, times).collect()} == {"c": False, "b": True, "a": True}
    edges, targets, times = files(chain, [("a", 5), ("c", 1)], ["a"])
    assert {r.node: (r.stale, r.build) for r in lineage.build_order(edges, targets, times).collect()} == {"c": (False, False), "b": (True, False), "a": (False, False)}
    # nothing makes c, and it is not there: an error if it is needed, none if nothing needs to be made
    edges, targets, times = files(chain, [("b", 2)], ["a"])
    assert lineage.build_order(edges, targets, times).where("build").count() == 1
    edges, targets, times = files(chain, [], ["a"])
    with pytest.raises(ValueError, match="'c'"):
        lineage.build_order(edges, targets, times)


def test_cycles_are_told(files):
    edges, targets, times = files([("a", "b"), ("b", "c"), ("c", "b"), ("b", "d")], [], ["a"])
    with pytest.raises(ValueError, match="'a', 'b', 'c'"):
        lineage.levels(edges, times)
    with pytest.raises(ValueError):
        lineage.build_order(edges, targets, times)


def test_levels_of_a_long_chain_and_none(files, spark):
    n = 20
    edges, _, times = files([(str(k + 1), str(k)) for k in range(n)], [("0", 3), ("alone", 1)], [])
    got = {r.node: (r.level, r.newest) for r in lineage.levels(edges, times).collect()}
    assert got == {"0": (0, None), "alone": (0, None), **{str(k): (k, 3) for k in range(1, n + 1)}}
    assert lineage.levels(edges.where("false"), times.where("false")).count() == 0


def test_a_round_rewrites_only_nodes_it_counts(files, monkeypatch):
    n, written, plain = 12, [], lineage.stage

    def counted(df, name):
        out = plain(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(lineage, "stage", counted)
    edges, _, times = files([(str(k + 1), str(k)) for k in range(n)], [("0", 3)], [])
    assert lineage.levels(edges, times).count() == n + 1
    assert sum(written) < 6 * n  # not a table of all that wait in every round

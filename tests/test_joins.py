import pytest

from vistaframe.functions.model import JoinError
from vistaframe.operators import joins


@pytest.fixture(scope="module")
def sides(spark):
    l = spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 3), (3, "d", 4), (None, "e", 5), (9, "f", 6)], "k int, v string, big int")
    r = spark.createDataFrame([(1, "x", 7, True), (3, "y", 8, True), (7, "z", 9, False), (None, "n", 0, True)], "k int, v string, v_1 int, zz boolean")
    return l, r


def test_probe_counts_distinct_tuples(sides):
    l, r = sides
    assert tuple(joins.join_probe(l, r, ["k"]).first()) == (5, 2, 3, 0.4)
    assert [x.k for x in joins.unmatched_keys(l, r, ["k"]).collect()] == [2, 9, None]
    assert joins.unmatched_keys(l, r, ["k"], limit=1).count() == 1
    n = joins.join_probe(l, r, ["k", "v"]).first()
    assert n.n_keys == 6 and n.n_matched == 0 and n.n_unmatched == joins.unmatched_keys(l, r, ["k", "v"]).count()
    assert joins.join_probe(l.limit(0), r, ["k"]).first().frac == 0.0


def test_candidates(sides):
    assert [tuple(x) for x in joins.join_candidates(*sides).collect()] == [(0, "k", "int", "int", True), (1, "v", "string", "string", True)]


@pytest.mark.parametrize("how,n", [("inner", 3), ("left", 6), ("right", 5), ("full", 8)])
def test_merges(sides, how, n):
    out = joins.merge(*sides, ["k"], how)
    assert out.columns == ["k", "v", "big", "v_2", "v_1", "zz"] and out.count() == n
    if how in ("right", "full"):
        assert {x.k for x in out.collect()} >= {1, 3, 7}


def test_keys_are_checked_first(sides):
    l, r = sides
    for args in ((l, r, []), (l, l, ["k"]), (l, r, ["big"]), (l, r, ["zz"])):
        with pytest.raises(JoinError):
            joins.merge(*args)
    with pytest.raises(JoinError):
        joins.merge(l, r, ["k"], "cross")

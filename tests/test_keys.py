import datetime

import pytest
from pyspark.sql import functions as F

from vistaframe.operators import joins, keys


def one(df, l, r):
    return df.where((F.col("left_column") == l) & (F.col("right_column") == r)).first()


@pytest.mark.parametrize("share", [0.0, 0.05, 0.3, 0.9, 1.0])
@pytest.mark.parametrize("rows", [(40_000, 90_000), (300, 90_000), (90_000, 300), (200, 200)])
def test_estimates_lie_within_their_error(spark, share, rows):
    n, m = rows
    hits = min(m, round(n * share))
    left = spark.range(n).select(F.when(F.col("id") < hits, F.col("id")).otherwise(-F.col("id") - 1).alias("k")).repartition(5)
    right = spark.range(m).select(F.col("id").alias("k"))
    got = one(keys.containment(left, right), "k", "k")
    # three standard errors: one in a few hundred draws lies beyond, and these are fixed
    assert abs(got.contained - hits / n) <= 1.5 * got.error + 1e-9
    assert abs(got.n_left - n) <= 0.06 * n and abs(got.n_right - m) <= 0.06 * m
    if n < 4096 and m < 4096:
        assert got.error == 0 and got.contained == hits / n and got.covered == hits / m


def test_values_are_equal_by_kind(spark):
    left = spark.sql("select * from values (1, 'a', date'2020-01-01', true), (2, 'b', null, false), (3, null, date'2021-01-01', null) t(i, s, d, b)")
    right = spark.sql("select * from values (1.0d, decimal(2), timestamp'2020-01-01', 'b', true), (2.5d, decimal('3'), null, '1', false), (double('nan'), null, null, null, true) t(x, e, at, s, b)")
    got = {(r.left_column, r.right_column): (r.contained, r.covered) for r in keys.containment(left, right).collect()}
    assert set(got) == {("i", "x"), ("i", "e"), ("s", "s"), ("d", "at")}
    assert got["i", "x"] == (pytest.approx(1 / 3), pytest.approx(1 / 3))
    assert got["i", "e"] == (pytest.approx(2 / 3), 1.0)
    assert got["s", "s"] == (0.5, 0.5) and got["d", "at"] == (0.5, 1.0)


def test_keys_come_first_and_are_probed(spark):
    parents = spark.range(1, 2001).selectExpr("id", "concat('p', id) as name", "id % 7 as class")
    children = spark.range(1, 9001).selectExpr("id as row", "1 + id % 1900 as parent", "1 + id % 5 as line", "concat('p', id % 50) as named", "cast(null as int) as nothing")
    got = keys.key_pairs(children, parents, probe=2).collect()
    assert (got[0].left_column, got[0].right_column) == ("parent", "id") and got[0].frac == 1.0 and got[0].n_keys == 1900
    assert [r.rank for r in got] == list(range(1, len(got) + 1))
    assert got[1].frac is not None and all(r.frac is None for r in got[2:])
    assert not any(r.left_column == "nothing" for r in got)
    for r in got[:2]:
        exact = joins.join_probe(children.select(F.col(r.left_column).alias("k")), parents.select(F.col(r.right_column).alias("k")), ["k"]).first()
        assert exact.frac == r.frac and abs(exact.frac - r.contained) <= 1.5 * r.error + 1e-9


def test_tables_without_values_or_keys(spark):
    some = spark.range(5)
    assert keys.key_pairs(some.limit(0), some).collect() == []
    assert keys.key_pairs(some.selectExpr("array(id) as a", "id > 2 as b"), some).collect() == []
    got = keys.containment(some.selectExpr("cast(null as int) as k"), some).first()
    assert (got.contained, got.n_left) == (0.0, 0)


def test_names_with_dots_and_long_numbers(spark):
    left = spark.createDataFrame([(2**62 + 1, datetime.date(2020, 1, 1))], "`a.b` long, d date")
    right = spark.createDataFrame([(2**62, 1)], "`x y` long, z int")
    got = keys.containment(left, right).collect()
    assert {(r.left_column, r.right_column, r.contained) for r in got} == {("a.b", "x y", 0.0), ("a.b", "z", 0.0)}

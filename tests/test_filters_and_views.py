import itertools

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from vistaframe.functions.filters import where
from vistaframe.functions.model import Filter, QuerySpec, Sort, UnknownColumn, kind_of
from vistaframe.operators import view
from vistaframe.plans import sqlbox
from vistaframe.functions.model import SQLRejected
from vistaframe.sources.shared import stored

ROWS = [(1, "a"), (2, ""), (3, None), (4, "A%b"), (5, "x_y"), (6, "back\\slash"), (7, "N/A"), (7, "a")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, "n long, s string")


def keys(frame):
    return sorted((r.n, r.s or "") for r in frame.collect())


CASES = [
    (Filter("s", "=", ("a", "ignored")), lambda n, s: s == "a"),
    (Filter("s", "!=", ("a",)), lambda n, s: s is not None and s != "a"),
    (Filter("n", "<", (3,)), lambda n, s: n < 3), (Filter("n", "<=", (3,)), lambda n, s: n <= 3),
    (Filter("n", ">", (3,)), lambda n, s: n > 3), (Filter("n", ">=", (3,)), lambda n, s: n >= 3),
    (Filter("n", "between", (2, 4)), lambda n, s: 2 <= n <= 4),
    (Filter("s", "contains", ("a",)), lambda n, s: s is not None and "a" in s.lower()),
    (Filter("s", "contains", ("back\\s",)), lambda n, s: s == "back\\slash"),
    (Filter("s", "contains", ("x%y",)), lambda n, s: s == "x_y"),
    (Filter("n", "contains", (7,)), lambda n, s: n == 7),
    (Filter("s", "in", ("a", None)), lambda n, s: s in ("a", None)), (Filter("s", "in", (None,)), lambda n, s: s is None),
    (Filter("s", "not_in", ("a",)), lambda n, s: s != "a"), (Filter("s", "not_in", ("a", None)), lambda n, s: s not in ("a", None)),
    (Filter("s", "not_in", (None,)), lambda n, s: s is not None),
    (Filter("s", "is_null"), lambda n, s: s is None), (Filter("s", "not_null"), lambda n, s: s is not None), (Filter("s", "is_empty"), lambda n, s: s == ""),
    (Filter("s", "in", ()), lambda n, s: True), (Filter("s", "=", ()), lambda n, s: True),
]


@pytest.mark.parametrize("f,test", CASES)
def test_filters_and_their_sql(spark, df, f, test):
    want = sorted((n, s or "") for n, s in ROWS if test(n, s))
    assert keys(where(df, [f])) == want
    df.createOrReplaceTempView("some_rows")
    assert keys(sqlbox.read_only_sql(spark, sqlbox.render_sql("some_rows", QuerySpec((f,), (Sort("n"),))))) == want


def test_conjunction_and_facet_rule(df):
    spec = QuerySpec((Filter("n", ">", (1,)), Filter("s", "=", ("a",))))
    assert keys(where(df, spec.filters)) == [(7, "a")]
    assert spec.without_column("s").filters == spec.filters[:1]


def test_errors_come_before_a_plan(df):
    with pytest.raises(UnknownColumn):
        where(df, [Filter("nope", "is_null")])
    with pytest.raises(UnknownColumn):
        view.page(df, QuerySpec((), (Sort("N "),)))
    with pytest.raises(ValueError):
        Filter("n", "like", ("x",))
    with pytest.raises(ValueError):
        Filter("n", "between", (1,))


def test_kinds():
    kinds = {"boolean": "bool", "tinyint": "number", "decimal(10,2)": "number", "double": "number", "string": "text", "date": "temporal", "timestamp": "temporal",
             "timestamp_ntz": "temporal", "binary": "blob", "array<int>": "nested", "struct<a: int>": "nested", "map<string, int>": "nested", "interval day to second": "temporal"}
    for name, kind in kinds.items():
        assert kind_of(T.StructType.fromDDL(f"c {name}")["c"].dataType) == kind


def test_nulls_last_both_ways(df):
    for down in (False, True):
        assert view.select(df, QuerySpec((), (Sort("s", down),))).collect()[-1].s is None


@settings(max_examples=8, deadline=None)
@given(st.lists(st.tuples(st.integers(0, 3), st.sampled_from(["x", "y", None])), max_size=40))
def test_pages_join_to_the_whole_view(spark, rows):
    df = spark.createDataFrame(rows, "a int, b string").repartition(3)
    whole = view.sorted_view(df, QuerySpec((), (Sort("b", True),)), stored)
    pages = list(itertools.chain(*[view.page_at(whole, o, 7).collect() for o in range(0, 42, 7)]))
    assert [r.row_no for r in pages] == list(range(1, len(rows) + 1))
    key = lambda r: (r[1] is None, [-ord(c) for c in r[1] or ""], r[0])
    assert [(r.a, r.b) for r in pages] == sorted(rows, key=key)


def test_numbering_breaks_ties_by_all_columns_even_maps(spark):
    df = spark.sql("SELECT id % 2 AS k, map('a', id) AS m, array(id) AS l FROM range(20)")
    out = view.numbered(df, QuerySpec((), (Sort("k"),)), stored).collect()
    assert sorted(r.row_no for r in out) == list(range(1, 21))


@pytest.mark.parametrize("sql", [
    "", "  ", "-- only a comment", "/* a */", "DROP TABLE t", "insert into t values (1)", "SELECT 1; SELECT 2", "EXPLAIN SELECT 1", "/* x */ create view v as select 1",
    "SET a = 1", "(delete from t)", "SELECT reflect('java.lang.System', 'getProperty', 'user.name')", "SELECT x FROM (SELECT `java_method`('java.util.UUID', 'randomUUID') AS x)",
    "SELECT 1 WHERE EXISTS (SELECT try_reflect('java.util.UUID', 'randomUUID'))", 'SELECT "a" ; drop table t --"', "SELECT 'a\\\\' ; drop table t --'",
])
def test_what_is_no_query_is_refused(spark, sql):
    with pytest.raises(SQLRejected):
        sqlbox.read_only_sql(spark, sql)


@pytest.mark.parametrize("sql", ["SELECT 1) AS a, (SELECT 2", "SHOW TABLES", "DESCRIBE t"])
def test_what_does_not_parse_as_a_subquery_fails(spark, sql):
    with pytest.raises(Exception):
        sqlbox.read_only_sql(spark, sql).collect()


@pytest.mark.parametrize("sql,n", [
    ("SELECT 1 AS x", 1), ("SELECT 1 AS x;", 1), ("WITH a AS (SELECT 1 AS x) SELECT * FROM a -- end; here", 1), ("VALUES (1), (2)", 2),
    ("SELECT ';' AS x /* ; */", 1), ("SELECT 'drop table' AS x", 1),
    ('SELECT "a\\" ; drop table t --"', 1), ("SELECT 'CallMethodViaReflection' AS x", 1),
])
def test_queries_run(spark, sql, n):
    assert sqlbox.read_only_sql(spark, sql).count() == n
    assert sqlbox.read_only_sql(spark, sql, limit=1).count() == 1


def test_page_of_sql(spark):
    assert [r.id for r in sqlbox.read_only_sql(spark, "SELECT id FROM range(10) ORDER BY id", limit=2, offset=3).collect()] == [3, 4]

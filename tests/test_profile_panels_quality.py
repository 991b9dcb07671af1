import datetime

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaframe.functions.casts import cast_strict, is_bad
from vistaframe.functions.model import Filter, QuerySpec, UnknownColumn
from vistaframe.operators import panels, profile, quality
from vistaframe.plans import catalog_tables
from vistaframe.plans.dirty import DIRTY_SCHEMA, dirty_orders


def values(spark, texts, kind):
    t = T.DataType.fromDDL(kind)
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    rows = df.select("i", cast_strict(F.col("x"), t).cast("string").alias("v"), is_bad(F.col("x"), t).alias("bad")).orderBy("i").collect()
    return [r.v for r in rows], [r.bad for r in rows]


@pytest.mark.parametrize("kind,texts,want", [
    ("bigint", ["1", " 12 ", "12.5", "1e3", "3d", "1,000", "nan", "", None, "9223372036854775808", "2024-01-01"], ["1", "12", "13", "1000", None, None, None, None, None, None, None]),
    ("double", ["1.5", "1e3", "3d", "nan", "x", ".5", "5."], ["1.5", "1000.0", None, "NaN", None, "0.5", "5.0"]),
    ("date", ["2024-01-31", "2024", "2024-02-30", "x", " 2024-1-3 "], ["2024-01-31", None, None, None, "2024-01-03"]),
    ("timestamp", ["2024-01-31 10:00:00", "12:00", "2024-01-31"], ["2024-01-31 10:00:00", None, "2024-01-31 00:00:00"]),
    ("boolean", ["true", "yes", "F", "2"], ["true", "true", "false", None]),
    ("decimal(5,2)", ["1.239", "1000000", "1f"], ["1.24", None, None]),
])
def test_strict_casts(spark, kind, texts, want):
    got, bad = values(spark, texts, kind)
    assert got == want
    assert bad == [w is None and t is not None and t.strip() != "" for w, t in zip(want, texts)]


def test_text_loses_nothing(spark):
    assert values(spark, ["x", "", None], "string")[1] == [False] * 3


def test_quality_adds_up(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    n, bad = quality.bad_row_count(df, DIRTY_SCHEMA).first()
    assert n == df.count() and 0 < bad < n
    assert quality.good_rows(df, DIRTY_SCHEMA).count() == n - bad == n - quality.bad_rows(df, DIRTY_SCHEMA, None).count()
    scan = quality.quality_scan(df, DIRTY_SCHEMA).first()
    cells = {r.column: r.n_bad for r in quality.uncastable_cells(df, DIRTY_SCHEMA).collect()}
    assert scan.n_bad_rows == bad and scan.n_bad_cells == sum(cells.values())
    assert {p["column"]: p["n"] for p in scan.bad_columns} == {c: v for c, v in cells.items() if v}
    assert cells["status"] == 0 and quality.bad_rows(df, DIRTY_SCHEMA, 3).count() == 3
    none = quality.quality_scan(df.select("status"), T.StructType([DIRTY_SCHEMA["status"]])).first()
    assert none.n_bad_rows == none.n_bad_cells == 0


def test_type_names():
    assert quality.parse_type("decimal(12,2)") == T.DecimalType(12, 2)
    for name in ("bigint); drop table t", "nope", "a int, b int"):
        with pytest.raises(Exception):
            quality.parse_type(name)


def test_missing_kinds_never_overlap(spark):
    df = spark.createDataFrame([(x,) for x in [None, "", " ", "N/A", "-", "Unknown ", "x", "longer", "\t"]], "s string")
    r = profile.missing_counts(df).first()
    assert (r.n, r.n_null, r.n_empty, r.n_nullish, r.max_len) == (9, 1, 1, 4, 8)


def test_profile_of_every_kind(spark):
    df = spark.sql("""SELECT id AS n, cast(id AS string) AS s, id % 2 = 0 AS b, date_add(date'2020-01-01', cast(id AS int)) AS d, array(id) AS l,
      named_struct('a', id) AS r, cast(NULL AS string) AS e, cast('x' AS binary) AS y FROM range(200)""")
    p = {r.column: r for r in profile.profile(df).collect()}
    assert len(p) == 8 and p["n"].kind == "number" and p["l"].kind == "nested" and p["y"].kind == "blob"
    assert p["n"].min == "0" and p["n"].max == "199" and p["n"].avg == 99.5 and p["n"].view == "hist" and p["b"].view == "topn" and p["s"].view == "topn"
    assert p["e"].n_null == 200 and p["e"].missing_fraction == 1.0 and p["e"].max_len is None
    assert all(0 <= r.approx_distinct <= 200 for r in p.values())
    assert p["d"].q50 is not None and p["l"].min is None


def test_wide_profile_in_batches(spark):
    df = spark.range(50).select(*[(F.col("id") * i).alias(f"c{i}") for i in range(120)])
    assert [r.position for r in profile.profile(df).orderBy("position").collect()] == list(range(120))


def test_empty_frames(spark):
    df = spark.createDataFrame([], "a int, s string")
    assert [r.n for r in profile.profile(df).collect()] == [0, 0]
    assert panels.top_values(df, "s").collect() == [] and panels.histogram(df, "a").collect() == []
    assert panels.histogram_state(df, "a").first().reason == "no values"
    assert panels.key_ratio(df, "a").first().ratio == 0.0


def test_views_and_clamps(spark):
    def view(kind, d, n):
        return spark.range(1).select(profile.suggested_view(F.lit(kind), F.lit(d), F.lit(n))).first()[0]
    assert [view("number", 51, 100), view("number", 50, 100), view("temporal", 60, 100)] == ["hist", "topn", "hist"]
    assert [view("text", 1001, 1100), view("text", 1000, 1000), view("text", 1800, 2000), view("text", 1801, 2000)] == ["highcard", "topn", "topn", "highcard"]
    assert spark.range(1).select(profile.clamp_distinct(F.lit(340), F.lit(300))).first()[0] == 300


def test_serial_dates(spark):
    df = spark.createDataFrame([(43831, 10, 44000.5), (43832, 20, 44000.5)], "d int, n int, one double")
    got = {r.column: r for r in profile.serial_dates(df).collect()}
    assert got["d"].looks_like_dates and got["d"].first == datetime.date(2020, 1, 1)
    assert not got["n"].looks_like_dates and not got["one"].looks_like_dates


@pytest.fixture(scope="module")
def shop(spark):
    rows = [(None, 1.0), ("", 2.0), ("a", 3.0), ("a", 4.0), ("B", 5.0), ("␀ NULL", None)]
    return spark.createDataFrame(rows, "s string, v double")


def test_top_values(shop):
    top = panels.top_values(shop, "s").collect()
    assert top[0].label == "a" and top[0].n == 2 and abs(sum(r.frac for r in top) - 1) < 1e-12
    assert sorted(r.label for r in top) == ["B", "a", "␀ EMPTY", "␀ NULL", "␀ NULL"]
    assert [r.value for r in panels.top_values(shop, "s", search="b").collect()] == ["B"]
    assert panels.top_values(shop, "s", search="b").first().frac == 1.0
    spec = QuerySpec((Filter("s", "in", ("a", None)), Filter("v", ">=", (2.0,))))
    got = {r.label: (r.n, r.selected) for r in panels.top_values(shop, "s", spec=spec).collect()}
    assert got == {"a": (2, True), "␀ EMPTY": (1, False), "B": (1, False)}
    with pytest.raises(UnknownColumn):
        panels.top_values(shop, "nope")


def test_distinct_and_keys(shop):
    shown = panels.top_values(shop, "s", limit=1)
    r = panels.distinct_stats(shop, "s", exact=True, shown=shown).first()
    assert (r.n_rows, r.n_nonnull, r.n_distinct_exact, r.other_n) == (6, 5, 4, 4)
    assert panels.key_ratio(shop, "v").first().ratio == pytest.approx(5 / 6)


def test_few_values_are_counted_exactly(spark, monkeypatch):
    df = spark.range(20_000).selectExpr("id % 3000 as few", "id as many", "cast(null as string) as none")
    monkeypatch.setattr(profile, "EXACT_DISTINCT_MAX", 10_000)
    got = {r.column: r.approx_distinct for r in profile.profile(df, exact_few=True).collect()}
    sketched = {r.column: r.approx_distinct for r in profile.profile(df).collect()}
    assert got == {"few": 3000, "many": sketched["many"], "none": 0}
    monkeypatch.setattr(profile, "EXACT_DISTINCT_MAX", 0)
    assert {r.column: r.approx_distinct for r in profile.profile(df, exact_few=True).collect()} == sketched
    assert [tuple(r) for r in profile.distinct_exact(df, [0]).collect()] == [(0, "few", 3000)]


def test_many_values_are_counted_exactly(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(profile, "EXACT_DISTINCT_MAX", 10_000)
    df = spark.range(50_000).selectExpr("id % 3000 as few", "id as many", "cast(id % 40000 as string) as text", "cast(null as string) as none")
    got = {r.column: r.approx_distinct for r in profile.profile(df, exact_few=True, exact_many=True).collect()}
    assert got == {"few": 3000, "many": 50_000, "text": 40_000, "none": 0}
    sketched = {r.column: r.approx_distinct for r in profile.profile(df).collect()}
    assert {r.column: r.approx_distinct for r in profile.profile(df, exact_many=True).collect()} == got | {"few": sketched["few"]}
    orders = spark.range(30_000).selectExpr("id as o_orderkey", "id % 20000 as o_custkey")
    orders.write.parquet(f"{tmp_path}/orders.parquet")
    rows = catalog_tables.profile_exact_few(spark, str(tmp_path)).collect()
    assert [(r.approx_distinct, r.view) for r in sorted(rows, key=lambda r: r.position)] == [(30_000, "hist"), (20_000, "hist")]


def test_histograms(spark, shop):
    df = spark.range(101).select((F.col("id") * 1.0).alias("v"), F.expr("if(id % 10 = 0, NULL, id)").alias("w"))
    h = panels.histogram(df, "v", 10).collect()
    assert [r.n for r in h] == [10] * 9 + [11] and h[-1].b_max == 100.0
    cut = panels.histogram(df, "v", 10, QuerySpec((Filter("w", ">", (50,)), Filter("v", "<", (5.0,))))).collect()
    assert [r.b for r in cut] == [5, 6, 7, 8, 9] and sum(r.n for r in cut) == 45
    dense = panels.dense_histogram(df, "w", 200).collect()
    assert [r.b for r in dense] == list(range(200)) and sum(r.n for r in dense) + dense[0].n_null == 101
    assert panels.histogram_state(shop.where("v = 1.0"), "v").first().reason == "one value"
    assert panels.dense_histogram(shop.where("v = 1.0"), "v").collect() == []
    days = spark.sql("SELECT date_add(date'2020-01-01', cast(id AS int)) AS d FROM range(10)")
    assert [r.n for r in panels.histogram(days, "d", 3).collect()] == [3, 3, 4]


def test_lengths_and_samples(shop):
    assert [tuple(r) for r in panels.length_histogram(shop, "s").collect()] == [(0, 1), (1, 3), (6, 1)]
    assert panels.sample_values(shop, "s", 3, seed=1).count() == 3
    assert panels.sample_values(shop, "nope").collect() == []

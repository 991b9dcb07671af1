import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from vistaframe.operators import partials, profile


def test_quantiles_merge_in_any_order():
    rng = np.random.default_rng(1)
    data = np.concatenate([rng.normal(size=70_001), rng.exponential(size=50_000), np.full(30_000, 0.5)])
    rng.shuffle(data)
    pieces = np.split(data, sorted(rng.integers(0, len(data), 40)))
    total = partials.Quantiles()
    for p in rng.permutation(len(pieces)):
        q = partials.Quantiles()
        for some in np.array_split(pieces[p], 3):
            q.add(some)
        total.merge(partials.Quantiles.loads(q.dumps()))
    ordered = np.sort(data)
    for share, v in zip((0.01, 0.25, 0.5, 0.75, 0.99), total.at([0.01, 0.25, 0.5, 0.75, 0.99])):
        low, high = np.searchsorted(ordered, v) / len(data), np.searchsorted(ordered, v, "right") / len(data)
        assert low - 0.01 <= share <= high + 0.01
    assert len(total.rest) + sum(partials.RUN << k for k in total.levels) == len(data)
    assert partials.Quantiles().at([0.5]) == [None]
    few = partials.Quantiles()
    few.add(np.array([3, 1, 2]))
    assert partials.Quantiles.loads(few.dumps()).at([0.25, 0.5, 0.75]) == [1, 2, 3]


@pytest.mark.parametrize("n", [0, 1, 10, 1000, 5000, 20_000, 200_000])
def test_distinct_estimates(n):
    off = []
    for seed in range(5):
        h = np.random.default_rng(seed).integers(-(2**63), 2**63, n)
        a, b = (np.zeros(1 << partials.BITS, np.uint8) for _ in range(2))
        partials.registers(h[: n // 2], a)
        partials.registers(np.concatenate([h[n // 3 :], h[:5]]), b)
        off.append(partials.estimate(np.maximum(a, b)) - len(np.unique(h)))
    assert max(map(abs, off)) <= 0.07 * n and abs(np.mean(off)) <= 0.03 * n


TYPES = """id, cast(id % 100 as int) as i, cast(id as double) / 7 as d, cast(id / 3 as float) as f, cast(id / 8 as decimal(20,3)) as m, id % 3 = 0 as b,
 date_add(date'2020-02-27', cast(id % 400 as int)) as day, timestamp_micros(1600000000000000 + id * 1234567) as t, cast(timestamp_micros(id * 999) as timestamp_ntz) as l,
 case id % 9 when 0 then null when 1 then '' when 2 then ' N/A ' when 3 then 'é' when 4 then '  ' else concat('v', id % 2000) end as s,
 if(id % 5 = 0, null, array(id)) as a, cast(cast(id as string) as binary) as x, cast(null as int) as none, if(id = 77, double('nan'), 1.5D) as nan, if(id % 4 = 0, null, -id) as neg"""
EXACT = ["position", "column", "type", "min", "max", "n", "null_pct", "n_null", "n_empty", "n_nullish", "max_len", "kind", "n_uncastable"]


@pytest.fixture(scope="module")
def mixed(spark):
    return spark.range(6000).repartition(5).selectExpr(*_split(TYPES))


def _split(text):
    out, depth, at = [], 0, 0
    for k, c in enumerate(text):
        depth += (c == "(") - (c == ")")
        if c == "," and not depth:
            out.append(text[at:k])
            at = k + 1
    return [*out, text[at:]]


def near(a, b):
    return (a is None) == (b is None) and (a is None or a == b or (a != a and b != b) or abs(a - b) <= 1e-9 * abs(b) + 1e-9)


def test_equals_the_plain_profile(mixed, monkeypatch):
    got = {r.column: r for r in profile.profile(mixed).collect()}
    monkeypatch.setattr(partials, "fits", lambda df: False)
    want = {r.column: r for r in profile.profile(mixed).collect()}
    assert got.keys() == want.keys()
    for c, r in got.items():
        w = want[c]
        assert {k: r[k] for k in EXACT} == {k: w[k] for k in EXACT}, c
        assert near(r.avg, w.avg) and near(r.std, w.std), c
        assert abs(r.approx_distinct - w.approx_distinct) <= 0.12 * w.approx_distinct + 1, c
        assert (r.q50 is None) == (w.q50 is None), c
        if c in ("id", "i", "d", "neg"):
            assert abs(float(r.q25) - float(w.q25)) <= 0.01 * (float(w["max"]) - float(w["min"])) + 1
        if c == "day":
            assert r.q50[:4] == w.q50[:4]


def test_merging_in_groups_and_empty_tables(spark, mixed):
    plain = partials.finished(partials.merged(partials.parts(mixed)))
    groups = partials.finished(partials.merged(partials.parts(mixed), many=True))
    cut = ["column", "min", "max", "n", "n_null", "approx_distinct"]
    assert sorted(map(tuple, plain.select(*cut).collect())) == sorted(map(tuple, groups.select(*cut).collect()))
    none = partials.summary(mixed.limit(0)).collect()
    assert [r.column for r in sorted(none, key=lambda r: r.position)] == mixed.columns and {(r.n, r["min"], r.approx_distinct, r.q50, r.avg) for r in none} == {(0, None, 0, None, None)}


def test_only_changed_members_are_scanned(spark, tmp_path):
    src, rng = str(tmp_path / "src"), random.Random(1)
    spark.range(2000).selectExpr("id", "concat('k', id % 37) as k").repartition(10).write.parquet(src)
    store = partials.MemberProfiles(spark, str(tmp_path / "store"))

    def check(scanned):
        got = {r.column: r for r in partials.MemberProfiles(spark, store.folder).summary(src).collect()}
        store.summary(src)
        rows = spark.read.parquet(src)
        w = rows.agg(F.count("*").alias("n"), F.min("id").alias("lo"), F.max("id").alias("hi"), F.avg("id").alias("m"), F.stddev_samp("id").alias("s")).first()
        r = got["id"]
        assert (r.n, r["min"], r["max"]) == (w.n, str(w.lo), str(w.hi)) and near(r.avg, w.m) and near(r.std, w.s)
        assert abs(got["k"].approx_distinct - 37) <= 2

    assert store.summary(src) is not None and store.scanned == 10
    check(0)
    assert store.scanned == 0
    files = sorted(x for x in os.listdir(src) if x.endswith(".parquet"))
    spark.range(5000, 5300).selectExpr("id", "'k1' as k").coalesce(1).write.parquet(f"{tmp_path}/new")
    made = next(x for x in os.listdir(f"{tmp_path}/new") if x.endswith(".parquet"))
    os.replace(f"{tmp_path}/new/{made}", f"{src}/{files[3]}")
    for crc in (tmp_path / "src").glob(".*.crc"):
        crc.unlink()
    again = partials.MemberProfiles(spark, store.folder)
    again.summary(src)
    assert again.scanned == 1
    check(0)
    os.remove(f"{src}/{files[rng.randrange(4, 9)]}")
    check(0)

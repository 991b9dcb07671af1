import random
from collections import Counter

import pyarrow as pa
import pytest

from vistaframe.functions.model import Filter, QuerySpec
from vistaframe.operators import heavy, panels


@pytest.mark.parametrize("most", [1, 5, 50])
@pytest.mark.parametrize("seed", range(4))
def test_counts_lie_between_the_bounds(most, seed):
    rng = random.Random(seed)
    data = [None if x > 90 else f"v{x}" for x in (int(rng.paretovariate(0.6)) % 100 for _ in range(3000))]
    c = heavy.Counters(most)
    for k in range(0, 3000, 100):
        c.add(pa.array(data[k : k + 100], pa.string()))
    c.cut()
    true = Counter(data)
    assert len(c.counts) <= most and c.rows == 3000
    assert all(c.counts.get(v, 0) <= n <= c.counts.get(v, 0) + c.taken for v, n in true.items())


def test_values_that_are_no_numbers_are_one_key():
    c = heavy.Counters(10)
    for _ in range(3):
        c.add(pa.array([float("nan"), 1.0, float("nan"), None]))
    assert sorted(c.counts.values()) == [3, 3, 6]


@pytest.mark.parametrize("counters", [2, 20, 10_000])
@pytest.mark.parametrize("col", ["text", "number", "real", "flag", "exact", "day"])
def test_equals_counting_all(spark, col, counters):
    df = spark.range(3000).selectExpr(
        "case when id % 2 = 0 then 'a' when id % 5 = 0 then null when id % 7 = 0 then '' else concat('x', id) end as text", "if(id % 3 = 0, id % 9, id) as number",
        "if(id % 4 = 0, double('nan'), id / 2) as real", "id % 3 = 0 as flag", "cast(id % 10 as decimal(10, 2)) as exact", "date_add(date'2020-01-01', cast(id % 9 as int)) as day").repartition(3)
    spec = QuerySpec((Filter("text", "in", ("a", None)),)) if col == "text" else QuerySpec()
    for limit in (1, 3, 200):
        got, want = (list(map(str, f(df, col, limit=limit, spec=spec, **x).collect())) for f, x in ((heavy.heavy_values, {"counters": counters}), (panels.top_values, {})))
        assert got == want
    assert heavy.heavy_values(df.limit(0), col).collect() == []


def test_sure_results_shuffle_few_rows(spark, monkeypatch):
    df = spark.range(50_000).selectExpr("if(id % 4 = 0, 'often', concat('once ', id)) as v")
    monkeypatch.setattr(heavy, "top_values", None)  # the way back would fail
    assert [(r.value, r.n) for r in heavy.heavy_values(df, "v", limit=1, counters=100).collect()] == [("often", 12_500)]

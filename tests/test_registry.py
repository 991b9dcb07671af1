import duckdb
import pytest

import __spark_entry__ as entry
from vistaframe.plans import registry

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def test_entry_has_rows(spark):
    assert entry.entry(spark).count() == 6


def test_names():
    assert set(registry.oracle_sql()) <= set(registry.queries())
    assert len(registry.queries()) > 75


def norm(v):
    return float(f"{v:.9g}") if isinstance(v, float) else v


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query_equals_its_sql(spark, sf_dir, name):
    df = registry.queries()[name](spark, sf_dir)
    columns = sorted(df.columns)
    got = sorted((tuple(norm(r[c]) for c in columns) for r in df.collect()), key=str)
    if name in registry.oracle_sql():
        con = duckdb.connect()
        for t in TABLES:
            con.sql(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
        want = con.sql(registry.oracle_sql()[name])
        assert sorted(want.columns) == columns
        rows = [dict(zip(want.columns, r)) for r in want.fetchall()]
        assert got == sorted((tuple(norm(r[c]) for c in columns) for r in rows), key=str)

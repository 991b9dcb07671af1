"""What a typed read of text would lose: counted, listed and kept apart, in one pass over the text."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import cast_strict, castable, is_bad
from ..functions.model import column

BATCH = 50


def parse_type(name: str) -> T.DataType:
    """A type by name; text that is no type is refused by the DDL parser."""
    fields = T.DataType.fromDDL(name)
    if isinstance(fields, T.StructType) and not name.lower().startswith("struct"):
        raise ValueError(f"{name!r} is not the name of a type.")
    return fields


def _bad(df: DataFrame, schema: T.StructType) -> list[tuple[str, Column]]:
    return [(f.name, is_bad(column(df, f.name), f.dataType)) for f in schema.fields]


def _any(bad: list[tuple[str, Column]]) -> Column:
    return reduce(lambda a, b: a | b, [b for _, b in bad], F.lit(False))


def uncastable_cells(df: DataFrame, schema: T.StructType) -> DataFrame:
    """position, column, n_rows, n_bad: cells of each column that are no values of its type."""
    wide = df.agg(F.count("*").alias("n"), *[F.count_if(b).alias(f"c{i}") for i, (_, b) in enumerate(_bad(df, schema))])
    each = [
        F.struct(F.lit(i).alias("position"), F.lit(f.name).alias("column"), F.col("n").alias("n_rows"), F.col(f"c{i}").alias("n_bad"))
        for i, f in enumerate(schema.fields)
    ]
    return wide.select(F.inline(F.array(*each)))


def bad_row_count(df: DataFrame, schema: T.StructType) -> DataFrame:
    """n_rows and n_bad_rows: rows with at least one bad cell."""
    return df.agg(F.count("*").alias("n_rows"), F.count_if(_any(_bad(df, schema))).alias("n_bad_rows"))


def bad_rows(df: DataFrame, schema: T.StructType, limit: int | None = 200) -> DataFrame:
    """Rows with a bad cell, the names of the offending columns first; in the order of all columns."""
    bad = _bad(df, schema)
    names = F.array_compact(F.array(*[F.when(b, F.lit(n)) for n, b in bad if castable(schema[n].dataType)] or [F.lit(None).cast("string")]))
    out = df.where(_any(bad)).select(names.alias("bad_columns"), *[column(df, c) for c in df.columns])
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in df.columns]).limit(limit) if limit else out


def typed(df: DataFrame, schema: T.StructType) -> list[Column]:
    return [cast_strict(column(df, f.name), f.dataType).alias(f.name) for f in schema.fields]


def good_rows(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The typed rows that survive: those without a bad cell."""
    return df.where(~_any(_bad(df, schema))).select(*typed(df, schema))


def quality_scan(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row: n_rows, n_bad_rows, n_bad_cells, and bad_columns as name -> cells, from a single aggregate."""
    bad = _bad(df, schema)
    wide = df.agg(
        F.count("*").alias("n_rows"), F.count_if(_any(bad)).alias("n_bad_rows"), *[F.count_if(b).alias(f"c{i}") for i, (_, b) in enumerate(bad)]
    )
    pairs = F.array(*[F.struct(F.lit(n).alias("column"), F.col(f"c{i}").alias("n")) for i, (n, _) in enumerate(bad)])
    cells = sum((F.col(f"c{i}") for i in range(len(bad))), F.lit(0))
    return wide.select("n_rows", "n_bad_rows", cells.cast("long").alias("n_bad_cells"), F.filter(pairs, lambda p: p["n"] > 0).alias("bad_columns"))

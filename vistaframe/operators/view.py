"""Filtered, sorted and paged views of a table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from ..functions.filters import where
from ..functions.model import QuerySpec, Sort, column

PAGE = 500


def sort_keys(df: DataFrame, sort: tuple[Sort, ...]) -> list[Column]:
    """Sort keys with NULLs last in both directions."""
    return [column(df, s.col).desc_nulls_last() if s.descending else column(df, s.col).asc_nulls_last() for s in sort]


def select(df: DataFrame, spec: QuerySpec) -> DataFrame:
    out = where(df, spec.filters)
    return out.orderBy(*sort_keys(out, spec.sort)) if spec.sort else out


def page(df: DataFrame, spec: QuerySpec, limit: int = PAGE, offset: int = 0) -> DataFrame:
    """One page of the filtered and sorted rows."""
    out = select(df, spec)
    return (out.offset(offset) if offset else out).limit(limit)


def count(df: DataFrame, spec: QuerySpec = QuerySpec()) -> DataFrame:
    """n: rows under the filters, as a frame of one row."""
    return where(df, spec.filters).agg(F.count("*").alias("n"))


def _sortable(t: T.DataType) -> bool:
    if isinstance(t, (T.MapType, T.VariantType)):
        return False
    if isinstance(t, T.ArrayType):
        return _sortable(t.elementType)
    return all(_sortable(f.dataType) for f in t.fields) if isinstance(t, T.StructType) else True


def numbered(df: DataFrame, spec: QuerySpec, store) -> DataFrame:
    """The filtered rows with row_no from 1, in the order of the sort keys and then of all other columns.

    Range partitions are sorted by themselves and written once by `store` (a function from DataFrame to the table read
    back); only their row counts meet in one place, as many numbers as there are partitions. Rows that are equal in
    every column are interchangeable, so the numbers depend on nothing else.
    """
    out = where(df, spec.filters)
    named = {s.col for s in spec.sort}
    rest = [f for f in out.schema.fields if f.name not in named]
    ties = [column(out, f.name) if _sortable(f.dataType) else F.xxhash64(F.to_json(F.struct(column(out, f.name)))) for f in rest]
    keys = [*sort_keys(out, spec.sort), *[t.asc_nulls_last() for t in ties]]
    placed = store(
        out.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__part", F.spark_partition_id()).withColumn(
            "__at", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1))
        )
    )
    sizes = placed.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return placed.join(F.broadcast(starts), "__part").select(  # a row for each partition of the sort
        (F.col("__start") + F.col("__at") + 1).alias("row_no"), *[column(placed, c) for c in out.columns]
    )


def sorted_view(df: DataFrame, spec: QuerySpec, store) -> DataFrame:
    """A table with row_no, sorted once, that pages are cut from: ties neither repeat nor vanish between pages."""
    return store(numbered(df, spec, store).sortWithinPartitions("row_no"))


def page_at(view: DataFrame, offset: int, limit: int = PAGE) -> DataFrame:
    """A page of a sorted view; row_no ranges prune the view's files."""
    return view.where(F.col("row_no").between(offset + 1, offset + limit)).orderBy("row_no")


def row_accounting(typed: DataFrame, bad: DataFrame, spec: QuerySpec, estimate: int | None = None) -> DataFrame:
    """physical, bad, visible and filtered rows; bad has n_rows and n_bad_rows, typed the rows that survive."""
    counts = where(typed, spec.filters).agg(F.count("*").alias("filtered"))
    return bad.select(
        F.col("n_rows").alias("physical"), F.col("n_bad_rows").alias("bad"),
        (F.col("n_rows") - F.col("n_bad_rows")).alias("visible"), F.lit("exact" if estimate is None else "estimated").alias("basis"),
    ).join(counts)  # two frames of one row each


__all__ = ["PAGE", "count", "numbered", "page", "page_at", "row_accounting", "select", "sorted_view"]

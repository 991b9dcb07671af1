"""Filters as predicates. NULL is a value that can be chosen: in and not_in treat it apart."""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .model import Filter, as_text, column


def contains(text: Column, value) -> Column:
    """Case-insensitive substring; % and _ in the value are wildcards, a backslash is itself."""
    return text.ilike("%" + str(value).replace("\\", "\\\\") + "%")


def _members(c: Column, values: tuple, negate: bool) -> Column:
    present = [v for v in values if v is not None]
    with_null = len(present) < len(values)
    listed = c.isin(present) if present else None
    if negate:
        if with_null:
            return c.isNotNull() if listed is None else ~listed & c.isNotNull()
        return ~listed | c.isNull()
    if with_null:
        return c.isNull() if listed is None else listed | c.isNull()
    return listed


_COMPARE = {
    "=": lambda c, v: c == v,
    "!=": lambda c, v: c != v,
    "<": lambda c, v: c < v,
    "<=": lambda c, v: c <= v,
    ">": lambda c, v: c > v,
    ">=": lambda c, v: c >= v,
}


def predicate(df: DataFrame, f: Filter) -> Column | None:
    """The predicate of one filter; None for one that takes values and has none."""
    c = column(df, f.col)
    if f.op == "is_null":
        return c.isNull()
    if f.op == "not_null":
        return c.isNotNull()
    if f.op == "is_empty":
        return as_text(c) == ""
    if not f.values:
        return None
    if f.op in _COMPARE:
        return _COMPARE[f.op](c, F.lit(f.values[0]))
    if f.op == "between":
        return c.between(F.lit(f.values[0]), F.lit(f.values[1]))
    if f.op == "contains":
        return contains(as_text(c), f.values[0])
    return _members(c, f.values, f.op == "not_in")


def where(df: DataFrame, filters: Iterable[Filter]) -> DataFrame:
    """Rows that pass all filters."""
    parts = [p for p in (predicate(df, f) for f in filters) if p is not None]
    return df.where(reduce(lambda a, b: a & b, parts)) if parts else df

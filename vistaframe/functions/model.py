"""Kinds of columns, filters, query specs and the errors that name them."""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class UnknownColumn(ValueError):
    def __init__(self, column: str) -> None:
        super().__init__(f"There is no column named {column!r}.")
        self.column = column


class UnsupportedSource(ValueError):
    pass


class SQLRejected(ValueError):
    pass


class JoinError(ValueError):
    pass


class ExportError(ValueError):
    pass


def kind_of(t: T.DataType) -> str:
    """bool, number, temporal, text, nested or blob."""
    if isinstance(t, (T.ArrayType, T.StructType, T.MapType, T.VariantType)):
        return "nested"
    if isinstance(t, T.BooleanType):
        return "bool"
    if isinstance(t, T.NumericType):
        return "number"
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType, T.DayTimeIntervalType, T.YearMonthIntervalType)):
        return "temporal"
    if isinstance(t, T.BinaryType):
        return "blob"
    return "temporal" if t.simpleString().startswith("time") else "text"


NULLARY = ("is_null", "not_null", "is_empty")
OPS = ("=", "!=", "<", "<=", ">", ">=", "between", "contains", "in", "not_in", *NULLARY)


@dataclass(frozen=True)
class Filter:
    col: str
    op: str
    values: tuple = ()

    def __post_init__(self) -> None:
        if self.op not in OPS:
            raise ValueError(f"There is no filter operator {self.op!r}.")
        if self.op == "between" and len(self.values) == 1:
            raise ValueError("between takes two values.")


@dataclass(frozen=True)
class Sort:
    col: str
    descending: bool = False


@dataclass(frozen=True)
class QuerySpec:
    filters: tuple[Filter, ...] = ()
    sort: tuple[Sort, ...] = ()

    def without_column(self, col: str) -> QuerySpec:
        """The facet rule: a panel ignores the filters on its own column and keeps all others."""
        return replace(self, filters=tuple(f for f in self.filters if f.col != col))


@dataclass(frozen=True)
class Dialect:
    delimiter: str = ","
    quote: str = '"'
    header: bool = True
    skip: int = 0
    comment: str | None = None
    escape: str = '"'


@dataclass(frozen=True)
class SourceSpec:
    path: str
    format: str
    options: dict[str, Any] = field(default_factory=dict)


def column(df: DataFrame, name: str) -> Column:
    """The column of exactly this name; anything else is an error before a plan is built."""
    if name not in df.columns:
        raise UnknownColumn(name)
    return df["`" + name.replace("`", "``") + "`"]


def field_of(df: DataFrame, name: str) -> T.StructField:
    column(df, name)
    return df.schema[name]


def as_text(c: Column) -> Column:
    return c.cast("string")

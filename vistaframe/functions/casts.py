"""Strict casts: which texts are values of a type, the same for every reader and quality count."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .model import kind_of

# The shapes of text that count as a number, a date and a timestamp.
NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
DATE = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}\s*$"
TIMESTAMP = r"^\s*[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]+)?)?)?(Z|[+-][0-9]{2}(:?[0-9]{2})?)?\s*$"
SPECIAL = r"^\s*[+-]?(nan|inf|infinity)\s*$"


def castable(t: T.DataType) -> bool:
    """Whether text can fail to be a value of the type; text, nested and binary columns never lose a cell."""
    return kind_of(t) in ("number", "bool", "temporal")


def cast_strict(c: Column, t: T.DataType) -> Column:
    """The value of a text as a type, or NULL. Decimal and exponent forms round to integers; 12d is no number."""
    if isinstance(t, T.IntegralType):
        wide = F.round(c.try_cast("decimal(38,10)"))
        value = F.coalesce(F.trim(c).try_cast(t), wide.try_cast(t))
        return F.when(c.rlike(NUMBER), value)
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return F.when(c.rlike(NUMBER) | F.lower(c).rlike(SPECIAL), c.try_cast(t))
    if isinstance(t, T.DecimalType):
        return F.when(c.rlike(NUMBER), c.try_cast(t))
    if isinstance(t, T.DateType):
        return F.when(c.rlike(DATE), c.try_cast(t))
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return F.when(c.rlike(TIMESTAMP), c.try_cast(t))
    return c.try_cast(t)


def is_bad(c: Column, t: T.DataType) -> Column:
    """A cell that the cast would lose: there, not blank, and not a value of the type."""
    if not castable(t):
        return F.lit(False)
    return c.isNotNull() & (F.trim(c) != "") & cast_strict(c, t).isNull()

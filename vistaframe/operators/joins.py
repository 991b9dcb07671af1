"""How well two tables' keys match, and merges of them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.model import JoinError, column, kind_of

HOW = ("inner", "left", "right", "full")


def check_keys(left: DataFrame, right: DataFrame, on: list[str]) -> None:
    if not on:
        raise JoinError("A join needs one key column or more.")
    if left is right:
        raise JoinError("Left and right are the same table; a join needs a second one.")
    for side, df in (("left", left), ("right", right)):
        for name in on:
            if name not in df.columns:
                raise JoinError(f"The {side} table has no column {name!r}.")


def _keys(df: DataFrame, on: list[str]) -> DataFrame:
    return df.select(*[column(df, c) for c in on]).distinct()


def join_probe(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
    """n_keys, n_matched, n_unmatched, frac over distinct left key tuples; a tuple with NULL counts and never matches."""
    check_keys(left, right, on)
    l, r = _keys(left, on), _keys(right, on).withColumn("_there", F.lit(True))
    both = l.join(r, on, "left").agg(F.count("*").alias("n_keys"), F.count("_there").alias("n_matched"))
    n, m = F.col("n_keys"), F.col("n_matched")
    return both.select(n, m, (n - m).alias("n_unmatched"), F.when(n > 0, m.cast("double") / n).otherwise(0.0).alias("frac"))


def unmatched_keys(left: DataFrame, right: DataFrame, on: list[str], limit: int = 200) -> DataFrame:
    """Distinct left key tuples without a partner, in key order."""
    check_keys(left, right, on)
    out = _keys(left, on).join(_keys(right, on), on, "left_anti")
    return out.orderBy(*[F.col(c).asc_nulls_last() for c in on]).limit(limit)


def join_candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """position, column, left_type, right_type, compatible: shared names in left order; kinds must match."""
    rows = [
        (i, f.name, f.dataType.simpleString(), right.schema[f.name].dataType.simpleString(),
         kind_of(f.dataType) == kind_of(right.schema[f.name].dataType))
        for i, f in enumerate(left.schema.fields) if f.name in right.columns
    ]
    return left.sparkSession.createDataFrame(rows, "position int, column string, left_type string, right_type string, compatible boolean")


def _free(name: str, taken: set[str]) -> str:
    i = 1
    while f"{name}_{i}" in taken:
        i += 1
    return f"{name}_{i}"


def merge(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """Left columns, then the right's others; one copy of the keys; names that clash get a number."""
    check_keys(left, right, on)
    if how not in HOW:
        raise JoinError(f"There is no join {how!r}; pick one of {', '.join(HOW)}.")
    taken, names, renamed = set(left.columns) | set(right.columns), [], []
    for c in right.columns:
        if c in on:
            renamed.append(column(right, c))
            continue
        new = _free(c, taken) if c in left.columns else c
        taken.add(new)
        names.append(new)
        renamed.append(column(right, c).alias(new))
    out = left.join(right.select(*renamed), on, how)
    return out.select(*[column(out, c) for c in [*left.columns, *names]])

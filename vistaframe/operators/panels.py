"""Value panels: top values, distinct statistics, histograms, samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.filters import contains, where
from ..functions.model import Filter, QuerySpec, as_text, column, field_of, kind_of
from .profile import wants_exact

# Labels of the two values that have no text of their own.
NULL_LABEL, EMPTY_LABEL = "␀ NULL", "␀ EMPTY"


def label_of(c: Column) -> Column:
    text = as_text(c)
    return F.when(c.isNull(), NULL_LABEL).when(text == "", EMPTY_LABEL).otherwise(text)


def faceted(df: DataFrame, spec: QuerySpec, col: str) -> DataFrame:
    """Rows under all filters but those on the panel's own column."""
    return where(df, spec.without_column(col).filters)


def selected_values(filters: tuple[Filter, ...], col: str) -> list:
    return [v for f in filters if f.col == col and f.op in ("=", "in") for v in f.values]


def top_values(df: DataFrame, col: str, limit: int = 200, spec: QuerySpec = QuerySpec(), search: str | None = None) -> DataFrame:
    """label, value, n, frac and selected of the most frequent values; frac is of all rows that the panel sees."""
    column(df, col)
    rows = faceted(df, spec, col)
    if search:
        rows = rows.where(contains(as_text(column(rows, col)), search))
    counts = rows.groupBy(column(rows, col).alias("value")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))  # one number from the same shuffle; a window would take all values to one task
    out = labelled(counts.join(F.broadcast(total)), F.col("total"), col, spec)  # one row
    return out.orderBy(F.col("n").desc(), "label").limit(limit)


def labelled(counts: DataFrame, total, col: str, spec: QuerySpec) -> DataFrame:
    """label, value, n, frac and selected, from value and n."""
    chosen, v = selected_values(spec.filters, col), F.col("value")
    present = [x for x in chosen if x is not None]
    flag = v.isin(present) if present else F.lit(False)
    flag = F.coalesce(flag, F.lit(False)) | (v.isNull() if None in chosen else F.lit(False))
    return counts.select(label_of(v).alias("label"), v, "n", (F.col("n").cast("double") / (total if isinstance(total, Column) else F.lit(total))).alias("frac"), flag.alias("selected"))


def distinct_stats(df: DataFrame, col: str, spec: QuerySpec = QuerySpec(), exact: bool | None = False, shown: DataFrame | None = None) -> DataFrame:
    """n_rows, n_nonnull, n_distinct_approx, n_distinct_exact (if exact), other_n (rows that `shown` leaves out).

    exact=None counts exactly where the sketch says that the values are few.
    """
    rows = faceted(df, spec, col)
    c = column(rows, col)
    aggs = [F.count("*").alias("n_rows"), F.count(c).alias("n_nonnull"), F.approx_count_distinct(c).alias("n_distinct_approx")]
    out = rows.agg(*aggs).withColumn("n_distinct_approx", F.least("n_distinct_approx", "n_nonnull"))
    if exact is None:
        exact = wants_exact(out.first().n_distinct_approx)
    if exact:
        values = rows.where(c.isNotNull()).select(c.alias("v")).distinct()
        out = out.join(F.broadcast(values.agg(F.count("*").alias("n_distinct_exact"))))  # one row
    if shown is not None:
        out = out.join(F.broadcast(shown.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("s"))))  # one row
        out = out.withColumn("other_n", F.col("n_rows") - F.col("s")).drop("s")
    return out


def _position(df: DataFrame, col: str) -> Column:
    f, c = field_of(df, col), column(df, col)
    if kind_of(f.dataType) != "temporal":
        return c.cast("double")
    return F.unix_millis(c.cast("timestamp")).cast("double")


def bounds(df: DataFrame, col: str) -> tuple[float | None, float | None, int]:
    """(lowest, highest, NULLs) of a column as numbers, from unfiltered rows: three numbers come to the driver."""
    p = _position(df, col)
    r = df.agg(F.min(p), F.max(p), F.count_if(column(df, col).isNull())).first()
    return r[0], r[1], r[2]


def histogram_plan(low: float | None, high: float | None, bins: int) -> tuple[float, float, int] | str:
    """(lowest, width, bins), or the reason why there is no histogram."""
    if low is None or high is None:
        return "no values"
    if not high > low:
        return "one value"
    bins = max(1, bins)
    return low, (high - low) / bins, bins


def histogram(df: DataFrame, col: str, bins: int = 40, spec: QuerySpec = QuerySpec(), limits: tuple | None = None) -> DataFrame:
    """b, n, b_min, b_max of the bins with rows. Bounds are those of the unfiltered column, counts those of the facet."""
    low, high, _ = limits or bounds(df, col)
    plan = histogram_plan(low, high, bins)
    rows = faceted(df, spec, col)
    c = column(rows, col)
    if isinstance(plan, str):
        return rows.where(F.lit(False)).select(F.lit(0).alias("b"), F.lit(0).cast("long").alias("n"), c.alias("b_min"), c.alias("b_max"))
    lo, step, bins = plan
    at = F.floor((_position(rows, col) - F.lit(lo)) / F.lit(step)).cast("int")
    b = F.least(F.lit(bins - 1), F.greatest(F.lit(0), at))
    return rows.where(c.isNotNull()).groupBy(b.alias("b")).agg(F.count("*").alias("n"), F.min(c).alias("b_min"), F.max(c).alias("b_max")).orderBy("b")


def histogram_state(df: DataFrame, col: str, bins: int = 40) -> DataFrame:
    """One row: degenerate, reason, n_null, and the bounds."""
    low, high, n_null = bounds(df, col)
    plan = histogram_plan(low, high, bins)
    reason = plan if isinstance(plan, str) else None
    return df.sparkSession.createDataFrame(
        [(reason is not None, reason, n_null, low, high)], "degenerate boolean, reason string, n_null long, low double, high double"
    )


def dense_histogram(df: DataFrame, col: str, bins: int = 40, spec: QuerySpec = QuerySpec()) -> DataFrame:
    """One row for each bin, in order, zero where it is empty, and n_null of the facet beside it."""
    limits = bounds(df, col)
    plan = histogram_plan(limits[0], limits[1], bins)
    n = 0 if isinstance(plan, str) else plan[2]
    counts = histogram(df, col, bins, spec, limits)
    rows = faceted(df, spec, col)
    nulls = rows.agg(F.count_if(column(rows, col).isNull()).alias("n_null"))
    every = df.sparkSession.range(n).select(F.col("id").cast("int").alias("b"))
    return every.join(counts, "b", "left").join(F.broadcast(nulls)).select("b", F.coalesce("n", F.lit(0)).alias("n"), "b_min", "b_max", "n_null").orderBy("b")


def length_histogram(df: DataFrame, col: str, bins: int = 24, spec: QuerySpec = QuerySpec()) -> DataFrame:
    """len, n: rows by text length, shortest first, without NULL."""
    rows = faceted(df, spec, col)
    length = F.char_length(as_text(column(rows, col))).cast("long")
    return rows.where(column(rows, col).isNotNull()).groupBy(length.alias("len")).agg(F.count("*").alias("n")).orderBy("len").limit(bins)


def sample_values(df: DataFrame, col: str, n: int = 20, seed: int | None = None, spec: QuerySpec = QuerySpec()) -> DataFrame:
    """n random values as text; an unknown column gives an empty result."""
    if col not in df.columns:
        return df.sparkSession.createDataFrame([], "value string")
    rows = faceted(df, spec, col)
    return rows.select(as_text(column(rows, col)).alias("value"), F.rand(seed).alias("_r")).orderBy("_r").limit(n).drop("_r")


def key_ratio(df: DataFrame, col: str, spec: QuerySpec = QuerySpec()) -> DataFrame:
    """n_rows, n_distinct, ratio: 1.0 for a key."""
    s = distinct_stats(df, col, spec, exact=True)
    ratio = F.when(F.col("n_rows") > 0, F.col("n_distinct_exact").cast("double") / F.col("n_rows")).otherwise(0.0)
    return s.select("n_rows", F.col("n_distinct_exact").alias("n_distinct"), ratio.alias("ratio"))

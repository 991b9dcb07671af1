"""Column profiles: one wide aggregate a batch of columns, then a row a column."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import is_bad
from ..functions.model import as_text, column, kind_of
from ..sources.shared import stored
from . import partials
from .partials import NULLISH

BATCH = 50
EXACT_DISTINCT_MAX = 100_000
SUMMARY = ("position", "column", "type", "min", "max", "avg", "std", "approx_distinct", "q25", "q50", "q75", "n", "null_pct")
HISTOGRAM_ABOVE = 50
SERIAL_LOW, SERIAL_HIGH = 25_000, 50_000


def _batched(df: DataFrame, of_column) -> DataFrame:
    """Rows of of_column(i, field) -> (aggregates, results by name), some columns an aggregate at a time."""
    parts, fields = [], list(enumerate(df.schema.fields))
    for at in range(0, len(fields), BATCH):
        made = [of_column(i, f) for i, f in fields[at : at + BATCH]]
        wide = df.agg(F.count("*").alias("n"), *[a for aggs, _ in made for a in aggs])
        parts.append(wide.select(F.inline(F.array(*[F.struct(*[v.alias(k) for k, v in found.items()]) for _, found in made]))))
    return reduce(DataFrame.unionByName, parts)


def _orderable(t: T.DataType) -> bool:
    return kind_of(t) in ("bool", "number", "temporal", "text")


def _none(kind: str) -> Column:
    return F.lit(None).cast(kind)


def summarize(df: DataFrame, sketches: bool = True) -> DataFrame:
    """A row a column: type, min, max, approx_distinct, avg, std, quartiles (as text), n, null_pct.

    Average and deviation are of numbers, quartiles of numbers and times. sketches=False leaves approximate fields out.
    With them, tasks sum up Arrow batches column by column (operators.partials): an aggregate of so many buffers is slower.
    """
    if sketches and partials.fits(df):
        return partials.summary(df).select(*SUMMARY)
    return _batched(df, _summary(df, sketches))


def _summary(df: DataFrame, sketches: bool):

    def of(i: int, f: T.StructField):
        c, kind = column(df, f.name), kind_of(f.dataType)
        aggs = [F.count(c).alias(f"c{i}_n")]
        fields = {"position": F.lit(i), "column": F.lit(f.name), "type": F.lit(f.dataType.simpleString())}
        if _orderable(f.dataType):
            aggs += [F.min(c).alias(f"c{i}_lo"), F.max(c).alias(f"c{i}_hi")]
        fields |= {k: as_text(F.col(f"c{i}_{s}")) if _orderable(f.dataType) else _none("string") for k, s in (("min", "lo"), ("max", "hi"))}
        if kind == "number":
            aggs += [F.avg(c.cast("double")).alias(f"c{i}_avg"), F.stddev_samp(c.cast("double")).alias(f"c{i}_std")]
        fields |= {k: F.col(f"c{i}_{k}") if kind == "number" else _none("double") for k in ("avg", "std")}
        if sketches:
            aggs.append((F.approx_count_distinct(c if kind != "nested" else F.to_json(F.struct(c)))).alias(f"c{i}_d"))
            fields["approx_distinct"] = F.col(f"c{i}_d")
            points = kind == "number" or (kind == "temporal" and isinstance(f.dataType, (T.DateType, T.TimestampType, T.TimestampNTZType)))
            if points:
                aggs.append(F.percentile_approx(c, [0.25, 0.5, 0.75], 1000).alias(f"c{i}_q"))
            fields |= {k: as_text(F.get(F.col(f"c{i}_q"), F.lit(j))) if points else _none("string") for j, k in enumerate(("q25", "q50", "q75"))}
        fields |= {"n": F.col("n"), "null_pct": F.when(F.col("n") > 0, 100.0 * (F.col("n") - F.col(f"c{i}_n")) / F.col("n"))}
        return aggs, fields

    return of


def missing_counts(df: DataFrame) -> DataFrame:
    """A row a column: NULL, empty and look-alike cells, kept apart, and the longest text."""
    return _batched(df, _missing(df))


def _missing(df: DataFrame):

    def of(i: int, f: T.StructField):
        c = column(df, f.name)
        text = as_text(c) if kind_of(f.dataType) not in ("nested", "blob") else F.when(c.isNotNull(), F.lit("x"))
        aggs = [
            F.count_if(c.isNull()).alias(f"c{i}_null"),
            F.count_if(text == "").alias(f"c{i}_empty"),
            F.count_if((text != "") & F.lower(F.trim(text)).isin(*NULLISH)).alias(f"c{i}_nullish"),
            F.max(F.char_length(text)).cast("long").alias(f"c{i}_len"),
        ]
        names = (("n_null", "null"), ("n_empty", "empty"), ("n_nullish", "nullish"), ("max_len", "len"))
        return aggs, {"position": F.lit(i), "column": F.lit(f.name), "n": F.col("n")} | {k: F.col(f"c{i}_{s}") for k, s in names}

    return of


def clamp_distinct(approx: Column, n: Column) -> Column:
    """A sketch may overshoot the number of rows; a count of values may not."""
    return F.greatest(F.lit(0), F.when(n <= 0, approx).otherwise(F.least(approx, n)))


def suggested_view(kind: Column, distinct: Column, n: Column) -> Column:
    """hist, topn or highcard."""
    spread = kind.isin("number", "temporal")
    unlike = (kind == "text") & (n > 0) & (distinct > F.greatest(F.lit(1000.0), 0.9 * n))
    return (
        F.when(spread & (distinct > HISTOGRAM_ABOVE), "hist").when(unlike, "highcard").otherwise("topn")
    )


def missing_fraction(n_null: Column, n_empty: Column, n_uncastable: Column, n: Column) -> Column:
    share = (n_null + n_empty + n_uncastable) / n
    return F.when(n > 0, F.greatest(F.lit(0.0), F.least(F.lit(1.0), share))).otherwise(F.lit(0.0))


def kinds(df: DataFrame) -> Column:
    """A map from column position to kind, as a literal."""
    return F.array(*[F.lit(kind_of(f.dataType)) for f in df.schema.fields])


def profile(df: DataFrame, uncastable: DataFrame | T.StructType | None = None, sketches: bool = True, distinct: DataFrame | None = None, exact_few: bool = False, exact_many: bool = False) -> DataFrame:
    """A row a column: summary, missing counts and uncastable cells, with a suggested view, from one scan.

    exact_few counts the distinct values exactly where the sketch says that they are few, by a second scan of these columns;
    exact_many also where they are many, by another scan of those, which shuffles their values.

    uncastable is the schema that the cells should have, or counts that are at hand (position, n_bad). distinct (position,
    n_distinct) takes the place of the sketch where an exact count is at hand.
    """
    summary, missing = _summary(df, sketches), _missing(df)
    wanted = {f.name: f.dataType for f in uncastable.fields} if isinstance(uncastable, T.StructType) else {}

    def of(i: int, f: T.StructField):
        (a, first), (b, second) = summary(i, f), missing(i, f)
        bad = [F.count_if(is_bad(column(df, f.name), wanted[f.name])).alias(f"c{i}_bad")] if f.name in wanted else []
        return a + b + bad, first | second | {"n_uncastable": F.col(f"c{i}_bad") if bad else F.lit(0).cast("long")}

    by_parts = sketches and not wanted and partials.fits(df)
    out = (partials.summary(df).withColumn("n_uncastable", F.lit(0).cast("long")) if by_parts else _batched(df, of)).withColumn("kind", F.get(kinds(df), F.col("position")))
    if isinstance(uncastable, DataFrame):
        out = out.drop("n_uncastable").join(uncastable.select("position", F.col("n_bad").alias("n_uncastable")), "position", "left")  # a row a column
    if distinct is not None:
        out = out.drop("approx_distinct").join(distinct.select("position", F.col("n_distinct").alias("approx_distinct")), "position", "left")
    elif sketches and (exact_few or exact_many):
        out = stored(out, "profile")
        by_size: dict[bool, list[int]] = {True: [], False: []}
        for r in out.select("position", "approx_distinct").collect():  # a number a column
            by_size[wants_exact(r.approx_distinct or 0)].append(r.position)
        chosen = [by_size[few] for few, on in ((True, exact_few), (False, exact_many)) if on]
        counted = reduce(DataFrame.unionByName, [distinct_exact(df, some) for some in chosen]).select("position", "n_distinct")
        out = out.join(counted, "position", "left").withColumn("approx_distinct", F.coalesce("n_distinct", "approx_distinct")).drop("n_distinct")
    elif not sketches:
        out = out.withColumn("approx_distinct", F.lit(0).cast("long"))
    by_share = F.bround(F.col("null_pct") / 100.0 * F.col("n")).cast("long")
    return (
        out.withColumn("n_null", F.when(F.col("n_null") == 0, F.coalesce(by_share, F.lit(0))).otherwise(F.col("n_null")))
        .withColumn("n_uncastable", F.coalesce("n_uncastable", F.lit(0)))
        .withColumn("max_len", F.when(F.col("max_len") != 0, F.col("max_len")))
        .withColumn("approx_distinct", clamp_distinct(F.col("approx_distinct"), F.col("n")))
        .withColumn("missing_fraction", missing_fraction(F.col("n_null"), F.col("n_empty"), F.col("n_uncastable"), F.col("n")))
        .withColumn("view", suggested_view(F.col("kind"), F.col("approx_distinct"), F.col("n")))
    )


def distinct_exact(df: DataFrame, only: list[int] | None = None) -> DataFrame:
    """position, column, n_distinct of all columns or of those in `only`: melted to (position, value hash), so many columns make one plain two-step aggregate.

    Values are told apart by two 64-bit hashes of their text, so a row costs as much for long values as for short ones.
    """
    fields = [(i, f) for i, f in enumerate(df.schema.fields) if only is None or i in only]
    if not fields:
        return df.sparkSession.createDataFrame([], "position int, column string, n_distinct long")
    cells = F.array(*[
        F.struct(F.lit(i).alias("position"), F.xxhash64(as_text(column(df, f.name))).alias("a"), F.xxhash64(F.lit(7), as_text(column(df, f.name))).alias("b"),
                 column(df, f.name).isNotNull().alias("there"))
        for i, f in fields
    ])
    values = df.select(F.inline(cells)).where("there").groupBy("position", "a", "b").agg(F.count("*"))
    counts = values.groupBy("position").agg(F.count("*").alias("n_distinct"))
    every = df.sparkSession.createDataFrame([(i, f.name) for i, f in fields], "position int, column string")
    return every.join(counts, "position", "left").select("position", "column", F.coalesce("n_distinct", F.lit(0)).alias("n_distinct"))


def wants_exact(approx: int) -> bool:
    return approx < EXACT_DISTINCT_MAX


def looks_like_serial_dates(kind: Column, low: Column, high: Column, distinct: Column) -> Column:
    """Numbers that are probably dates which lost their format."""
    return (kind == "number") & (low >= SERIAL_LOW) & (high <= SERIAL_HIGH) & (distinct > 1)


def from_serial(days: Column) -> Column:
    """The date of a serial day number."""
    return F.date_add(F.lit("1899-12-30").cast("date"), F.floor(days).cast("int"))


def serial_dates(df: DataFrame) -> DataFrame:
    """A row a column: whether its numbers look like serial dates, and the first and last date they would be."""

    def of(i: int, f: T.StructField):
        c, number = column(df, f.name), kind_of(f.dataType) == "number"
        v = c.cast("double") if number else _none("double")
        aggs = [F.min(v).alias(f"c{i}_lo"), F.max(v).alias(f"c{i}_hi")]
        lo, hi = F.col(f"c{i}_lo"), F.col(f"c{i}_hi")
        # more than one value there are exactly when the smallest is not the largest
        looks = F.coalesce(F.lit(number) & (lo >= SERIAL_LOW) & (hi <= SERIAL_HIGH) & (lo < hi), F.lit(False))
        return aggs, {
            "position": F.lit(i), "column": F.lit(f.name), "looks_like_dates": looks,
            "first": F.when(looks, from_serial(lo)), "last": F.when(looks, from_serial(hi)),
        }

    return _batched(df, of)

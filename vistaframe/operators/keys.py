"""Which columns of two tables are keys of each other, from one scan of each table.

Every column gets a theta sketch of its distinct values: the values whose hashes are below a threshold that falls as values
come. Two sketches cut at one threshold hold the same sample of both columns, so what share of the left one's sample is in
the right one's estimates containment. Sketches merge in any order; a table's are merged by groups of tasks first and then
column by column, so no task sees all of them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.model import column, kind_of
from ..sources.shared import stored
from .joins import join_probe

#: A sketch keeps about 2^LG values, 8 bytes each.
LG = 12
#: Groups of tasks whose sketches are merged first.
GROUPS = 256
#: Sketches of one table that are sent to every task.
SENT_BYTES = 64 << 20
KEYS = ("number", "temporal", "text")


def canonical(c: Column, t: T.DataType) -> Column:
    """A value as text or a whole number, the same for equal values of one kind; None for types that are no keys."""
    kind = kind_of(t)
    if kind == "number":
        if isinstance(t, T.IntegralType):
            return c.cast("long")
        whole = c.try_cast("long")
        return F.when(c == whole, whole).when(c.isNotNull(), F.xxhash64(c.cast("double")))
    if isinstance(t, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(c.cast("timestamp"))
    return c.cast("string") if isinstance(t, (T.StringType, T.CharType, T.VarcharType)) else None


def column_sketches(df: DataFrame, lg: int = LG) -> DataFrame:
    """position, column, kind, n (rows that are not NULL) and sketch of every column that can be a key."""
    able = [(i, f.name, kind_of(f.dataType), v) for i, f in enumerate(df.schema.fields) if (v := canonical(column(df, f.name), f.dataType)) is not None]
    if not able:
        return df.sparkSession.createDataFrame([], "position int, column string, kind string, n long, sketch binary")
    rows = df.select(*[v.alias(f"v{i}") for i, _, _, v in able], (F.spark_partition_id() % GROUPS).alias("g"))
    sums = [x for i, *_ in able for x in (F.count(f"v{i}").alias(f"n{i}"), F.theta_sketch_agg(f"v{i}", lg).alias(f"s{i}"))]
    fields = [
        F.struct(F.lit(i).alias("position"), F.lit(name).alias("column"), F.lit(kind).alias("kind"), F.col(f"n{i}").alias("n"), F.col(f"s{i}").alias("sketch"))
        for i, name, kind, _ in able
    ]
    parts = rows.groupBy("g").agg(*sums).select(F.inline(F.array(*fields)))
    return parts.groupBy("position", "column", "kind").agg(F.sum("n").alias("n"), F.theta_union_agg("sketch", lg).alias("sketch"))


def _size(sketch: Column) -> Column:
    return F.coalesce(F.theta_sketch_estimate(sketch), F.lit(0)).cast("double")


def containment(left: DataFrame, right: DataFrame, lg: int = LG) -> DataFrame:
    """Every pair of columns of one kind, from their sketches: distinct values, contained (of the left one's values, the share
    that the right one has) with its error, covered (of the right one's, the share that the left one has), and uniqueness
    (of the right one's rows, the share that are distinct values).

    `error` is twice the standard error of a share of as many sampled values as both thresholds leave. NULL is no value;
    a column without values is contained nowhere.
    """
    l, r = (column_sketches(df, lg).select(*[F.col(c).alias(f"{side}_{c}") for c in ("position", "column", "kind", "n", "sketch")]) for side, df in (("l", left), ("r", right)))
    if len(right.columns) * (16 << lg) <= SENT_BYTES:
        r = F.broadcast(r)
    both = l.join(r, F.col("l_kind") == F.col("r_kind")).select(
        "*", _size(F.col("l_sketch")).alias("nl"), _size(F.col("r_sketch")).alias("nr"),
        _size(F.theta_intersection("l_sketch", "r_sketch")).alias("shared"),
        # differences and intersections are cut at the same threshold, the lower one, so their shares hold no other noise
        _size(F.theta_difference("l_sketch", "r_sketch")).alias("left_only"), _size(F.theta_difference("r_sketch", "l_sketch")).alias("right_only"),
    )
    share = lambda of: F.when(F.col("shared") + F.col(of) > 0, F.col("shared") / (F.col("shared") + F.col(of))).otherwise(0.0)
    k = float(1 << lg)
    kept = F.col("nl") * F.least(F.lit(1.0), k / F.greatest(F.col("nl"), F.lit(1.0)), k / F.greatest(F.col("nr"), F.lit(1.0)))
    # two successes and two failures are added, so that shares of 0 and 1 have an error too
    likely = (F.col("contained") * F.col("kept") + 2) / (F.col("kept") + 4)
    exact = (F.col("nl") < k) & (F.col("nr") < k)  # no hash was cut off: the sketches hold all values
    return (
        both.withColumns({"contained": share("left_only"), "covered": share("right_only"), "kept": kept})
        .withColumn("error", F.when(exact, 0.0).otherwise(2 * F.sqrt(likely * (1 - likely) / (F.col("kept") + 4))))
        .select(
            F.col("l_position").alias("left_position"), F.col("l_column").alias("left_column"), F.col("r_position").alias("right_position"), F.col("r_column").alias("right_column"),
            F.col("l_kind").alias("kind"), F.col("nl").cast("long").alias("n_left"), F.col("nr").cast("long").alias("n_right"), "contained", "error", "covered",
            F.when(F.col("r_n") > 0, F.least(F.lit(1.0), F.col("nr") / F.col("r_n"))).otherwise(0.0).alias("uniqueness"),
        )
    )


def key_pairs(left: DataFrame, right: DataFrame, most: int = 20, probe: int = 3, lg: int = LG) -> DataFrame:
    """The likeliest keys from left to right, best first: rank, the columns of `containment`, and for the first `probe` n_keys
    and frac of `join_probe` without NULL keys, which are exact.

    A key's values lie in a column whose values are (nearly) unique and cover much of it, so small numbers such as positions
    of lines, which lie in every range of keys, come behind; then pairs of one name, then by position.
    """
    sound = F.round(F.col("contained") * F.col("uniqueness"), 1)
    by = [sound.desc(), F.round("covered", 1).desc(), F.col("same").desc(), F.col("contained").desc(), F.col("left_position"), F.col("right_position")]
    pairs = containment(left, right, lg).where("contained > 0").withColumn("same", F.lower("left_column") == F.lower("right_column"))
    best = stored(pairs.orderBy(*by).limit(most), "keys")
    ranked = best.withColumn("rank", F.row_number().over(Window.orderBy(*by))).drop("same", "left_position", "right_position")  # at most `most` rows
    first = ranked.where(F.col("rank") <= probe).select("rank", "left_column", "right_column").collect()
    probes = [
        join_probe(*[df.select(column(df, c).alias("key")).where("key IS NOT NULL") for df, c in ((left, p.left_column), (right, p.right_column))], ["key"])
        .select(F.lit(p.rank).alias("rank"), "n_keys", "frac")
        for p in first
    ]
    exact = reduce(DataFrame.unionByName, probes) if probes else left.sparkSession.createDataFrame([], "rank int, n_keys long, frac double")
    columns = ("rank", *[c for c in ranked.columns if c != "rank"], "n_keys", "frac")
    return ranked.join(exact, "rank", "left").select(*columns).orderBy("rank")

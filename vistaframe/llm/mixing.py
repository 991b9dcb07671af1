"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every document waits in the queue of its source, in a shuffled order that depends on the row alone. A queue may be
passed twice, so that a source can give up to two times its words. A document's virtual finish time in a pass is the
words of its source up to and including it, divided by the source's target. All passes of all documents are then
sorted by finish time over range buckets, and the order is cut where the words reach the total budget.

A source's running sum is taken in two steps: in each of ORDER_BUCKETS pieces of its shuffled order, and over the sums
of the pieces. So a source with a third of all rows is spread over as many tasks as it needs; rows that are equal, such as
those without id, are counted first and dealt in portions of PORTION. The cut is found the same way, from sums of finish-time buckets, so that no task ever sees more than a small slice of the order.

Defined results: a null text or one without words has size 0 and takes nothing; a null source is a source of its own,
after all others; repeated rows queue as rows of their own; an empty table gives an empty result. Columns of the input
with clashing names do not matter: only id, text and source are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import WORD, documents, dropped, stored

WEIGHTS = (5, 2, 1)
SHARE = 1.5
PASSES = 2
ORDER_BUCKETS = 1024
#: Equal rows that stand together in the queue.
PORTION = 1000
TIME_BUCKETS = 1024
#: Columns by which mix() tells rows apart.
KEY = ("__mix_id", "__mix_source", "__mix_text", "__mix_rest")


def source_targets(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: float = PASSES) -> DataFrame:
    """Per source: rank, source_size, target. sizes has (source, size).

    Targets fill up like connected vessels: with caps of `most` times a source's size, the level at which all targets
    sum to the budget is found from prefix sums in the order in which sources reach their caps.
    """
    by_source = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = Window.partitionBy()
    ranked = by_source.withColumn(
        "rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    ).withColumn("weight", F.element_at(F.array(*[F.lit(float(w)) for w in weights]), F.col("rank") % len(weights) + 1))
    full = Window.orderBy("fills_at", "rank")
    level = (F.lit(share) * F.col("all_size") - F.col("capped_before")) / F.col("weight_from")
    return (
        ranked.withColumn("cap", F.col("source_size") * F.lit(float(most)))
        .withColumn("fills_at", F.col("cap") / F.col("weight"))
        .withColumn("all_size", F.sum("source_size").over(everything))
        .withColumn("capped_before", F.coalesce(F.sum("cap").over(full.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
        .withColumn("weight_from", F.sum("weight").over(full.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("level", F.max(F.when(level <= F.col("fills_at"), level)).over(everything))
        .withColumn("target", F.least(F.col("cap"), F.col("weight") * F.coalesce("level", F.lit(0.0))))
        .select("source", "rank", "source_size", "target")
    )


def queue_times(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """Per row of docs (doc_id, source, size, and any more): rank, source_size, target, before: source words ahead of it."""
    names = docs.columns
    equal = docs.groupBy(*names).agg(F.count("*").alias("_copies"))
    portions = equal.withColumn("_no", F.explode(F.sequence(F.lit(0), F.floor((F.col("_copies") - 1) / PORTION).cast("int"))))
    portions = portions.withColumn("_rows", F.least(F.lit(PORTION), F.col("_copies") - F.col("_no") * PORTION).cast("int"))
    h = F.xxhash64(F.lit(seed), *[F.coalesce(F.col(c).cast("string"), F.lit("null")) for c in names], "_no")
    shuffled = portions.withColumn("_h", h).withColumn("_piece", F.pmod(F.col("_h"), F.lit(ORDER_BUCKETS)))
    words = F.col("size") * F.col("_rows")
    pieces = shuffled.groupBy("source", "_piece").agg(F.sum(words).alias("_sum"))
    ahead = Window.partitionBy("source").orderBy("_piece").rowsBetween(Window.unboundedPreceding, -1)
    offsets = pieces.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).join(
        source_targets(pieces.select("source", F.col("_sum").alias("size")), weights, share)
        .withColumnRenamed("source", "_source"),
        F.col("source").eqNullSafe(F.col("_source")),
    ).select(F.col("_source"), F.col("_piece").alias("_of"), "_ahead", "rank", "source_size", "target")
    within = Window.partitionBy("source", "_piece").orderBy("_h", *names, "_no").rowsBetween(Window.unboundedPreceding, -1)
    return (
        shuffled.withColumn("_within", F.coalesce(F.sum(words).over(within), F.lit(0)))
        .join(offsets, F.col("source").eqNullSafe(F.col("_source")) & (F.col("_piece") == F.col("_of")))
        .withColumn("_row", F.explode(F.sequence(F.lit(0), F.col("_rows") - 1)))
        .withColumn("before", F.col("_ahead") + F.col("_within") + F.col("_row") * F.col("size"))
        .select(*names, "rank", "source_size", "target", "before")
    )


def _finish(pass_no: int):
    return (F.col("before") + F.lit(pass_no) * F.col("source_size") + F.col("size")) / F.col("target")


def _waits(times: DataFrame) -> DataFrame:
    """A row for each pass of each document that starts before its source has reached its target: finish, rank, size."""
    each = [F.struct(F.lit(p).alias("pass"), _finish(p).alias("finish")) for p in range(PASSES)]
    starts = F.col("finish") - F.col("size") / F.col("target")
    return (
        times.where("size > 0 and target > 0")
        .select("rank", "size", "target", F.explode(F.array(*each)).alias("_p"))
        .select("rank", "size", "target", "_p.finish")
        .where(starts < 1 - 1e-12)
    )


def cut(times: DataFrame, share: float = SHARE) -> tuple[float, int]:
    """The last (finish time, source rank) within the budget, from two levels of bucket sums and one small slice."""
    waits = _waits(times)
    found = times.select("rank", "source_size").distinct().agg(F.sum("source_size")).first()[0]
    budget, low, width, spent = share * float(found or 0), 0.0, 1.0 / TIME_BUCKETS, 0
    last = int(1.0 / width)
    inside = waits
    for _ in range(2):  # at most TIME_BUCKETS + 1 sums come to the driver each time
        bucket = F.least(F.floor((F.col("finish") - F.lit(low)) / F.lit(width)), F.lit(last)).cast("long")
        sums = inside.groupBy(bucket.alias("b")).agg(F.sum("size").alias("n")).collect()
        at = None
        for b, n in sorted(tuple(x) for x in sums):
            if spent + n > budget:
                at = b
                break
            spent += n
        if at is None:
            return float("inf"), 0
        inside = inside.where(bucket == at)
        low += at * width
        width /= TIME_BUCKETS
        last = TIME_BUCKETS
    order = Window.orderBy("finish", "rank").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    row = (
        inside.withColumn("_run", F.sum("size").over(order) + F.lit(spent))
        .where(F.col("_run") <= budget)
        .agg(F.max(F.struct("finish", "rank")).alias("m"))
        .first()
    )
    return (row.m.finish, row.m["rank"]) if row.m else (low, -1)


def passes(times: DataFrame, share: float = SHARE) -> DataFrame:
    """times with first_at, second_at (virtual finish times, null for passes the mix does not take) and passes."""
    finish, rank = cut(times, share)
    out, names = times, ("first_at", "second_at")
    for p, name in enumerate(names):
        f = _finish(p)
        starts = f - F.col("size") / F.col("target")
        inside = (f < finish) | ((f == finish) & (F.col("rank") <= rank))
        out = out.withColumn(
            name, F.when((F.col("size") > 0) & (F.col("target") > 0), F.when((starts < 1 - 1e-12) & inside, f))
        )
    return out.withColumn("passes", sum(F.col(n).isNotNull().cast("int") for n in names))


def sized(docs: DataFrame) -> DataFrame:
    return docs.withColumn("size", F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long"))


def mix(docs: DataFrame, seed: int = 0, weights=WEIGHTS, share: float = SHARE) -> DataFrame:
    """The mixed documents in mixing order: the columns of docs, a row as often as the mix takes it.

    Only ids and sizes go through the queues; the texts join the passes at the end by id, source, text hash
    and a hash of all other columns.
    """
    names, key = docs.columns, list(KEY)
    rest = F.struct(*[F.col(f"`{c}`") for c in names if c not in ("doc_id", "source", "text")], F.lit(0).alias("__mix_none"))
    keyed = docs.withColumns({
        key[0]: F.coalesce(F.col("doc_id").cast("string"), F.lit("null")),
        key[1]: F.coalesce(F.concat(F.lit("s"), F.col("source")), F.lit("null")),
        key[2]: F.xxhash64(F.coalesce("text", F.lit("")), F.col("text").isNull()),
        key[3]: F.xxhash64(F.to_json(rest, {"ignoreNullFields": "false"})),
    })
    small = stored(sized(keyed).select("doc_id", "source", "size", *key), "mix-sizes")
    times = stored(queue_times(small, seed, weights, share), "mix-times")
    plan = passes(times, share).where("passes > 0").select(*key, F.explode(F.array_compact(F.array("first_at", "second_at"))).alias("__mix_at"))
    out = keyed.dropDuplicates(key).join(plan, key)
    return out.repartitionByRange("__mix_at", *key).sortWithinPartitions("__mix_at", *key).select(*names)


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken, first_at, second_at for every document."""
    docs = documents(spark, sf_dir)
    small = stored(sized(docs).select("doc_id", "source", "size"), "mix-sizes")
    times = stored(queue_times(small), "mix-times")
    dropped(small)
    return passes(times).select(
        "doc_id", "size", "source_size", "target",
        (F.col("size") * F.col("passes")).alias("taken"), "first_at", "second_at",
    )


QUERIES = {"op5_mixing": op5_mixing}
ORACLE_SQL: dict = {}

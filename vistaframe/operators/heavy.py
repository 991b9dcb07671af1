"""Most frequent values in two passes, for columns with so many values that counting all of them would move the table.

Pass one: every task keeps a bounded number of counters. When there are more values, the count of the first one beyond the
bound is taken from all and what falls to 0 goes; what was taken is added up. A value's true count lies between the sum of
its counters and that plus all that was taken, and a value without a counter has at most as much as was taken.

So if the last value wanted has more than was taken, all that can be among the wanted have counters: pass two counts these
alone. If nothing was taken, the counters are the counts. If the bound does not tell, all values are counted.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..functions.model import QuerySpec, column, field_of
from ..sources.shared import stored
from .panels import faceted, labelled, top_values

COUNTERS = 10_000
#: Candidates of pass two that are sent to every task.
SENT = 100_000


class Counters:
    """Counts of at most so many values, and what was taken from each of them."""

    def __init__(self, most: int) -> None:
        self.most, self.counts, self.taken, self.rows = most, {}, 0, 0

    def add(self, values: pa.Array) -> None:
        self.rows += len(values)
        found = pc.value_counts(values)
        for v, n in zip(found.field("values").to_pylist(), found.field("counts").to_pylist()):
            if isinstance(v, float) and math.isnan(v):
                v = math.nan  # one object, so that it is one key
            self.counts[v] = self.counts.get(v, 0) + n
        if len(self.counts) > 2 * self.most:
            self.cut()

    def cut(self) -> None:
        if len(self.counts) > self.most:
            over = sorted(self.counts.values(), reverse=True)[self.most]
            self.counts = {v: n - over for v, n in self.counts.items() if n > over}
            self.taken += over


def _counted(most: int, kind: pa.DataType):
    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = Counters(most)
        for batch in batches:
            c.add(batch.column(0))
        c.cut()
        # the last row has no value: what was taken, and the rows seen
        values, n = list(c.counts), list(c.counts.values())
        yield pa.RecordBatch.from_arrays(
            [pa.array([*values, None], kind), pa.array([*n, 0], pa.int64()), pa.array([0] * len(n) + [c.taken], pa.int64()), pa.array([0] * len(n) + [c.rows], pa.int64()), pa.array([True] * len(n) + [False])],
            ["value", "n", "taken", "rows", "is_value"],
        )

    return counted


def countable(t: T.DataType) -> bool:
    return isinstance(t, (T.StringType, T.IntegralType, T.FloatType, T.DoubleType, T.BooleanType, T.BinaryType, T.DecimalType))


def heavy_values(df: DataFrame, col: str, limit: int = 200, spec: QuerySpec = QuerySpec(), counters: int = COUNTERS) -> DataFrame:
    """What top_values gives, exactly; shuffled are some counters a task and the candidates' counts, if these can be told."""
    if not countable(field_of(df, col).dataType):
        return top_values(df, col, limit, spec)
    rows = faceted(df, spec, col).select(column(df, col).alias("value"))
    kind = rows.schema["value"].dataType
    schema = T.StructType([T.StructField("value", kind), T.StructField("n", T.LongType()), T.StructField("taken", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("is_value", T.BooleanType())])
    found = stored(rows.mapInArrow(_counted(counters, to_arrow_type(kind)), schema), "counters")
    taken, total = found.agg(F.sum("taken"), F.sum("rows")).first()
    least = found.where("is_value").groupBy("value").agg(F.sum("n").alias("n"))
    if not taken:
        return labelled(least, total or 0, col, spec).orderBy(F.desc("n"), "label").limit(limit)
    wanted = [r.n for r in least.orderBy(F.desc("n")).limit(limit).select("n").collect()]
    if len(wanted) < limit or wanted[-1] <= taken:
        return top_values(df, col, limit, spec)
    may = least.where(F.col("n") + taken >= wanted[-1]).select(F.col("value").alias("__v"))
    may = F.broadcast(may) if may.count() <= SENT else may
    counts = rows.join(may, F.col("value").eqNullSafe(F.col("__v")), "left_semi").groupBy("value").agg(F.count("*").alias("n"))
    return labelled(counts, total, col, spec).orderBy(F.desc("n"), "label").limit(limit)

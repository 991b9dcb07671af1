"""Native copies of sources, with a manifest that tells whether they are still right."""

from __future__ import annotations

import dataclasses
import datetime
import decimal
import json
import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.model import Filter, QuerySpec, Sort
from ..operators.view import select
from .shared import delete, exists, members, put_if_absent, qualified, stored
from .tables import source_members, source_token, tokens

MANIFEST = "name string, path string, source string, token string, columns array<string>, bytes long, last_used timestamp, spec string"
BUDGET_BYTES, MAX_AGE_DAYS = 20 * 10**9, 14


def snapshot(df: DataFrame, folder: str, name: str) -> DataFrame:
    """df as a Parquet copy in its present order, with row_no from 1 without gaps, swapped in under the name of a temporary view.

    Rows are written once with their place in their partition; a row's number is that place behind all partitions before.
    """
    path = f"{folder}/{name}-{_now():%Y%m%d%H%M%S%f}"
    place = F.monotonically_increasing_id()
    df.withColumn("__part", F.shiftright(place, 33).cast("int")).withColumn("__at", place.bitwiseAND(F.lit((1 << 33) - 1))).write.option("compression", "zstd").parquet(path)
    copy = opened(df.sparkSession, path)
    copy.createOrReplaceTempView(name)
    copy._path = path
    return copy


def opened(spark: SparkSession, path: str) -> DataFrame:
    """A snapshot's rows with row_no."""
    rows = spark.read.parquet(path)
    sizes = rows.groupBy("__part").agg((F.max("__at") + 1).alias("__n"))  # a row a partition of the copy
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    return rows.join(F.broadcast(starts), "__part").withColumn("row_no", F.col("__start") + F.col("__at") + 1).drop("__part", "__at", "__start")


def _now() -> datetime.datetime:
    return datetime.datetime.now(datetime.UTC)


class Manifest:
    """Snapshots by name, as a folder of numbered commits that any number of sessions may write.

    A commit is one row in a small file, put in place under the next free number, or not at all: who comes second looks
    for the next number again, so no session loses another's rows. Of one name the highest commit counts. Every
    CHECKPOINT commits the rows up to there become one table, and readers begin behind it.
    """

    CHECKPOINT = 100

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def _commits(self) -> tuple[dict[int, str], dict[int, str]]:
        """Files of commits, and folders of whole checkpoints, by number."""
        found = [m.path for m in members(self.spark, self.folder)] if exists(self.spark, self.folder) else []
        one = {int(m[1]): p for p in found if (m := re.search(r"/commit-(\d{12})\.json$", p))}
        parts = {int(m[1]): m[0].strip("/") for p in found if (m := re.search(r"/checkpoint-(\d{12})/", p))}
        return one, {n: f"{self.folder}/{f}" for n, f in parts.items() if exists(self.spark, f"{self.folder}/{f}/_SUCCESS")}

    def _latest(self, one: dict[int, str], whole: dict[int, str], upto: int) -> DataFrame:
        start = max((n for n in whole if n <= upto), default=0)
        old = self.spark.read.schema(MANIFEST).parquet(whole[start]).withColumn("at", F.lit(start)) if start else None
        names = [p for n, p in sorted(one.items()) if start < n <= upto]
        new = self.spark.read.schema(f"{MANIFEST}, at int").json(names) if names else None
        rows = new if old is None else old if new is None else old.unionByName(new)
        if rows is None:
            return self.spark.createDataFrame([], MANIFEST)
        fields = [f.name for f in rows.schema.fields if f.name != "at"]
        return rows.groupBy("name").agg(F.max_by(F.struct(*fields), "at").alias("r")).select("r.*")

    def rows(self) -> DataFrame:
        one, whole = self._commits()
        return self._latest(one, whole, max([0, *one, *whole]))

    def put(self, row: tuple) -> None:
        fields = [f.split()[0] for f in MANIFEST.split(", ")]
        while True:
            one, whole = self._commits()
            n = max([0, *one, *whole]) + 1
            text = json.dumps(dict(zip(fields, row)) | {"at": n}, default=str)
            if put_if_absent(self.spark, f"{self.folder}/commit-{n:012d}.json", text + "\n"):
                break
        if n % self.CHECKPOINT == 0:  # one writer has this number
            one, whole = self._commits()
            self._latest(one, whole, n).coalesce(1).write.parquet(f"{self.folder}/checkpoint-{n:012d}")

    def find(self, name: str):
        return self.rows().where(F.col("name") == name).first()


#: Types of filter values that JSON has no form for: the way out and back.
_TYPED = {
    "datetime": (datetime.datetime, lambda v: v.isoformat(), datetime.datetime.fromisoformat), "date": (datetime.date, lambda v: v.isoformat(), datetime.date.fromisoformat),
    "decimal": (decimal.Decimal, str, decimal.Decimal),
}


def _written(spec: QuerySpec) -> str:
    def typed(v):
        name, write = next((k, w) for k, (t, w, _) in _TYPED.items() if isinstance(v, t))
        return {"type": name, "text": write(v)}

    return json.dumps(dataclasses.asdict(spec), default=typed)


def _read(text: str | None) -> QuerySpec:
    found = json.loads(text or "{}")
    value = lambda v: _TYPED[v["type"]][2](v["text"]) if isinstance(v, dict) else v
    filters = tuple(Filter(f["col"], f["op"], tuple(map(value, f["values"]))) for f in found.get("filters", ()))
    return QuerySpec(filters, tuple(Sort(**s) for s in found.get("sort", ())))


def adopt_or_rebuild(
    manifest: Manifest, name: str, source: str, read: Callable[[], DataFrame], columns: list[str] | None = None, spec: QuerySpec | None = None
) -> tuple[str, DataFrame]:
    """('adopted' or 'rebuilt', the snapshot): an old one is used only if the source's token and the columns are the same.

    spec, the view's filters and sort, is kept with the snapshot for refresh(); without one the old one stays.
    """
    spark = manifest.spark
    token, old = source_token(spark, source).first(), manifest.find(name)
    kept = _written(spec) if spec is not None else old.spec if old else None
    if old and old.token == token.token and exists(spark, old.path) and (columns is None or list(old.columns) == columns):
        copy = opened(spark, old.path)
        copy.createOrReplaceTempView(name)
        if kept != old.spec:
            manifest.put((*old[:-1], kept))
        return "adopted", copy
    df = read()
    copy = snapshot(df, manifest.folder, name)
    manifest.put((name, copy._path, qualified(spark, source), token.token, df.columns, token.bytes, _now(), kept))
    if old:
        delete(spark, old.path)
    return "rebuilt", copy


def refresh(manifest: Manifest, name: str, read: Callable[[], DataFrame]) -> tuple[str, DataFrame]:
    """('unchanged' or 'refreshed', the rows under the view's kept filters and sort): rebuilt only if the source has changed."""
    row = manifest.find(name)
    if row is None:
        raise KeyError(name)
    done, copy = adopt_or_rebuild(manifest, name, row.source, read)
    return ("unchanged" if done == "adopted" else "refreshed"), select(copy, _read(row.spec))


def retention(manifest: DataFrame, now, budget: int = BUDGET_BYTES, max_age_days: int = MAX_AGE_DAYS, store=stored) -> DataFrame:
    """name, bytes, last_used, verdict: aged, over (least recently used beyond the budget) or keep; never two of them.

    Bytes are summed in order over ranges of last_used, and the ranges' sums in turn, so no task sees all rows.
    """
    cutoff = F.lit(now).cast("timestamp") - F.make_dt_interval(F.lit(max_age_days))
    aged = F.coalesce(F.col("last_used").cast("timestamp") < cutoff, F.lit(False))
    keys = [F.col("aged").asc(), F.col("last_used").desc_nulls_last(), F.col("name").desc_nulls_last()]
    ordered = manifest.select("name", "bytes", "last_used", aged.alias("aged")).repartitionByRange(*keys).sortWithinPartitions(*keys)
    placed = store(ordered.withColumn("__part", F.spark_partition_id()))
    counted = F.when(~F.col("aged"), F.coalesce("bytes", F.lit(0))).otherwise(F.lit(0))
    parts = placed.groupBy("__part").agg(F.sum(counted).alias("__sum"))  # a row a range
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("__part", F.coalesce(F.sum("__sum").over(before), F.lit(0)).alias("__start"))
    within = Window.partitionBy("__part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    run = F.col("__start") + F.sum(counted).over(within)
    verdict = F.when(F.col("aged"), "aged").when(F.col("run") > budget, "over").otherwise("keep")
    return placed.join(F.broadcast(starts), "__part").withColumn("run", run).select("name", "bytes", "last_used", verdict.alias("verdict"))


def stale_snapshots(manifest: Manifest) -> DataFrame:
    """name, status: fresh, changed, or gone (its source vanished; the copy is kept).

    All sources are listed in one go; a file belongs to every source whose folder is one of those above it, or itself.
    """
    spark, known = manifest.spark, manifest.rows().select("name", "source", "token")
    there = sorted({r.source for r in known.select("source").distinct().collect() if exists(spark, r.source)})  # a name a source
    if there:
        parts = F.split("path", "/")
        above = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
        files = source_members(spark, there).withColumn("source", F.explode(above)).join(known.select("source").distinct(), "source")
        now = tokens(files.distinct(), "source").select("source", F.col("token").alias("now"))
    else:
        now = spark.createDataFrame([], "source string, now string")
    empty = spark.createDataFrame([(s,) for s in there], "source string").withColumn("there", F.lit(True))
    status = F.when(F.col("there").isNull(), "gone").when(F.col("now").eqNullSafe(F.col("token")), "fresh").otherwise("changed")
    return known.join(now, "source", "left").join(empty, "source", "left").select("name", status.alias("status"))

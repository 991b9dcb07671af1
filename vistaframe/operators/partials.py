"""Column profiles in parts that can be merged: by task, by member of a source, and over time.

A task sums up its rows column by column, on whole Arrow batches: counts, lengths, bounds, mean and deviation, a sketch of
distinct values (HyperLogLog registers over Spark's hashes) and one of quantiles (sorted runs of K values, whose weights
double when two of a level meet and every other value stays). Parts of a column merge in any order; no step sees rows of
more than one task, and a part has a few ten kilobytes, whatever its rows.

Kept by member, parts make the profile of a source that grows: members that are new or have changed are scanned, the
others come from the store.
"""

from __future__ import annotations

import datetime
import decimal
import math
import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.model import as_text, column, kind_of
from ..sources.shared import exists, members, stored

# Texts that look like missing data, compared in lower case and trimmed.
NULLISH = ("", "na", "n/a", "null", "none", "nil", "-", "--", "—", "?", "#n/a", "#na", "nan", "not available", "unknown", ".")
#: Bits of a hash that choose a register (standard error 1.04 / 2^(BITS/2), here 1.6 percent), and values of a run (rank error well below a hundredth).
BITS, RUN = 12, 1024
#: Parts of a column that one task merges; more are merged in groups first.
MERGED = 256
PART = ("column string, type string, class string, position int, n long, n_null long, n_empty long, n_nullish long, max_len long, lo string, hi string, "
        "seen long, mean double, m2 double, registers binary, runs binary")


class Quantiles:
    """Values by rank, from runs of RUN sorted values that stand for 2^level values each."""

    def __init__(self) -> None:
        self.levels: dict[int, np.ndarray] = {}
        self.rest = np.zeros(0)
        self.turn = 0

    def add(self, values: np.ndarray) -> None:
        if len(self.rest):
            values = np.concatenate([self.rest, values])
        at = 0
        while len(values) - at >= RUN:
            level = int((len(values) - at) // RUN).bit_length() - 1
            some = np.sort(values[at : at + (RUN << level)])
            self.turn += 1
            self._put(level, some[(self.turn * 0x9E3779B1 >> 7) % (1 << level) :: 1 << level])
            at += RUN << level
        self.rest = values[at:]

    def _put(self, level: int, run: np.ndarray) -> None:
        while (other := self.levels.pop(level, None)) is not None:
            self.turn += 1
            run = np.sort(np.concatenate([other, run]))[self.turn % 2 :: 2]
            level += 1
        self.levels[level] = run

    def merge(self, other: Quantiles) -> None:
        for level, run in sorted(other.levels.items()):
            self._put(level, run)
        self.add(other.rest.astype(self.rest.dtype) if len(self.rest) else other.rest)

    def at(self, shares: list[float]) -> list:
        runs = [(self.rest, 1), *((r, 1 << level) for level, r in self.levels.items())]
        values = np.concatenate([r for r, _ in runs if len(r)] or [np.zeros(0)])
        if not len(values):
            return [None] * len(shares)
        weights = np.concatenate([np.full(len(r), w) for r, w in runs if len(r)])
        order = np.argsort(values, kind="stable")
        upto = np.cumsum(weights[order])
        return [values[order][min(len(values) - 1, int(np.searchsorted(upto, math.ceil(s * upto[-1]))))].item() for s in shares]

    def dumps(self) -> bytes:
        whole = self.rest.dtype.kind == "i" if len(self.rest) else any(r.dtype.kind == "i" for r in self.levels.values())
        kind = "<i8" if whole else "<f8"
        head = struct.pack("<BIB", whole, len(self.rest), len(self.levels)) + bytes(sorted(self.levels))
        return head + self.rest.astype(kind).tobytes() + b"".join(self.levels[k].astype(kind).tobytes() for k in sorted(self.levels))

    @classmethod
    def loads(cls, data: bytes) -> Quantiles:
        out = cls()
        whole, n, k = struct.unpack_from("<BIB", data)
        levels, kind = data[6 : 6 + k], "<i8" if whole else "<f8"
        out.rest = np.frombuffer(data, kind, n, 6 + k)
        at = 6 + k + 8 * n
        for level in levels:
            out.levels[level] = np.frombuffer(data, kind, RUN, at)
            at += 8 * RUN
        return out


def registers(hashes: np.ndarray, into: np.ndarray) -> None:
    """Raise the registers of 64-bit hashes to the place of the first set bit behind the chosen ones."""
    h = hashes.view(np.uint64)
    rest = (h & np.uint64((1 << (64 - BITS)) - 1)).astype(np.float64)
    np.maximum.at(into, (h >> np.uint64(64 - BITS)).astype(np.int64), (64 - BITS + 1 - np.frexp(rest)[1]).astype(np.uint8))


def estimate(into: np.ndarray) -> int:
    """Distinct hashes by the estimator that needs no bias table: sums over registers, corrected where they are 0 or full."""
    m, q = len(into), 64 - BITS
    counts = np.bincount(into, minlength=q + 2)
    x = 1 - counts[q + 1] / m
    z, y, before = 1 - x, 1.0, None
    if x in (0, 1):
        z = 0.0
    else:
        while z != before:
            x, before, y = math.sqrt(x), z, y / 2
            z -= (1 - x) ** 2 * y
        z /= 3
    z *= m
    for k in range(q, 0, -1):
        z = 0.5 * (z + counts[k])
    x = counts[0] / m
    if x == 1:
        return 0
    y, s, before = 1.0, x, None
    while s != before:
        x, before = x * x, s
        s += x * y
        y += y
    return round(m * m / (2 * math.log(2)) / (z + m * s))


def class_of(t: T.DataType) -> str:
    """How bounds of a type compare and read: whole, real, exact, time, local, day, text, flag, or none of these."""
    if isinstance(t, T.IntegralType):
        return "whole"
    if isinstance(t, (T.FloatType, T.DoubleType)):
        return "real"
    names = ((T.DecimalType, "exact"), (T.TimestampType, "time"), (T.TimestampNTZType, "local"), (T.DateType, "day"), (T.BooleanType, "flag"))
    return next((n for k, n in names if isinstance(t, k)), "text" if kind_of(t) == "text" else "none")


READ = {"whole": int, "real": float, "exact": decimal.Decimal, "time": int, "local": int, "day": int, "text": str, "flag": str}
EPOCH = datetime.datetime(1970, 1, 1)


def _shown(value, of: str) -> str:
    """A bound as text that READ brings back."""
    return repr(value) if of == "real" else format(value, "f") if of == "exact" else value if of == "text" else str(value).lower()


class Part:
    """One column's rows, summed up."""

    def __init__(self, of: str) -> None:
        self.of = of
        self.n = self.n_null = self.n_empty = self.n_nullish = self.max_len = self.seen = 0
        self.lo = self.hi = None
        self.mean = self.m2 = 0.0
        self.registers, self.quantiles = np.zeros(1 << BITS, np.uint8), Quantiles()

    def add(self, values: pa.Array, hashes: np.ndarray, lengths: pa.Array | None) -> None:
        self.n += len(values)
        self.n_null += values.null_count
        if values.null_count:
            there = pc.is_valid(values)
            values, hashes = values.filter(there), hashes[there.to_numpy(zero_copy_only=False)]
        registers(hashes, self.registers)
        if lengths is not None:
            self.max_len = max(self.max_len, pc.max(lengths).as_py() or 0)
        elif self.of == "none" and len(values):  # what is no text counts as one mark
            self.max_len = 1
        if not len(values) or self.of == "none":
            return
        if self.of in ("text", "flag"):
            if self.of == "text":
                self.n_empty += pc.sum(pc.equal(values, "")).as_py() or 0
                self.n_nullish += (pc.sum(pc.is_in(pc.utf8_lower(pc.utf8_trim(values, " ")), pa.array(NULLISH[1:]))).as_py() or 0)
                self.n_nullish += pc.sum(pc.and_(pc.equal(pc.utf8_trim(values, " "), ""), pc.not_equal(values, ""))).as_py() or 0
                self.max_len = max(self.max_len, pc.max(pc.utf8_length(values)).as_py() or 0)
                self._bounds(*pc.min_max(values).as_py().values())
            else:
                seen = pc.unique(values).to_pylist()
                self._bounds(min(seen), max(seen))
            return
        if self.of == "exact":
            self._bounds(*pc.min_max(values).as_py().values())
            numbers = values.cast(pa.float64()).to_numpy(zero_copy_only=False)
        else:
            numbers = values.to_numpy(zero_copy_only=False)
            if self.of == "real":
                self.n_nullish += int(np.isnan(numbers).sum())
                least = np.fmin.reduce(numbers)  # NaN counts as the largest
                self._bounds(float(least), float(np.max(numbers)))
            else:
                self._bounds(int(numbers.min()), int(numbers.max()))
        self.quantiles.add(numbers)
        if self.of in ("whole", "real", "exact"):
            reals = numbers.astype(np.float64)
            mean = float(reals.mean())
            self._moments(len(reals), mean, float(((reals - mean) ** 2).sum()))

    def _bounds(self, lo, hi) -> None:
        key = (lambda v: (math.isnan(v), v)) if self.of == "real" else (lambda v: v)
        self.lo = lo if self.lo is None else min(self.lo, lo, key=key)
        self.hi = hi if self.hi is None else max(self.hi, hi, key=key)

    def _moments(self, n: int, mean: float, m2: float) -> None:
        if n:
            both, apart = self.seen + n, mean - self.mean
            self.m2 += m2 + apart * apart * self.seen * n / both
            self.mean = mean if not self.seen else self.mean + apart * n / both
            self.seen = both

    def row(self) -> tuple:
        show = lambda v: None if v is None else _shown(v, self.of)
        return (self.n, self.n_null, self.n_empty, self.n_nullish, self.max_len, show(self.lo), show(self.hi), self.seen, self.mean, self.m2, self.registers.tobytes(), self.quantiles.dumps())

    def take(self, r: dict) -> None:
        """Another part of the same column, as a row."""
        for k in ("n", "n_null", "n_empty", "n_nullish"):
            setattr(self, k, getattr(self, k) + r[k])
        self.max_len = max(self.max_len, r["max_len"])
        if r["lo"] is not None:
            self._bounds(READ[self.of](r["lo"]), READ[self.of](r["hi"]))
        self._moments(r["seen"], r["mean"], r["m2"])
        np.maximum(self.registers, np.frombuffer(r["registers"], np.uint8), out=self.registers)
        self.quantiles.merge(Quantiles.loads(r["runs"]))


def parts(df: DataFrame, member: Column | None = None) -> DataFrame:
    """member, and the parts of every column by task (and member: text)."""
    fields, classes = df.schema.fields, [class_of(f.dataType) for f in df.schema.fields]
    sent = [(member if member is not None else F.lit("")).alias("m")]
    for i, (f, of) in enumerate(zip(fields, classes)):
        c = column(df, f.name)
        sent.append(_sent(c, of).alias(f"v{i}"))
        sent.append(F.xxhash64(c if of != "none" or kind_of(f.dataType) == "blob" else F.to_json(F.struct(c))).alias(f"h{i}"))
        if of in ("real", "exact", "time", "local", "day", "none") and kind_of(f.dataType) not in ("nested", "blob"):
            sent.append(F.char_length(as_text(c)).alias(f"l{i}"))
    known = [(f.name, f.dataType.simpleString(), of, i) for i, (f, of) in enumerate(zip(fields, classes))]
    return df.select(*sent).mapInArrow(_summed(known), f"member string, {PART}")


LOCAL = "timestamp_ntz'1970-01-01 00:00:00'"


def _sent(c: Column, of: str) -> Column:
    """A column as tasks take it: times as microseconds, days as numbers, what has no order as whether it is there."""
    if of == "local":
        return F.timestamp_diff("MICROSECOND", F.expr(LOCAL), c)
    return {"none": lambda: F.when(c.isNotNull(), F.lit(True)), "time": lambda: F.unix_micros(c), "day": lambda: F.unix_date(c), "text": lambda: as_text(c)}.get(of, lambda: c)()


def _summed(known: list[tuple]):
    def summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by: dict[str, list[Part]] = {}
        for batch in batches:
            names = batch.column("m")
            for low, high in _spans(names):
                name = names[low].as_py()
                if name not in by:
                    if len(by) >= 8:  # members of a task come one after the other: finished ones go on their way
                        yield from (_rows(m, known, p) for m, p in by.items())
                        by = {}
                    by[name] = [Part(of) for _, _, of, _ in known]
                for i, part in enumerate(by[name]):
                    values = batch.column(f"v{i}").slice(low, high - low)
                    lengths = batch.column(f"l{i}").slice(low, high - low) if f"l{i}" in batch.schema.names else None
                    part.add(values, batch.column(f"h{i}").slice(low, high - low).to_numpy(zero_copy_only=False), lengths)
        yield from (_rows(m, known, p) for m, p in by.items())

    return summed


def _spans(names: pa.Array) -> Iterator[tuple[int, int]]:
    if len(names) and names[0] == names[len(names) - 1] and pc.count_distinct(names).as_py() == 1:
        yield 0, len(names)
        return
    ends = names.dictionary_encode().indices.to_numpy(zero_copy_only=False)
    edges = (np.flatnonzero(np.diff(ends)) + 1).tolist()
    if len(names):
        yield from zip([0, *edges], [*edges, len(names)])


_ARROW = [("n", pa.int64()), ("n_null", pa.int64()), ("n_empty", pa.int64()), ("n_nullish", pa.int64()), ("max_len", pa.int64()), ("lo", pa.string()), ("hi", pa.string()),
          ("seen", pa.int64()), ("mean", pa.float64()), ("m2", pa.float64()), ("registers", pa.binary()), ("runs", pa.binary())]


def _rows(member: str, known: list[tuple], found: list[Part]) -> pa.RecordBatch:
    columns = {"member": pa.array([member] * len(known), pa.string())}
    columns |= {n: pa.array([k[j] for k in known], pa.int32() if n == "position" else pa.string()) for j, n in enumerate(("column", "type", "class", "position"))}
    rows = list(zip(*(p.row() for p in found))) or [[]] * len(_ARROW)
    columns |= {n: pa.array(v, t) for v, (n, t) in zip(rows, _ARROW)}
    return pa.RecordBatch.from_pydict(columns)


def merged(found: DataFrame, *, many: bool = False) -> DataFrame:
    """One part a column, of parts by task or member. many: first in groups, so that no task merges more than some."""

    def merge(rows: pa.Table) -> pa.Table:
        rows = rows.to_pylist()
        part = Part(rows[0]["class"])
        for r in rows:
            part.take(r)
        out = rows[0] | {"position": min(r["position"] for r in rows)} | dict(zip((n for n, _ in _ARROW), part.row()))
        return pa.table({n: pa.array([out[n]], t) for n, t in [("column", pa.string()), ("type", pa.string()), ("class", pa.string()), ("position", pa.int32()), *_ARROW]})

    keys = ["column", "type", "class"]
    if many:
        found = found.withColumn("__g", F.pmod(F.xxhash64("member", "n", "mean", "registers"), F.lit(MERGED))).groupBy(*keys, "__g").applyInArrow(merge, PART)
    return found.drop("member").groupBy(*keys).applyInArrow(merge, PART)


def finished(part: DataFrame) -> DataFrame:
    """A row a column of a summary with missing counts, from merged parts; the same columns as operators.profile makes."""

    @F.pandas_udf("d long, q array<string>")
    def sketches(regs: pd.Series, runs: pd.Series, of: pd.Series) -> pd.DataFrame:
        points = [Quantiles.loads(r).at([0.25, 0.5, 0.75]) for r in runs]
        return pd.DataFrame({"d": [estimate(np.frombuffer(r, np.uint8)) for r in regs], "q": [[None if v is None else repr(int(v)) if o in ("time", "local", "day") else repr(v) for v in p] for p, o in zip(points, of)]})

    def text(c: Column) -> Column:
        of, at = F.col("class"), c.try_cast("long")
        real = F.when(F.col("type") == "float", c.try_cast("float").cast("string")).otherwise(c.try_cast("double").cast("string"))
        return (F.when(of == "time", F.timestamp_micros(at).cast("string")).when(of == "local", F.timestamp_add("MICROSECOND", at, F.expr(LOCAL)).cast("string"))
                .when(of == "day", F.date_from_unix_date(at.cast("int")).cast("string")).when(of == "real", real).otherwise(c))

    numbers = F.col("class").isin("whole", "real", "exact")
    # the longest whole number is the smallest or the largest one
    longest = F.when(F.col("class") == "whole", F.greatest(F.char_length("lo"), F.char_length("hi"))).when(F.col("class") == "flag", F.when(F.col("lo") == "false", 5).otherwise(4)).otherwise(F.col("max_len"))
    out = part.withColumn("__s", sketches("registers", "runs", "class"))
    return out.select(
        "position", "column", "type", text(F.col("lo")).alias("min"), text(F.col("hi")).alias("max"),
        F.when(numbers & (F.col("seen") > 0), F.col("mean")).alias("avg"), F.when(numbers & (F.col("seen") > 1), F.sqrt(F.col("m2") / (F.col("seen") - 1))).alias("std"),
        F.col("__s.d").alias("approx_distinct"), *[text(F.col("__s.q")[j]).alias(k) for j, k in enumerate(("q25", "q50", "q75"))],
        "n", F.when(F.col("n") > 0, 100.0 * F.col("n_null") / F.col("n")).alias("null_pct"), "n_null", "n_empty", "n_nullish", longest.cast("long").alias("max_len"),
    )


def nothing(df: DataFrame) -> DataFrame:
    """A part of no rows for every column, so that each column has one."""
    rows = [("", f.name, f.dataType.simpleString(), of, i, *Part(of).row()) for i, (f, of) in enumerate((f, class_of(f.dataType)) for f in df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, f"member string, {PART}")


def fits(df: DataFrame) -> bool:
    """Whether bounds of all columns' types can be kept in parts."""
    return all(class_of(f.dataType) != "none" or kind_of(f.dataType) in ("nested", "blob") for f in df.schema.fields)


def summary(df: DataFrame) -> DataFrame:
    """A row a column of a table, from one scan."""
    return finished(merged(parts(df).unionByName(nothing(df)), many=df.rdd.getNumPartitions() > MERGED))


class MemberProfiles:
    """Parts by member of a source, in a folder. Only members that are new, or have another time or length, are scanned."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder, self.scanned = spark, folder.rstrip("/"), 0

    def _kept(self) -> DataFrame | None:
        """All scans; each is a folder of its own, named one by one, as Spark takes two listings of one folder for the same."""
        scans = sorted({m.path.rsplit("/", 2)[0] + "/" + m.path.rsplit("/", 2)[1] for m in members(self.spark, self.folder)}) if exists(self.spark, self.folder) else []
        return self.spark.read.parquet(*scans) if scans else None

    def summary(self, path: str, read=None) -> DataFrame:
        """A row a column of the source at path; read(names) makes the frame of some members (Parquet files, if none is given)."""
        read = read or (lambda names: self.spark.read.parquet(*names))
        m = "_metadata"
        key = F.concat_ws("|", f"{m}.file_path", F.unix_micros(f"{m}.file_modification_time").cast("string"), F.col(f"{m}.file_size").cast("string"))
        listed = self.spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        there = stored(listed.where(~F.element_at(F.split("path", "/"), -1).rlike("^[_.]")).select(F.col("path").alias("file"), key.alias("member")), "members")
        kept = self._kept()
        new = there if kept is None else there.join(kept.select("member").distinct(), "member", "left_anti")
        names = [r.file for r in new.select("file").collect()]  # file names, which Spark's readers need on the driver
        self.scanned = len(names)
        if names:
            scan = uuid.uuid4().hex
            parts(read(names), key).withColumn("scan", F.lit(scan)).write.parquet(f"{self.folder}/{scan}")
            kept = self._kept()
        # what is here now; a member that two sessions scanned counts once, with all parts of its first scan
        own = kept.join(there.select("member"), "member", "left_semi")
        once = own.groupBy("member").agg(F.min("scan").alias("scan"))
        own = own.join(once, ["member", "scan"], "left_semi").drop("scan")
        return finished(merged(own, many=own.count() > MERGED))


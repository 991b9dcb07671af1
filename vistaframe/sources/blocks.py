"""Records that reach over lines, read from one file by many tasks.

Spark reads a file in blocks, byte ranges that it cuts behind a separator: a line break, or a closing brace for JSON arrays.
What lies between two separators is a fragment, and a record is one or more of them. Whether a separator ends a record
depends on what came before it: a quoted field or a string may be open there, and a bracket.

1. The survey runs the automaton (outside or inside quotes, and depth) over every block from both states, as the one that
   holds at its start is not known yet: one small row a block says where each leads to.
2. Windows over a file's blocks compose these: the state of a block's start is that of the last block that leads to one
   state whatever came before, turned over by every block since that turns it over; depths and line numbers are sums.
3. With that, each block gives its records. One that is open at a block's end is left in pieces, which are joined by the
   block where it began; there is at most one such record a block.

A record that is never closed has no end: its fragments then are records of their own. Blank lines and comments are none.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import head, members, stored

#: Up to this many blocks (or files), what is known of them is sent to every task; beyond it, fragments are sorted to them.
SENT = 200_000


@dataclass(frozen=True)
class QuotedLines:
    """Lines whose fields may be quoted; a quote opens only at the start of a field, and a doubled or escaped one is text."""

    delimiter: bytes = b","
    quote: bytes = b'"'
    escape: bytes = b'"'
    comment: bytes = b""
    separator: bytes = b"\n"
    level = 0

    def plain(self, fragments: pa.Array) -> np.ndarray:
        """Which fragments change nothing."""
        return ~pc.match_substring(fragments, self.quote).to_numpy(zero_copy_only=False)

    def nothing(self, fragment: bytes) -> bool:
        """Whether a fragment between records is none itself."""
        return not fragment.strip() or bool(self.comment) and fragment.startswith(self.comment)

    ignored = nothing  # outside quotes is between records

    def step(self, fragment: bytes, inside: int) -> tuple[int, int]:
        """(state behind a fragment, change of depth)."""
        if self.quote not in fragment:
            return inside, 0
        at, q = 0, self.quote
        while True:
            if not inside:
                if not fragment.startswith(q, at):
                    at = fragment.find(self.delimiter, at) + len(self.delimiter)
                    if at < len(self.delimiter):
                        return 0, 0
                    continue
                at += 1
            if (at := self._closed(fragment, at)) < 0:
                return 1, 0
            inside = 0
            at = fragment.find(self.delimiter, at) + len(self.delimiter)
            if at < len(self.delimiter):
                return 0, 0

    def _closed(self, fragment: bytes, at: int) -> int:
        """The place behind the quote that closes, -1 without one."""
        while True:
            q = fragment.find(self.quote, at)
            if self.escape != self.quote:
                e = fragment.find(self.escape, at, q if q >= 0 else None)
                if e >= 0:
                    at = e + 2
                    continue
            if q < 0:
                return -1
            if self.escape != self.quote or not fragment.startswith(self.quote, q + 1):
                return q + 1
            at = q + 2

    def record(self, fragments: list[bytes]) -> bytes:
        text = b"\n".join(fragments)
        return text[:-1] if text.endswith(b"\r") else text


@dataclass(frozen=True)
class Elements:
    """Objects of one array a file: fragments end at closing braces; strings hide brackets."""

    separator: bytes = b"}"
    level = 1
    comment = b""

    def plain(self, fragments: pa.Array) -> np.ndarray:
        return np.zeros(len(fragments), bool)

    def nothing(self, fragment: bytes) -> bool:
        return not fragment.strip(b"\xef\xbb\xbf[], \t\r\n")

    def ignored(self, fragment: bytes) -> bool:
        return False

    def step(self, fragment: bytes, inside: int) -> tuple[int, int]:
        if b"\\" in fragment:
            fragment = _ESCAPED.sub(b"", fragment)
        parts = fragment.split(b'"')
        outside = b"".join(parts[inside::2])
        inside = (inside + len(parts) - 1) % 2
        opened = outside.count(b"{") + outside.count(b"[") - outside.count(b"]")
        return inside, opened - (not inside)

    def record(self, fragments: list[bytes]) -> bytes:
        return b"}".join([*fragments, b""]).lstrip(b"\xef\xbb\xbf[, \t\r\n")


_ESCAPED = re.compile(rb"\\.", re.DOTALL)


@dataclass
class Blocks:
    """The fragments of some files, and what is known of each block."""

    spark: SparkSession
    paths: list[str]
    scan: QuotedLines | Elements
    skip: int = 0
    _info: DataFrame | None = field(default=None, repr=False)
    _lines: DataFrame | None = field(default=None, repr=False)

    def fragments(self) -> DataFrame:
        """f (number of the file), b, l (start and length of the block), value, filename, in the order of the file."""
        text = self.spark.read.option("lineSep", self.scan.separator.decode()).text(self.paths)
        m = "_metadata"
        return text.select(F.xxhash64(f"{m}.file_path").alias("f"), F.col(f"{m}.file_block_start").alias("b"), F.col(f"{m}.file_block_length").alias("l"),
                           F.col("value").cast("binary").alias("value"), F.col(f"{m}.file_path").alias("filename"))

    def names(self) -> DataFrame:
        """f, filename of every file that has fragments."""
        return self.info().where("filename is not null").groupBy("f").agg(F.min("filename").alias("filename"))

    def info(self) -> DataFrame:
        """A row a block: f, b, l, n (fragments), head and state, depth, line (number of its first fragment in the file), opened
        (whether a record is open at its start), owner (the block where that began), lost (where one began that never ends),
        first (number of the file's first fragment behind skipped ones that is neither blank nor a comment), broken."""
        if self._info is None:
            rows = stored(self._survey({}), "blocks")
            w = Window.partitionBy("f").orderBy("b")
            before = w.rowsBetween(Window.unboundedPreceding, -1)
            late = []
            if self.skip:  # skipped lines that reach into a later block: its automaton begins behind them
                lines = rows.withColumn("line", F.coalesce(F.sum("n").over(before), F.lit(0)))
                late = lines.where((F.col("b") > 0) & (F.col("line") < self.skip)).select("f", "b", "line").collect()
            if late:
                rows = stored(self._survey({(r.f, r.b): r.line for r in late}), "blocks")
            self._info = stored(_composed(rows, self.scan.level), "block-starts")
        return self._info

    def _survey(self, lines: dict) -> DataFrame:
        schema = "f bigint, b bigint, l bigint, n bigint, to0 int, to1 int, d0 int, d1 int, at0 array<int>, at1 array<int>, in0 boolean, in1 boolean, first bigint, head binary, filename string"
        return self.fragments().mapInArrow(_surveyed(self.scan, self.skip, lines), schema)

    def broken(self) -> bool:
        """Whether any record has more than one line."""
        return not self.info().where("broken").limit(1).isEmpty()

    def heads(self) -> DataFrame:
        """f, head, filename: the first line of every file that is neither skipped nor blank nor a comment."""
        return self.info().where("head is not null and line + first = head_line").select("f", F.col("head").cast("string").alias("head"), "filename")

    def records(self, header: bool = False) -> DataFrame:
        """f, line_no, value of every record: the number of its first line in its file, and its text. header: without each file's first."""
        if self._lines is None:
            info = self.info().select("f", "b", "l", "state", "depth", "line", "opened", "owner", "lost", "head_line")
            rows = self.fragments().drop("filename")
            if info.limit(SENT + 1).count() <= SENT:
                rows = rows.join(F.broadcast(info), ["f", "b", "l"], "left")
            else:
                rows = rows.withColumn("i", F.monotonically_increasing_id()).join(info, ["f", "b", "l"], "left")
                rows = rows.repartition("f", "b").sortWithinPartitions("f", "b", "i").drop("i")
            changed = F.raise_error(F.lit("the files or the cluster changed between two reads of these files"))
            rows = rows.withColumn("state", F.when(F.col("state").isNull(), changed).otherwise(F.col("state")))
            cut = rows.mapInArrow(_cut(self.scan, self.skip), "f bigint, b bigint, line_no bigint, owner bigint, is_head boolean, value binary")
            if not self.broken():
                self._lines = cut.select("f", "line_no", "is_head", F.col("value").cast("string").alias("value"))
            else:  # written once: complete records and pieces are both read from there
                cut = stored(cut, "records").withColumn("value", F.col("value").cast("string"))
                parts = cut.where("owner is not null").groupBy("f", "owner").agg(
                    F.min("line_no").alias("line_no"), F.max("is_head").alias("is_head"), F.array_sort(F.collect_list(F.struct("b", "value"))).alias("parts"),
                )
                text = F.array_join(F.col("parts.value"), self.scan.separator.decode())
                text = F.concat(F.regexp_replace(text, r"^(?:﻿|[\[, \t\r\n])+", ""), F.lit("}")) if isinstance(self.scan, Elements) else F.regexp_replace(text, r"\r\z", "")
                self._lines = cut.where("owner is null").select("f", "line_no", "is_head", "value").unionByName(parts.select("f", "line_no", "is_head", text.alias("value")))
        out = self._lines.where("not is_head") if header else self._lines
        return out.drop("is_head")


def _composed(rows: DataFrame, level: int) -> DataFrame:
    w = Window.partitionBy("f").orderBy("b")
    before = w.rowsBetween(Window.unboundedPreceding, -1)
    upto = w.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    whole = Window.partitionBy("f")
    of = lambda a, b: F.when(F.col("state") == 0, F.col(a)).otherwise(F.col(b))
    rows = rows.withColumn("turns", F.sum((F.col("to0") > F.col("to1")).cast("int")).over(upto))
    rows = rows.withColumn("fixed", F.last(F.when(F.col("to0") == F.col("to1"), F.struct("to0", "turns")), ignorenulls=True).over(before))
    turned = F.coalesce(F.lag("turns").over(w), F.lit(0)) - F.coalesce("fixed.turns", F.lit(0))
    rows = rows.withColumn("state", ((F.coalesce("fixed.to0", F.lit(0)) + turned) % 2).cast("int"))
    rows = rows.withColumns({
        "line": F.coalesce(F.sum("n").over(before), F.lit(0)), "depth": F.coalesce(F.sum(of("d0", "d1")).over(before), F.lit(0)).cast("int"),
        "ends": of("to0", "to1"), "broken": of("in0", "in1"),
    })
    rows = rows.withColumns({
        "opened": (F.col("line") > 0) & ~((F.col("state") == 0) & (F.col("depth") == level)),
        "open": ~((F.col("ends") == 0) & (F.col("depth") + of("d0", "d1") == level)),
        "closes": F.array_contains(of("at0", "at1"), F.lit(level) - F.col("depth")),
    })
    rows = rows.withColumn("begun", F.when(F.col("open") & (~F.col("opened") | F.col("closes")), F.col("b")))
    rows = rows.withColumn("owner", F.last("begun", ignorenulls=True).over(before))
    last = F.when(F.lead("b").over(w).isNull() & F.col("open"), F.coalesce("begun", "owner"))
    rows = rows.withColumn("last", last)
    return rows.select(
        "f", "b", "l", "n", "state", "depth", "line", "opened", F.when(F.col("opened"), F.col("owner")).alias("owner"), F.max("last").over(whole).alias("lost"),
        F.min(F.col("line") + F.col("first")).over(whole).alias("head_line"), "first", "head", "broken", "filename",
    )


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[int, int]]:
    """Rows of a batch, block by block."""
    f, b = batch.column("f").to_numpy(), batch.column("b").to_numpy()
    edges = np.flatnonzero((np.diff(f) != 0) | (np.diff(b) != 0)) + 1
    yield from zip([0, *edges.tolist()], [*edges.tolist(), len(f)])


def _surveyed(scan, skip: int, lines: dict):
    def survey(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = None
        for batch in batches:
            if not batch.num_rows:
                continue
            for low, high in _runs(batch):
                key = tuple(batch.column(c)[low].as_py() for c in ("f", "b", "l"))
                if row is None or row["key"] != key:
                    if row:
                        yield _survey_row(row)
                    start = 0 if key[1] == 0 else lines.get(key[:2], skip)
                    row = {"key": key, "n": 0, "left": max(0, skip - start), "to": [0, 1], "d": [0, 0], "at": [set(), set()], "in": [False, False], "first": None, "head": None, "filename": batch.column("filename")[low].as_py()}
                _survey_run(scan, row, batch.column("value").slice(low, high - low))
        if row:
            yield _survey_row(row)

    return survey


def _survey_run(scan, row: dict, values: pa.Array) -> None:
    plain = scan.plain(values)
    if row["left"] == 0 and row["first"] is not None and plain.all():  # the usual case: nothing is quoted
        row["n"] += len(values)
        for s in (0, 1):
            if row["to"][s]:
                row["in"][s] = True
            else:
                row["at"][s].add(row["d"][s])
        return
    for v in values.to_pylist():
        row["n"] += 1
        if row["left"]:
            row["left"] -= 1
            continue
        nothing = scan.ignored(v)
        if row["first"] is None and not nothing:
            row["first"], row["head"] = row["n"] - 1, v
        for s in (0, 1):
            if not (nothing and not row["to"][s]):
                row["to"][s], more = scan.step(v, row["to"][s])
                row["d"][s] += more
            if row["to"][s]:
                row["in"][s] = True
            else:
                row["at"][s].add(row["d"][s])


def _survey_row(row: dict) -> pa.RecordBatch:
    f, b, l = row["key"]  # noqa: E741
    ints = {"f": f, "b": b, "l": l, "n": row["n"]}
    out = {k: pa.array([v], pa.int64()) for k, v in ints.items()}
    for name in ("to", "d"):
        out |= {f"{name}{s}": pa.array([row[name][s]], pa.int32()) for s in (0, 1)}
    out |= {f"at{s}": pa.array([sorted(row["at"][s])], pa.list_(pa.int32())) for s in (0, 1)}
    out |= {f"in{s}": pa.array([row["in"][s]], pa.bool_()) for s in (0, 1)}
    out |= {"first": pa.array([row["first"]], pa.int64()), "head": pa.array([row["head"]], pa.binary()), "filename": pa.array([row["filename"]], pa.string())}
    return pa.RecordBatch.from_pydict(out)


#: Bytes of records after which a task hands them on.
HANDED = 4 << 20


def _cut(scan, skip: int):
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, out = None, _Out()
        for batch in batches:
            if not batch.num_rows:
                continue
            for low, high in _runs(batch):
                key = (batch.column("f")[low].as_py(), batch.column("b")[low].as_py())
                if block is None or block.key != key:
                    if block:
                        block.close()
                    row = {c: batch.column(c)[low].as_py() for c in ("state", "depth", "line", "opened", "owner", "lost", "head_line")}
                    block = _Block(scan, skip, key, out, **row)
                for v in batch.column("value").slice(low, high - low).to_pylist():
                    block.add(v)
                if out.size > HANDED:
                    yield out.batch()
        if block:
            block.close()
        yield out.batch()

    return cut


class _Out:
    def __init__(self) -> None:
        self.rows, self.size = [], 0

    def put(self, *row) -> None:
        self.rows.append(row)
        self.size += len(row[-1]) + 50

    def batch(self) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.binary())
        columns = zip(*self.rows) if self.rows else [[]] * 6
        out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["f", "b", "line_no", "owner", "is_head", "value"])
        self.rows, self.size = [], 0
        return out


class _Block:
    """Records of one block, from the state that holds at its start."""

    def __init__(self, scan, skip, key, out, state, depth, line, opened, owner, lost, head_line) -> None:
        self.scan, self.skip, self.key, self.out = scan, skip, key, out
        self.state, self.depth, self.line, self.owner, self.head_line = state, depth, line, owner, head_line
        self.head = opened  # what comes first belongs to a record that began in an earlier block
        self.lost, self.singly = lost, lost is not None and key[1] > lost and opened
        self.held: list[bytes] = []

    def put(self, fragments: list[bytes], line: int, owner: int | None) -> None:
        value = self.scan.record(fragments) if owner is None else self.scan.separator.join(fragments)
        if line == 0 and value.startswith(b"\xef\xbb\xbf"):
            value = value[3:]
        if value or owner is not None:
            self.out.put(*self.key, line, owner, line == self.head_line, value)

    def add(self, v: bytes) -> None:
        line, self.line = self.line, self.line + 1
        if line < self.skip:
            return
        closed = self.state == 0 and not self.held and not self.head
        if closed and self.scan.nothing(v):
            return
        if self.singly:
            if not self.scan.nothing(v):
                self.put([v], line, None)
            return
        self.state, more = self.scan.step(v, self.state)
        self.depth += more
        self.held.append(v)
        if self.state == 0 and self.depth == self.scan.level:
            self.put(self.held, line - len(self.held) + 1, self.owner if self.head else None)
            self.held, self.head = [], False

    def close(self) -> None:
        if not self.held:
            return
        first = self.line - len(self.held)
        if self.lost == self.key[1] and not self.head:
            for k, v in enumerate(self.held):
                if not self.scan.nothing(v):
                    self.put([v], first + k, None)
        else:
            self.put(self.held, first, self.owner if self.head else self.key[1])
        self.held = []


def quoted_lines(spark: SparkSession, paths: list[str], delimiter: str, quote: str, escape: str, comment: str | None, skip: int) -> Blocks:
    """The blocks of delimited text. Files whose lines end in a bare carriage return are cut there."""
    some = next((m.path for p in paths for m in members(spark, p) if m.length), None)
    seen = head(spark, some, 512) if some and not some.lower().endswith((".gz", ".bz2", ".zst", ".lz4", ".snappy", ".deflate")) else b""
    separator = b"\r" if b"\r" in seen[:-1] and b"\n" not in seen else b"\n"
    return Blocks(spark, paths, QuotedLines(delimiter.encode(), quote.encode(), escape.encode(), (comment or "").encode(), separator), skip)

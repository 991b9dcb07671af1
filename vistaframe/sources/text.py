"""Delimited text: dialect, ragged rows, preambles, types, and reads that lose nothing without counting it."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.casts import DATE, NUMBER, TIMESTAMP, cast_strict
from ..functions.model import Dialect, UnsupportedSource, column
from ..operators.quality import good_rows
from .blocks import SENT, Blocks, quoted_lines
from .detect import TEXT, extension
from .shared import members, stored

DELIMITERS = (",", ";", "\t", "|")
SAMPLE_ROWS = 20_480
#: Nothing in a file reads as NULL but an empty unquoted field: the null text is one that no file holds.
NO_TEXT = "\u0000"
CANDIDATES = ("boolean", "bigint", "double", "date", "timestamp")


def lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """value, line_no of a file's lines, in file order. Splits of one file are read in order, so ids rise with lines."""
    text = spark.read.text(path)
    return text.select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"), F.monotonically_increasing_id().alias("line_no"))


def first_lines(spark: SparkSession, path: str, n: int) -> DataFrame:
    """value, line_no of a file's first n lines, numbered from 0 and written once.

    A limit takes the rows of whichever blocks are done first, so lines are numbered in their block, and blocks by where
    they begin in the file. Nothing rests on the order in which blocks are read, or on how many of them a task reads.
    """
    m = "_metadata"
    block = spark.read.text(path).select(F.col(f"{m}.file_block_start").alias("b"), F.col(f"{m}.file_block_length").alias("l"))
    end = max((r.b + r.l for r in block.take(n)), default=0)  # whichever blocks these are of: n lines, or all, begin before it
    text = spark.read.text(path).select(F.regexp_replace("value", "^﻿|\r$", "").alias("value"), F.monotonically_increasing_id().alias("id"), F.col(f"{m}.file_block_start").alias("b"))
    place = F.row_number().over(Window.partitionBy("b").orderBy("id"))
    rows = stored(text.where(F.col("b") < end).withColumn("i", place).where(F.col("i") <= n).drop("id"), "first-lines")
    before, upto = [], 0
    for r in rows.groupBy("b").agg(F.count("*").alias("n")).orderBy("b").collect():  # two numbers a block
        before.append((r.b, upto))
        upto += r.n
    starts = spark.createDataFrame(before, "b long, upto long")
    return rows.join(F.broadcast(starts), "b").select("value", (F.col("upto") + F.col("i") - 1).alias("line_no")).where(F.col("line_no") < n)


def field_count(value: Column, delimiter: str, quote: str = '"') -> Column:
    """Fields of a line: delimiters outside quoted spans, and one."""
    q = "\\" + quote
    bare = F.regexp_replace(value, f"{q}[^{q}]*{q}", "")
    return (F.char_length(bare) - F.char_length(F.replace(bare, F.lit(delimiter), F.lit("")))).cast("int") / F.lit(len(delimiter)) + 1


def field_counts(text: DataFrame, delimiter: str, quote: str = '"') -> DataFrame:
    """n_fields, n: lines by number of fields; blank lines do not count."""
    return text.where(F.trim("value") != "").groupBy(field_count(F.col("value"), delimiter, quote).cast("int").alias("n_fields")).agg(F.count("*").alias("n"))


def dialect_fields(text: DataFrame, delimiters=DELIMITERS, quote: str = '"') -> DataFrame:
    """delimiter, n_fields, n for every candidate, from one pass over the lines."""
    each = F.array(*[F.struct(F.lit(d).alias("delimiter"), field_count(F.col("value"), d, quote).cast("int").alias("n_fields")) for d in delimiters])
    return text.where(F.trim("value") != "").select(F.inline(each)).groupBy("delimiter", "n_fields").agg(F.count("*").alias("n"))


def infer_quote(text: DataFrame) -> str:
    """The quote that encloses whole fields in most lines; the double quote if neither does."""
    marks = "".join("\\" + d if d == "|" else d for d in DELIMITERS)
    whole = lambda q: F.count_if(F.col("value").rlike(f"(?:^|[{marks}]){q}[^{q}]*{q}(?:$|[{marks}])"))
    n = text.agg(*[whole(q).alias(k) for k, q in (("double", '"'), ("single", "'"))]).first()
    return "'" if n.single > n.double else '"'


#: Characters that may begin a comment line.
COMMENTS = ("#",)


def infer_escape(text: DataFrame, quote: str) -> str:
    """A backslash, if more lines have one before a quote than have a doubled quote inside a field; else the quote."""
    marks = "".join("\\" + d if d == "|" else d for d in DELIMITERS)
    doubled = rf"(?<![{marks}]){quote}{quote}(?![{marks}]|$)"
    n = text.agg(F.count_if(F.col("value").contains("\\" + quote)).alias("back"), F.count_if(F.col("value").rlike(f"^.+{doubled}")).alias("twice")).first()
    return "\\" if n.back > n.twice else quote


def infer_dialect(spark: SparkSession, path: str, sample: int = SAMPLE_ROWS) -> Dialect:
    """Quote, escape, delimiter, lines to skip, comments and header, from the first lines (of a folder: of its first file).

    The delimiter is the one whose most frequent field count above one covers most lines. Lines before the first one with
    that many fields are a preamble, if nearly all lines from there on have that many; a single line of another number is
    a header if it looks like one and the next does not. Marked lines behind these that do not fit are comments. The
    first line that is left is a header if it looks like one.
    """
    first = next((m.path for m in members(spark, path) if m.length), path)
    lines_of = first_lines(spark, first, sample)
    quote = infer_quote(lines_of)
    escape = infer_escape(lines_of, quote)
    text = lines_of if escape == quote else lines_of.withColumn("value", F.regexp_replace("value", r"\\.", ""))  # escaped marks are no marks
    counts = [r for r in dialect_fields(text, quote=quote).collect() if r.n_fields > 1]
    best = max(counts, key=lambda r: (r.n, r.n_fields, -DELIMITERS.index(r.delimiter)), default=None)
    d = Dialect(delimiter=best.delimiter if best else ",", quote=quote, escape=escape)
    d = replace(d, skip=_preamble(text, d, best.n_fields) if best else 0)
    behind = text.where(F.col("line_no") >= d.skip)
    if best:
        fits = field_count(F.col("value"), d.delimiter, d.quote).cast("int") == best.n_fields
        marked = {c: behind.where(F.col("value").startswith(c) & ~fits) for c in COMMENTS}
        d = replace(d, comment=next((c for c, rows in marked.items() if not rows.limit(1).isEmpty()), None))
        behind = behind.where(~F.col("value").startswith(d.comment)) if d.comment else behind
    return replace(d, header=_has_header(behind, d))


def _preamble(text: DataFrame, d: Dialect, n_fields: int, least: float = 0.9) -> int:
    quotes = F.char_length("value") - F.char_length(F.replace(F.col("value"), F.lit(d.quote), F.lit("")))
    # a line with an odd number of quotes is a part of a row, as a quoted field holds a line break
    rows = text.where(quotes % 2 == 0).select("line_no", (field_count(F.col("value"), d.delimiter, d.quote).cast("int") == n_fields).alias("fits"), (F.trim("value") == "").alias("blank"))
    first = rows.where("fits and not blank").agg(F.min("line_no")).first()[0]
    if not first:
        return 0
    above = rows.where((F.col("line_no") < first) & ~F.col("blank")).limit(2).collect()
    if len(above) == 1:  # one line of another number of fields: a header, unless what is below it is one
        heads = [_looks_like_header(_split(text.where(F.col("line_no") == n).first().value, d)) for n in (above[0].line_no, first)]
        if heads == [True, False]:
            return 0
    behind = rows.where((F.col("line_no") >= first) & ~F.col("blank")).agg(F.count_if("fits").alias("k"), F.count("*").alias("n")).first()
    return int(first) if behind.k > 1 and behind.k >= least * behind.n else 0


def _split(value: str, d: Dialect) -> list[str]:
    import csv

    return next(csv.reader([value], delimiter=d.delimiter, quotechar=d.quote), [])


def _has_header(text: DataFrame, d: Dialect) -> bool:
    first = text.orderBy("line_no").first()
    return bool(first) and _looks_like_header(_split(first.value, d), 1)


def _looks_like_header(names: list[str], least: int = 2) -> bool:
    """Distinct names, none of them blank, a number or a date."""
    import re

    plain = [n for n in names if n.strip()]
    return len(names) >= least and len(set(names)) == len(names) == len(plain) and not any(re.match(p, n) for n in names for p in (NUMBER, DATE, TIMESTAMP))


def blocks_of(spark: SparkSession, path: str | list[str], d: Dialect) -> Blocks:
    return quoted_lines(spark, [path] if isinstance(path, str) else path, d.delimiter, d.quote, d.escape, d.comment, d.skip)


def field_count_report(spark: SparkSession, path: str, d: Dialect | None = None) -> DataFrame:
    """One row: n_lines, modal_fields, n_ragged (rows with another number of fields) and max_fields; a header is a row."""
    d = d or infer_dialect(spark, path)
    return ragged(blocks_of(spark, path, d).records(), d)


def ragged(text: DataFrame, d: Dialect) -> DataFrame:
    c = field_counts(text, d.delimiter, d.quote)
    return c.agg(
        F.sum("n").alias("n_lines"),
        F.max_by("n_fields", F.struct("n", -F.col("n_fields"))).alias("modal_fields"),
        (F.sum("n") - F.max("n")).alias("n_ragged"),
        F.max("n_fields").alias("max_fields"),
    )


def _options(d: Dialect, **more) -> dict:
    out = {"sep": d.delimiter, "quote": d.quote, "escape": d.escape, "nullValue": NO_TEXT, "encoding": "UTF-8", "mode": "PERMISSIVE"}
    if d.comment:
        out["comment"] = d.comment
    return out | more


def header_names(blocks: Blocks, d: Dialect, width: int | None = None, f: int | None = None) -> list[str]:
    """Names by the header of the first file, or of file f; columns beyond it are numbered."""
    heads = blocks.heads() if f is None else blocks.heads().where(F.col("f") == f)
    first = heads.orderBy("filename").first()
    text = first.head if first else None
    if text and blocks.scan.step(text.encode(), 0)[0]:  # a name holds a line break
        text = blocks.records().where(F.col("f") == first.f).orderBy("line_no").first().value
    fields = _split(text.removeprefix("\ufeff").removesuffix("\r"), d) if text else []
    names = [n if n else f"column{i}" for i, n in enumerate(fields)] if d.header else [f"column{i}" for i in range(len(fields))]
    seen: dict[str, int] = {}
    for i, n in enumerate(names):  # a repeated name gets a number, so that every column can be named
        if n in seen:
            names[i] = f"{n}_{seen[n]}"
        seen[n] = seen.get(n, 0) + 1
    return names + [f"column{i}" for i in range(len(names), width or 0)]


def read_all_text(spark: SparkSession, path: str | list[str], d: Dialect | None = None, null_padding: bool = False) -> DataFrame:
    """Every column as text: nothing cast, nothing lost. `,,` is NULL and `,"",` is the empty text.

    null_padding makes as many columns as the widest row has; without it the header's width holds. Skipped lines and the
    header go from every file. Files with quoted line breaks are read by as many tasks as other files.
    """
    d = d or infer_dialect(spark, path if isinstance(path, str) else path[0])
    blocks = blocks_of(spark, path, d)
    width = field_counts(blocks.records(), d.delimiter, d.quote).agg(F.max("n_fields")).first()[0] if null_padding else None
    names = header_names(blocks, d, width)
    if not names:
        return spark.createDataFrame([], T.StructType([T.StructField("column0", T.StringType())]))
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    if d.skip or blocks.broken() or blocks.scan.separator != b"\n":
        return _parsed(blocks.records(d.header), schema, d)
    return spark.read.schema(schema).options(**_options(d, header=d.header, enforceSchema=True)).csv(path)


def _parsed(records: DataFrame, schema: T.StructType, d: Dialect, *more: str) -> DataFrame:
    """Records as rows of the schema, and other columns of theirs."""
    plain = replace(d, comment=None)  # comments are gone, and a record may begin like one inside quotes
    return records.select(F.from_csv("value", _ddl(schema), _options(plain, multiLine=True)).alias("__r"), *more).select("__r.*", *more)


def _ddl(schema: T.StructType) -> str:
    return ", ".join(f"`{f.name.replace('`', '``')}` string" for f in schema.fields)


def preamble_report(spark: SparkSession, path: str, d: Dialect) -> DataFrame:
    """n_lines, n_skipped, n_rows: rows left behind skipped lines and the header of each file; skipped_all if none is."""
    blocks = blocks_of(spark, path, d)
    files = blocks.info().groupBy("f").agg(F.sum("n").alias("n"))
    lines_of = files.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n_lines"), F.coalesce(F.sum(F.least("n", F.lit(d.skip))), F.lit(0)).alias("n_skipped"))
    out = lines_of.join(blocks.records(d.header).agg(F.count("*").alias("n_rows")))  # two frames of one row each
    return out.withColumn("skipped_all", (F.col("n_rows") == 0) & (F.col("n_lines") > 1 + int(d.header)))


def _fits(c: Column, kind: str) -> Column:
    if kind == "bigint":
        return c.rlike(r"^\s*[+-]?[0-9]+\s*$") & F.trim(c).try_cast("bigint").isNotNull()
    if kind == "boolean":
        return F.lower(F.trim(c)).isin("true", "false")
    return cast_strict(c, T.DataType.fromDDL(kind)).isNotNull()


def infer_types(df: DataFrame, sample: int | None = SAMPLE_ROWS, least: float = 0.9) -> DataFrame:
    """position, column, type: the narrowest type that at least this share of the non-blank values has; text else.

    A value that is not of the type is then a bad cell, and does not turn the whole column into text.
    """
    rows = df.limit(sample) if sample else df
    there = [(i, n, F.trim(column(rows, n)) != "") for i, n in enumerate(df.columns)]
    aggs = [F.count_if(t).alias(f"c{i}_n") for i, _, t in there]
    aggs += [F.count_if(t & F.coalesce(_fits(column(rows, n), k), F.lit(False))).alias(f"c{i}_{k}") for i, n, t in there for k in CANDIDATES]
    wide = rows.agg(*aggs)

    def of(i: int) -> Column:
        out = F.lit("string")
        for k in reversed(CANDIDATES):
            out = F.when((F.col(f"c{i}_n") > 0) & (F.col(f"c{i}_{k}") >= least * F.col(f"c{i}_n")), k).otherwise(out)
        return out

    each = [F.struct(F.lit(i).alias("position"), F.lit(n).alias("column"), of(i).alias("type")) for i, n, _ in there]
    return wide.select(F.inline(F.array(*each)))


def inferred_schema(df: DataFrame, sample: int | None = SAMPLE_ROWS) -> T.StructType:
    found = {r.column: r.type for r in infer_types(df, sample).collect()}
    return T.StructType([T.StructField(n, T.DataType.fromDDL(found[n])) for n in df.columns])


def read_csv(
    spark: SparkSession, path: str | list[str], d: Dialect | None = None, schema: T.StructType | None = None, null_padding: bool = False
) -> DataFrame:
    """The typed rows that survive. The rows and cells that do not are what operators.quality counts on the text read."""
    text = read_all_text(spark, path, d, null_padding)
    return good_rows(text, schema or inferred_schema(text))


def read_folder_csv(spark: SparkSession, path: str, d: Dialect | None = None, typed: bool = True) -> DataFrame:
    """All members as one table by column name, with filename; skipped lines and the header go from every member.

    Members with the same header are read in one go. All of them are surveyed once.
    """
    names = [m.path for m in members(spark, path) if extension(m.path)[0] in TEXT]
    d = d or infer_dialect(spark, names[0])
    blocks = blocks_of(spark, names, d)
    in_lines = not d.skip and not blocks.broken() and blocks.scan.separator == b"\n"
    groups = blocks.heads().groupBy(F.col("head") if d.header else F.lit("")).agg(
        F.sort_array(F.collect_list(F.struct("filename", "f"))).alias("files")).orderBy("files").collect()  # file names
    out = None
    for g in groups:
        schema = T.StructType([T.StructField(n, T.StringType()) for n in header_names(blocks, d, f=g.files[0].f)])
        if in_lines:
            reader = spark.read.schema(schema).options(**_options(d, header=d.header, enforceSchema=True))
            part = reader.csv([x.filename for x in g.files]).select("*", F.col("_metadata.file_path").alias("filename"))
        else:
            own = blocks.names() if len(groups) == 1 else spark.createDataFrame([(x.f, x.filename) for x in g.files], "f bigint, filename string")
            records = blocks.records(d.header)
            part = _parsed(records.join(F.broadcast(own) if len(names) <= SENT else own, "f"), schema, d, "filename")
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
    if out is None:
        raise UnsupportedSource(f"No file of {path} has a row.")
    if not typed:
        return out
    schema = inferred_schema(out.drop("filename"))
    return good_rows(out, T.StructType([*schema.fields, T.StructField("filename", T.StringType())]))

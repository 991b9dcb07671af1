"""What a source is, in one frame: schema, rows, and what its typed read drops."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.model import Dialect, column, kind_of
from ..sources import text
from ..sources.detect import detect
from ..sources.tables import describe, open_source
from .quality import bad_row_count, uncastable_cells


def overview(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    """A row a column: position, column, type, kind, n_rows, basis, n_bad_rows, n_bad, notes and first_values.

    n_bad is NULL where nothing was scanned, because the source carries its types, and 0 where the scan found nothing.
    notes are sentences about the whole source; first_values are the column's values, as text, in the first n rows.
    """
    kind = detect(spark, path)
    if kind in ("csv", "folder_csv"):
        d = text.infer_dialect(spark, path) if kind == "csv" else None
        whole = text.read_folder_csv(spark, path, typed=False).drop("filename") if kind == "folder_csv" else text.read_all_text(spark, path, d)
        schema = text.inferred_schema(whole, sample=None)  # the scan of the next step, not a share of its rows
        cells = uncastable_cells(whole, schema)
        types = describe(spark.createDataFrame([], schema))
        rows = bad_row_count(whole, schema)
        out = types.join(cells.select("position", "n_bad"), "position").join(F.broadcast(rows))  # one row
        out = out.select("position", "column", "type", "kind", "n_rows", F.lit("counted on the text").alias("basis"), "n_bad_rows", "n_bad")
        return _described(out, notes(spark, path, d) if d else [], whole, n)
    spec, df = open_source(spark, path)
    count = df.agg(F.count("*").alias("n_rows"))
    basis = F.lit("row counts of the files" if "parquet" in spec.format else "counted")
    none = F.lit(None).cast("long")
    out = describe(df).join(F.broadcast(count)).select("position", "column", "type", "kind", "n_rows", basis.alias("basis"), none.alias("n_bad_rows"), none.alias("n_bad"))
    return _described(out, [], df, n)


def _described(out: DataFrame, said: list[str], df: DataFrame, n: int) -> DataFrame:
    """out with notes, and first_values of n rows of df, which are as many cells as the frame shows."""
    spark, first = out.sparkSession, df.limit(n).select([column(df, c).cast("string").alias(str(i)) if kind_of(df.schema[c].dataType) != "blob" else F.lit(None).cast("string").alias(str(i)) for i, c in enumerate(df.columns)]).collect()
    values = spark.createDataFrame([(i, [r[i] for r in first]) for i in range(len(df.columns))], "position int, first_values array<string>")
    return out.withColumn("notes", F.array(*[F.lit(x) for x in said]).cast("array<string>")).join(F.broadcast(values), "position")  # a row a column


def notes(spark: SparkSession, path: str, d: Dialect) -> list[str]:
    """What to know about a text file before trusting it: skipped lines, ragged lines, a missing header."""
    said, shape = [], text.field_count_report(spark, path, d).first()
    if d.skip:
        said.append(f"{d.skip} lines above the table are skipped.")
        if text.preamble_report(spark, path, d).first().skipped_all:
            said.append("No row is left behind the skipped lines; read again without skipping.")
    if shape.n_ragged:
        said.append(f"{shape.n_ragged} of {shape.n_lines} lines do not have {shape.modal_fields} fields; the widest has {shape.max_fields}. Read with null_padding to keep them whole.")
    if not d.header:
        said.append("The first line looks like data, so columns are named by position.")
    return said


def first_rows(spark: SparkSession, path: str, n: int = 20) -> DataFrame:
    return open_source(spark, path)[1].limit(n)

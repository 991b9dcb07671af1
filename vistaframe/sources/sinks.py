"""Export of a whole view, not one page of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..functions.model import ExportError
from .shared import exists

FORMATS = ("parquet", "csv", "tsv", "ndjson")


def export(df: DataFrame, dest: str, fmt: str, overwrite: bool = False) -> str:
    """Write df; an existing target is refused unless overwrite says so. A sorted frame keeps its order over the parts."""
    kind = fmt.lower()
    if kind not in FORMATS:
        raise ExportError(f"There is no export format {fmt!r}; pick one of {', '.join(FORMATS)}.")
    if not overwrite and exists(df.sparkSession, dest):
        raise ExportError(f"{dest} exists already.")
    writer = df.write.mode("overwrite" if overwrite else "errorifexists")
    if kind == "parquet":
        writer.option("compression", "zstd").parquet(dest)
    elif kind == "ndjson":
        writer.option("ignoreNullFields", "false").json(dest)
    else:
        writer.options(header=True, escape='"', sep="," if kind == "csv" else "\t").csv(dest)
    return dest


def export_sql(spark: SparkSession, sql: str, dest: str, fmt: str, overwrite: bool = False) -> str:
    """Write the result of a query, which must be one SELECT."""
    from ..plans.sqlbox import read_only_sql

    return export(read_only_sql(spark, sql), dest, fmt, overwrite)

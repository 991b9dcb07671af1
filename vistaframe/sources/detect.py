"""Which reader a path needs: layout of a folder, first bytes of a file, extension, first character."""

from __future__ import annotations

from pyspark.sql import SparkSession

from ..functions.model import UnsupportedSource
from .shared import exists, head, is_folder, members

# Extensions and first bytes that name a format.
PARQUET = ("parquet", "pq", "parq")
NDJSON = ("ndjson", "jsonl")
JSON = ("json",)
TEXT = ("csv", "tsv", "txt", "psv", "tab")
WORKBOOK = ("xlsx", "xlsm", "xls")
COMPRESSION = ("gz", "bz2", "zst", "zstd", "snappy", "lz4", "deflate")
MAGIC_PARQUET, MAGIC_OLE, MAGIC_ZIP = b"PAR1", b"\xd0\xcf\x11\xe0", b"PK\x03\x04"


def extension(path: str) -> tuple[str, str]:
    """(extension, compression): the extension under a compression suffix, both in lower case."""
    parts = path.rstrip("/").rsplit("/", 1)[-1].lower().split(".")
    packed = parts.pop() if len(parts) > 1 and parts[-1] in COMPRESSION else ""
    return (parts[-1] if len(parts) > 1 else ""), packed


def detect(spark: SparkSession, path: str) -> str:
    """log, folder_parquet, folder_csv, parquet, ndjson, json or csv; other sources are refused by name."""
    if is_folder(spark, path):
        if is_folder(spark, f"{path.rstrip('/')}/_delta_log"):
            return "log"
        kinds = {extension(m.path)[0] for m in members(spark, path)}
        for name, known in (("folder_parquet", PARQUET), ("folder_csv", TEXT)):
            if kinds & set(known):
                return name
        raise UnsupportedSource(f"{path} is a folder without Parquet or delimited text files.")
    if not exists(spark, path):
        raise UnsupportedSource(f"{path} was not found.")
    first, (ext, _) = head(spark, path), extension(path)
    if first.startswith(MAGIC_PARQUET) or ext in PARQUET:
        return "parquet"
    if first.startswith((MAGIC_OLE, MAGIC_ZIP)) or ext in WORKBOOK:
        raise UnsupportedSource(f"{path} is a workbook or an archive; export it as Parquet or CSV first.")
    if ext in NDJSON:
        return "ndjson"
    if ext in JSON:
        return "json"
    if ext in TEXT:
        return "csv"
    return "json" if first.lstrip()[:1] in (b"{", b"[") else "csv"

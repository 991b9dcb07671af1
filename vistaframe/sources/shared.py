"""Files through Hadoop's file systems, so that local folders and cluster stores look the same."""

from __future__ import annotations

import tempfile
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

_OWN: dict = {}


@dataclass(frozen=True)
class Member:
    path: str
    length: int
    modified: int


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it names none, a temporary folder, which is right for local mode only."""
    found = spark.conf.get("spark.checkpoint.dir", None) or _OWN.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        found = _OWN[spark.sparkContext.applicationId] = tempfile.mkdtemp(prefix="spark-shared-")
    return found.rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """df written once to the shared folder and read back."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def qualified(spark: SparkSession, path: str) -> str:
    """The full address of a path, as Spark's file listings write it."""
    fs, p = _fs(spark, path)
    return fs.makeQualified(p).toString().rstrip("/")


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def is_folder(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p) and fs.getFileStatus(p).isDirectory()


def members(spark: SparkSession, path: str) -> list[Member]:
    """The data files under a path, in path order; names that start with _ or . are no data."""
    fs, p = _fs(spark, path)
    found, it = [], fs.listFiles(p, True)
    base = fs.makeQualified(p).toString().rstrip("/")
    while it.hasNext():
        s = it.next()
        name = s.getPath().toString()
        inside = name[len(base):].split("/") if name.startswith(base) else [s.getPath().getName()]
        if not any(x.startswith(("_", ".")) for x in inside if x):
            found.append(Member(name, s.getLen(), s.getModificationTime()))
    return sorted(found, key=lambda m: m.path)


def head(spark: SparkSession, path: str, n: int = 8) -> bytes:
    fs, p = _fs(spark, path)
    stream, out = fs.open(p), bytearray()
    try:
        while len(out) < n and (b := stream.read()) >= 0:
            out.append(b)
    finally:
        stream.close()
    return bytes(out)


def read_range(spark: SparkSession, path: str, start: int, n: int) -> bytes:
    """n bytes of a file from start, fewer at its end; for small samples, as they pass through the driver."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        stream.seek(start)
        n = min(n, fs.getFileStatus(p).getLen() - start)
        return bytes(spark._jvm.org.apache.commons.io.IOUtils.toByteArray(stream, n)) if n > 0 else b""
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A small file of metadata."""
    fs, p = _fs(spark, path)
    stream = fs.create(p, False)
    try:
        stream.write(bytearray(text.encode("utf-8")))
    finally:
        stream.close()


def put_if_absent(spark: SparkSession, path: str, text: str) -> bool:
    """A small file that appears whole under its name, or, if that is taken, not at all."""
    fs, p = _fs(spark, path)
    # written beside the folder: who lists it must not meet files that are about to go
    fs.mkdirs(p.getParent())
    hidden = spark._jvm.org.apache.hadoop.fs.Path(f"{p.getParent().toString()}.new", uuid.uuid4().hex)
    write_text(spark, hidden.toString(), text)
    hadoop = spark._jvm.org.apache.hadoop.fs
    files = hadoop.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration())
    none = spark.sparkContext._gateway.new_array(getattr(hadoop, "Options$Rename"), 0)
    try:
        files.rename(fs.makeQualified(hidden), fs.makeQualified(p), none)
        return True
    except Exception:
        if not fs.exists(p):
            raise
        return False
    finally:
        fs.delete(hidden, False)


def moved(spark: SparkSession, path: str, to: str) -> str:
    """A file or folder under another name, in the same file system; the folders above it are made."""
    fs, p = _fs(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(to)
    fs.mkdirs(target.getParent())
    if not fs.rename(p, target):
        raise OSError(f"{path} could not be moved to {to}.")
    return to


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)

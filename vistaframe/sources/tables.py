"""Readers of Parquet, JSON and log-based tables, and the one that picks a reader."""

from __future__ import annotations

import json
import re
from functools import reduce
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.model import SourceSpec, UnsupportedSource, column, kind_of
from . import text
from .blocks import Blocks, Elements
from .detect import PARQUET, detect, extension
from .shared import head, members, qualified
from .vectors import deleted_rows


def describe(df: DataFrame) -> DataFrame:
    """position, column, type, kind in the order of the table."""
    rows = [(i, f.name, f.dataType.simpleString(), kind_of(f.dataType)) for i, f in enumerate(df.schema.fields)]
    return df.sparkSession.createDataFrame(rows, "position int, column string, type string, kind string")


def read_parquet(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def _keys(path: str, base: str) -> tuple[str, ...]:
    return tuple(p.split("=", 1)[0] for p in path[len(base):].split("/")[:-1] if "=" in p)


def read_folder_parquet(spark: SparkSession, path: str, merge_schema: bool = True) -> DataFrame:
    """All members as one table by column name, with filename; folder keys only if every member has the same ones."""
    found = [m.path for m in members(spark, path) if extension(m.path)[0] in PARQUET]
    if not found:
        raise UnsupportedSource(f"{path} has no Parquet files.")
    base = path.split("://")[-1].split(":", 1)[-1].rstrip("/")
    layouts = {_keys(p[p.find(base) :], base) for p in found}
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    if len(layouts) > 1:
        reader = reader.option("recursiveFileLookup", "true")
    elif layouts == {()} and any("/" in p[p.find(base) + len(base) + 1 :] for p in found):
        reader = reader.option("recursiveFileLookup", "true")
    df = reader.parquet(path)
    return df.select("*", F.col("_metadata.file_path").alias("filename"))


def read_json(spark: SparkSession, path: str, schema: T.StructType | str | None = None) -> DataFrame:
    """One object a line, or one array of objects a file, whose elements are found and parsed by many tasks.

    The arrays of a folder are read in one go; its files are looked at one by one if the first that is not empty holds an array.
    """
    files = [m.path for m in members(spark, path) if m.length]
    reader = spark.read.schema(schema) if schema else spark.read
    if not files or extension(path)[0] in ("ndjson", "jsonl") or not _json_head(spark, files[0]).startswith(b"["):
        return reader.json(path)
    heads = {f: _json_head(spark, f) for f in files}
    lines = [f for f, h in heads.items() if not h.startswith(b"[")]
    arrays = [f for f, h in heads.items() if h.startswith(b"[") and h[1:].lstrip()[:1] == b"{"]
    documents = [f for f, h in heads.items() if h.startswith(b"[") and h[1:].lstrip()[:1] not in (b"{", b"]")]  # no objects: a document for one parser
    parts = []
    if arrays:
        found = Blocks(spark, arrays, Elements()).records().select("value")
        jvm = spark._jvm.org.apache.spark.sql
        parts.append(DataFrame(reader._jreader.json(getattr(found._jdf, "as")(jvm.Encoders.STRING())), spark))
    if lines:
        parts.append(reader.json(lines))
    if documents or not parts:  # empty arrays count as documents where nothing else is there
        parts.append(reader.option("multiLine", True).json(documents or files))
    return reduce(lambda x, y: x.unionByName(y, allowMissingColumns=True), parts)


def _json_head(spark: SparkSession, file: str) -> bytes:
    return head(spark, file, 64).removeprefix(b"\xef\xbb\xbf").lstrip()


#: Log-based tables of up to this many files send the files' keys to every task.
BROADCAST_FILES = 200_000
_VECTOR = "struct<storageType: string, pathOrInlineDv: string, offset: int, sizeInBytes: int, cardinality: bigint>"
_ACTION = f"struct<path: string, partitionValues: map<string, string>, deletionVector: {_VECTOR}>"
_LOG = f"add {_ACTION}, remove struct<path: string>, metaData struct<schemaString: string, partitionColumns: array<string>, configuration: map<string, string>>"


def _log_files(spark: SparkSession, log: str) -> tuple[set[int], dict[int, list[str]]]:
    """Versions that have a JSON file, and the files of every checkpoint whose parts are all there, from one listing."""
    versions, parts = set(), {}
    for name in (m.path.rsplit("/", 1)[-1] for m in members(spark, log)):
        if m := re.fullmatch(r"(\d{20})\.json", name):
            versions.add(int(m[1]))
        elif m := re.fullmatch(r"(\d{20})\.checkpoint(?:\.(\d{10})\.(\d{10})\.parquet|\.([0-9a-f-]{36})\.(?:parquet|json)|\.parquet)", name):
            parts.setdefault((int(m[1]), int(m[3] or 1), m[4] or ""), []).append(f"{log}/{name}")
    return versions, {v: sorted(names) for (v, n, _), names in sorted(parts.items()) if len(names) == n}


def _log(spark: SparkSession, path: str, version: int | None) -> DataFrame:
    """Actions with their version: the newest checkpoint not above the version, and all JSON files behind it.

    A version whose log has gaps is refused: rows would be missing without a word.
    """
    log = f"{path.rstrip('/')}/_delta_log"
    versions, checkpoints = _log_files(spark, log)
    known = versions | set(checkpoints)
    if not known or (version is not None and not 0 <= version <= max(known)):
        raise UnsupportedSource(f"{path} has no version {version if version is not None else ''}.".replace(" .", "."))
    top = max(known) if version is None else version
    start = max((v for v in checkpoints if v <= top), default=None)
    missing = set(range(0 if start is None else start + 1, top + 1)) - versions
    if missing:
        raise UnsupportedSource(f"{path} has no complete log of version {top}: the file of version {min(missing)} is gone.")
    number = F.regexp_extract(F.col("_metadata.file_name"), r"^(\d{20})\.json$", 1)
    actions = spark.read.schema(_LOG).option("pathGlobFilter", "*.json").json(log).select("*", number.alias("n")).where("n <> ''")
    actions = actions.select("*", F.col("n").cast("long").alias("v")).drop("n").where(F.col("v").between(-1 if start is None else start + 1, top))
    if start is not None:
        if checkpoints[start][0].endswith(".json"):
            old = spark.read.schema(f"{_LOG}, sidecar struct<path: string>").json(checkpoints[start])
        else:
            old = spark.read.parquet(*checkpoints[start])
        kept = [_actions(old)]
        if "sidecar" in old.columns:  # file names, which Spark's readers need on the driver
            beside = [r.path for r in old.where("sidecar is not null").select("sidecar.path").collect()]
            if beside:
                kept.append(_actions(spark.read.parquet(*[p if "://" in p or p.startswith("/") else f"{log}/_sidecars/{p}" for p in beside])))
        for part in kept:
            actions = part.withColumn("v", F.lit(start).cast("long")).unionByName(actions)
    return actions


def _actions(df: DataFrame) -> DataFrame:
    """A checkpoint's actions, cut to the fields that matter."""
    wanted = T.StructType.fromDDL(_LOG)
    return df.select(*[_narrow(df, f.name, df.schema[f.name].dataType, f.dataType).alias(f.name) if f.name in df.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in wanted.fields])


def _narrow(df: DataFrame, name: str, has: T.DataType, wanted: T.DataType) -> Column:
    if not isinstance(wanted, T.StructType):
        return F.col(name).cast(wanted)
    parts = [
        (_narrow(df, f"{name}.{x.name}", has[x.name].dataType, x.dataType) if x.name in has.names else F.lit(None).cast(x.dataType)).alias(x.name) for x in wanted.fields
    ]
    return F.when(F.col(name).isNotNull(), F.struct(*parts))


#: Up to this many deleted rows, which the log counts, are sent to every task; beyond it they are joined by a shuffle.
BROADCAST_DELETED = 1_000_000


def read_log_table(spark: SparkSession, path: str, version: int | None = None) -> DataFrame:
    """The live rows of a log-based table, now or as of a version; files that the log removed are not read, and rows that
    a deletion vector marks are left out.

    All files are one scan, those with vectors another. Keys come from the folders' names where these say what the log
    says, so filters on keys prune files; else from the log, joined by file.
    """
    actions = _log(spark, path, version)
    meta = actions.where("metaData is not null").agg(F.max_by("metaData", "v").alias("m")).first().m
    if meta and (meta.configuration or {}).get("delta.columnMapping.mode", "none") != "none":
        raise UnsupportedSource(f"{path} maps its columns by id; this reader would misname them.")
    files = actions.where("add is not null or remove is not null").select(
        F.coalesce("add.path", "remove.path").alias("path"), F.col("add").isNotNull().alias("live"), F.col("add.partitionValues").alias("keys"),
        F.col("add.deletionVector").alias("vector"), (F.col("v") * 2 + F.col("add").isNotNull().cast("int")).alias("at"),
    )
    last = files.groupBy("path").agg(F.max_by(F.struct("live", "keys", "vector"), "at").alias("x")).select("path", "x.*").where("live")
    live = last.collect()  # file names, which Spark's readers need on the driver
    schema = T.StructType.fromJson(json.loads(meta.schemaString)) if meta and meta.schemaString else None
    by_key = list(meta.partitionColumns or []) if meta else []
    root = qualified(spark, path)
    if not live:
        return spark.createDataFrame([], schema or T.StructType())
    whole, cut = ([r for r in live if (r.vector is not None) == has] for has in (False, True))
    out = _scan(spark, root, whole, schema, by_key) if whole else None
    if cut:
        rows = _scan(spark, root, cut, schema, by_key, numbered=True)
        gone = deleted_rows(spark, [(_plain_name(_full(root, r.path)), r.vector) for r in cut], root)
        gone = gone.select(F.col("name").alias("__name"), F.col("row").alias("__row"))
        known = sum(r.vector.cardinality if r.vector.cardinality is not None else BROADCAST_DELETED + 1 for r in cut)
        kept = rows.join(F.broadcast(gone) if known <= BROADCAST_DELETED else gone, ["__name", "__row"], "left_anti").drop("__name", "__row")
        out = kept if out is None else out.unionByName(kept)
    return out


def _full(root: str, path: str) -> str:
    p = unquote(path)
    return p if "://" in p or p.startswith("/") else f"{root}/{p}"


def _plain_name(name: str) -> str:
    return re.sub("^([A-Za-z][A-Za-z0-9+.-]*):/+", r"\1:/", name)


def _scan(spark: SparkSession, root: str, live: list, schema: T.StructType | None, by_key: list[str], numbered: bool = False) -> DataFrame:
    """Rows of live files with their keys; numbered: with __name and __row, the file and the row's number in it."""
    names = [_full(root, r.path) for r in live]
    reader = spark.read.schema(schema) if schema else spark.read.option("mergeSchema", "true")
    from_file = _file_name(F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))).alias("__name")
    more = [from_file, F.col("_metadata.row_index").alias("__row")] if numbered else []
    if not by_key:
        return reader.parquet(*names).select("*", *more)
    if all(_folder_keys(r.path, by_key) == {k: (r["keys"] or {}).get(k) for k in by_key} for r in live):
        return reader.option("basePath", root).parquet(*names).select(*[F.col("`" + n.replace("`", "``") + "`") for n in schema.names], *more)
    keys = spark.createDataFrame([(n, r["keys"] or {}) for n, r in zip(names, live)], "__name string, __keys map<string, string>")
    keys = keys.withColumn("__name", _file_name(F.col("__name")))
    df = spark.read.schema(T.StructType([f for f in schema.fields if f.name not in by_key])).parquet(*names)
    df = df.select("*", *(more or [from_file]))
    small = len(names) <= BROADCAST_FILES
    joined = df.join(F.broadcast(keys) if small else keys, "__name")
    own = [F.col("__keys")[f.name].cast(f.dataType).alias(f.name) if f.name in by_key else column(joined, f.name) for f in schema.fields]
    return joined.select(*own, *[m for m in ("__name", "__row") if numbered])


def _file_name(name: Column) -> Column:
    """A file's address with one slash behind its scheme."""
    return F.regexp_replace(name, "^([A-Za-z][A-Za-z0-9+.-]*):/+", "$1:/")


def _folder_keys(path: str, by_key: list[str]) -> dict[str, str | None]:
    """What a file's folders say of the keys: key=value, escaped; nothing if the folders at the end are not these keys."""
    folders = unquote(path).split("/")[:-1][-len(by_key) :]
    pairs = [tuple(map(unquote, f.split("=", 1))) for f in folders if "=" in f]
    if [k for k, _ in pairs] != by_key:
        return {}
    return {k: None if v == "__HIVE_DEFAULT_PARTITION__" else v for k, v in pairs}


def open_source(spark: SparkSession, path: str, **options) -> tuple[SourceSpec, DataFrame]:
    """The reader that fits a path, and its frame. `version` is for log-based tables alone."""
    kind = detect(spark, path)
    if "version" in options and kind != "log":
        raise UnsupportedSource("Only log-based tables have versions.")
    readers = {
        "log": read_log_table, "folder_parquet": read_folder_parquet, "folder_csv": text.read_folder_csv, "parquet": read_parquet,
        "ndjson": read_json, "json": read_json, "csv": text.read_csv,
    }
    return SourceSpec(path, kind, options), readers[kind](spark, path, **options)


def exact_count(spark: SparkSession, spec: SourceSpec) -> int:
    """Physical rows. Text is counted on the all-text read: a typed read leaves rows out."""
    if spec.format == "csv":
        return text.read_all_text(spark, spec.path, spec.options.get("d")).count()
    if spec.format == "folder_csv":
        return text.read_folder_csv(spark, spec.path, typed=False).count()
    return open_source(spark, spec.path, **spec.options)[1].count()


def source_members(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """path, modified, length of every member of a source, or of several, listed without reading content."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.select("path", F.col("modificationTime").alias("modified"), "length")


def tokens(listed: DataFrame, *by: str) -> DataFrame:
    """n_members, bytes and token of members (path, modified, length) by group; sums do not depend on the order."""
    h = F.xxhash64("path", "modified", "length")
    sums = listed.groupBy(*by).agg(
        F.count("*").alias("n_members"), F.coalesce(F.sum("length"), F.lit(0)).alias("bytes"),
        F.bit_xor(h).alias("x"), F.sum(h.cast("decimal(38,0)")).alias("s"),
    )
    return sums.select(*by, "n_members", "bytes", F.sha2(F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("n_members", "bytes", "x", "s")]), 256).alias("token"))


def source_token(spark: SparkSession, path: str) -> DataFrame:
    """One row: n_members, bytes and a token that changes when any member does."""
    return tokens(source_members(spark, path))


def estimate_rows(spark: SparkSession, path: str, members_read: int = 3) -> DataFrame:
    """rows, confidence (exact, high or low) and basis: bytes a line of some members, carried to all bytes.

    A quote makes the estimate low, as quoted line breaks count as lines; reading every member makes it exact.
    """
    found = members(spark, path)
    total = sum(m.length for m in found)
    step = max(1, len(found) // max(1, members_read))
    some = found[::step][:members_read]
    packed = any(extension(m.path)[1] for m in found)
    schema = "rows long, confidence string, basis string"
    if not total:
        return spark.createDataFrame([(0, "exact", "no data")], schema)
    seen = spark.read.text([m.path for m in some]).agg(
        F.count("*").alias("n"), F.coalesce(F.max(F.col("value").contains('"').cast("int")), F.lit(0)).alias("quoted")
    ).first()
    read = sum(m.length for m in some)
    rows = seen.n if len(some) == len(found) else int(total / (read / max(1, seen.n)))
    sure = "low" if seen.quoted or packed else "exact" if len(some) == len(found) else "high"
    basis = f"{seen.n} lines in {read} of {total} bytes" + ("; quotes seen" if seen.quoted else "") + ("; compressed" if packed else "")
    return spark.createDataFrame([(rows, sure, basis)], schema)

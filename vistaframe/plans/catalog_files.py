"""Queries that write a given table in some form and read it back: sources, sinks, snapshots."""

from __future__ import annotations

import json
import uuid

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.model import Dialect
from ..operators import partials
from ..operators.overview import overview as overview_of
from ..sources import estimates, sinks, snapshots, tables, text, vectors
from ..sources.shared import fresh_path, members, moved, write_text
from .catalog_tables import _dirty
from .dirty import ANY_BAD_SQL, BAD_SQL, DIRTY_SCHEMA, dirty_orders, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def keep(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return keep


#: Bytes of the table that one array of scan_json_array holds, so that arrays grow in number, not in length.
ARRAY = 8 << 20
_EVENTS = "event_id, user_id, event_type, value"
_CUSTOMER = "c_custkey, c_name, c_nationkey, c_mktsegment"
COMMA = Dialect()


def _customer(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment")


def _csv(df: DataFrame, name: str, **options) -> str:
    path = fresh_path(df.sparkSession, name)
    df.write.options(header=True, escape='"', **options).csv(path)
    return path


@query("SELECT *, 'parquet' AS format FROM orders")
def src_open(spark, sf_dir):
    spec, df = tables.open_source(spark, f"{sf_dir}/orders.parquet")
    return df.withColumn("format", F.lit(spec.format))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity > 40")
def scan_parquet(spark, sf_dir):
    return tables.read_parquet(spark, f"{sf_dir}/lineitem.parquet").where("l_quantity > 40").select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT o_orderkey, o_custkey, o_orderpriority, o_orderstatus FROM orders")
def scan_folder_parquet(spark, sf_dir):
    path = fresh_path(spark, "folder")
    table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus").write.partitionBy("o_orderstatus").parquet(path)
    out = tables.read_folder_parquet(spark, path)
    return out.where(F.col("filename").endswith(".parquet")).drop("filename")


@query(_dirty(f"SELECT o_orderkey, status, TRY_CAST(custkey_raw AS BIGINT) AS custkey_raw FROM dirty_orders WHERE NOT {ANY_BAD_SQL}"))
def scan_csv(spark, sf_dir):
    path = _csv(dirty_orders(spark, sf_dir), "dirty-csv")
    return text.read_csv(spark, path, COMMA, DIRTY_SCHEMA).select("o_orderkey", "status", "custkey_raw")


@query(f"SELECT {_CUSTOMER}, NULL AS extra FROM customer WHERE c_nationkey < 10 UNION ALL SELECT {_CUSTOMER}, 'x' || c_custkey AS extra FROM customer WHERE c_nationkey >= 10")
def scan_folder_csv(spark, sf_dir):
    path, c = fresh_path(spark, "folder-csv"), _customer(spark, sf_dir)
    c.where("c_nationkey < 10").write.options(header=True).csv(f"{path}/a")
    c.where("c_nationkey >= 10").select(F.concat(F.lit("x"), F.col("c_custkey").cast("string")).alias("extra"), "*").write.options(header=True).csv(f"{path}/b")
    out = text.read_folder_csv(spark, path, COMMA, typed=False)
    return out.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", F.col("c_nationkey").cast("int").alias("c_nationkey"), "c_mktsegment", "extra")


@query(f"SELECT {_CUSTOMER} FROM customer")
def scan_csv_gz(spark, sf_dir):
    path, c = fresh_path(spark, "gz"), _customer(spark, sf_dir)
    c.write.options(header=True, compression="gzip").csv(path)
    return text.read_csv(spark, path, COMMA, c.schema)


@query(f"SELECT {_EVENTS} FROM events")
def scan_json(spark, sf_dir):
    path = fresh_path(spark, "json")
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value")
    df.write.json(path)
    return tables.read_json(spark, path, df.schema).select("event_id", "user_id", "event_type", "value")


def _log_table(spark: SparkSession, sf_dir: str) -> str:
    """orders as a log-based table: version 0 adds two thirds of the rows, version 1 removes one third and adds the last."""
    path, df = fresh_path(spark, "log"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    df.withColumn("third", F.col("o_orderkey") % 3).write.partitionBy("third").parquet(f"{path}/data")
    files: dict[str, list] = {"0": [], "1": [], "2": []}
    for m in members(spark, f"{path}/data"):
        files[m.path.split("/third=")[1][0]].append((m.path[m.path.index("data/third="):].replace("=", "%3D"), m.length))
    add = lambda k: [json.dumps({"add": {"path": p, "partitionValues": {}, "size": n, "modificationTime": 0, "dataChange": True}}) for p, n in files[k]]
    gone = [json.dumps({"remove": {"path": p, "deletionTimestamp": 0, "dataChange": True}}) for p, _ in files["0"]]
    meta = json.dumps({"metaData": {"id": "t", "format": {"provider": "parquet"}, "schemaString": df.schema.json(), "partitionColumns": [], "configuration": {}}})
    log = f"{path}/_delta_log"
    write_text(spark, f"{log}/{0:020d}.json", "\n".join([meta, *add("0"), *add("1")]) + "\n")
    write_text(spark, f"{log}/{1:020d}.json", "\n".join([*gone, *add("2")]) + "\n")
    return path


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def scan_log_table(spark, sf_dir):
    return tables.open_source(spark, _log_table(spark, sf_dir))[1]


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 2")
def scan_log_asof(spark, sf_dir):
    return tables.open_source(spark, _log_table(spark, sf_dir), version=0)[1]


def _order_files(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, list[str], T.StructType]:
    """Some of orders' columns as a few data files of a table, their paths in it, and the schema."""
    path, df = fresh_path(spark, name), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    df.withColumn("third", F.col("o_orderkey") % 3).write.partitionBy("third").parquet(f"{path}/data")
    return path, [m.path[m.path.index("data/third="):] for m in members(spark, f"{path}/data")], df.schema


def _actions(files: list[str], **more) -> list[dict]:
    return [{"add": {"path": f.replace("=", "%3D"), "partitionValues": {}, "size": 1, "modificationTime": 0, "dataChange": True} | {k: v[f] for k, v in more.items() if f in v}} for f in files]


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 5 <> 0 OR o_orderkey % 3 = 1")
def scan_log_vectors(spark, sf_dir):
    """A table whose second version marks rows of two thirds of its files as deleted, by vectors that Spark's tasks write."""
    path, files, schema = _order_files(spark, sf_dir, "log-vectors")
    place = [F.regexp_extract("_metadata.file_path", "third=.*$", 0).alias("file"), F.col("_metadata.row_index").alias("row")]
    gone = spark.read.parquet(f"{path}/data").select("o_orderkey", "third", *place).where("o_orderkey % 5 = 0 and third <> 1")

    def encode(rows):  # the rows of one file
        data = vectors.encoded(np.sort(rows["row"].to_numpy()))
        return pd.DataFrame({"file": [rows["file"][0]], "text": [vectors.as_text(data)], "size": [len(data)], "n": [len(rows)]})

    marks = gone.groupBy("file").applyInPandas(encode, "file string, text string, size int, n long").collect()  # a row a file
    of = {f"data/{r.file}": {"storageType": "i", "pathOrInlineDv": r.text, "sizeInBytes": r.size, "cardinality": r.n} for r in marks}
    meta = {"metaData": {"id": "t", "format": {"provider": "parquet"}, "schemaString": schema.json(), "partitionColumns": [], "configuration": {}}}
    removed = [{"remove": {"path": f.replace("=", "%3D"), "dataChange": True}} for f in of]
    for v, rows in enumerate(([meta, *_actions(files)], [*removed, *_actions(list(of), deletionVector=of)])):
        write_text(spark, f"{path}/_delta_log/{v:020d}.json", "\n".join(map(json.dumps, rows)) + "\n")
    return tables.read_log_table(spark, path)


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey % 3 <> 0")
def scan_log_sidecars(spark, sf_dir):
    """A table known from a checkpoint with sidecars, and one version behind it that removes a third."""
    path, files, schema = _order_files(spark, sf_dir, "log-sidecars")
    meta = {"metaData": {"id": "t", "format": {"provider": "parquet"}, "schemaString": schema.json(), "partitionColumns": [], "configuration": {}}}
    log = f"{path}/_delta_log"
    adds = spark.createDataFrame([(json.dumps(x),) for x in _actions(files)], "value string")
    adds.select(F.from_json("value", "add struct<path: string, partitionValues: map<string, string>, size: long>").alias("x")).select("x.*").write.parquet(f"{log}/_sidecars")
    beside = [{"sidecar": {"path": m.path.rsplit("/", 1)[-1], "sizeInBytes": m.length}} for m in members(spark, f"{log}/_sidecars")]
    write_text(spark, f"{log}/{4:020d}.checkpoint.{uuid.uuid4()}.json", "\n".join(map(json.dumps, [meta, *beside])) + "\n")
    gone = [{"remove": {"path": f.replace("=", "%3D"), "dataChange": True}} for f in files if "third=0" in f]
    write_text(spark, f"{log}/{5:020d}.json", "\n".join(map(json.dumps, gone)) + "\n")
    return tables.read_log_table(spark, path)


@query(_dirty("SELECT CAST(o_orderkey AS VARCHAR) AS o_orderkey, status, custkey_raw, orderdate_raw, price_raw FROM dirty_orders"))
def scan_all_text(spark, sf_dir):
    return text.read_all_text(spark, _csv(dirty_orders(spark, sf_dir), "all-text"), COMMA)


@query("""SELECT d AS delimiter, CAST(CASE WHEN d = ';' THEN 4 WHEN d = ',' THEN 1 + length(c_name) - length(replace(c_name, ',', '')) ELSE 1 END AS INTEGER) AS n_fields, count(*) AS n
FROM customer, (VALUES (','), (';'), (chr(9)), ('|')) t(d) GROUP BY 1, 2""")
def dialect_fields(spark, sf_dir):
    path = fresh_path(spark, "semi")
    _customer(spark, sf_dir).write.options(sep=";").csv(path)
    return text.dialect_fields(text.lines(spark, path))


def _ragged(spark: SparkSession, sf_dir: str) -> str:
    """Text with 4 fields a line, 2 where the key is divisible by 97, 6 where by 101."""
    path, k = fresh_path(spark, "ragged"), F.col("c_custkey")
    s = [k.cast("string"), F.col("c_nationkey").cast("string"), F.col("c_mktsegment"), F.lit("end")]
    line = F.when(k % 97 == 0, F.concat_ws(",", *s[:2])).when(k % 101 == 0, F.concat_ws(",", *s, F.lit("a"), F.lit("b"))).otherwise(F.concat_ws(",", *s))
    table(spark, sf_dir, "customer").select(line.alias("value")).write.text(path)
    return path


@query("""SELECT count(*) AS n_lines, 4 AS modal_fields, count(*) FILTER (WHERE c_custkey % 97 = 0 OR c_custkey % 101 = 0) AS n_ragged,
  CASE WHEN count(*) FILTER (WHERE c_custkey % 101 = 0 AND c_custkey % 97 <> 0) > 0 THEN 6 ELSE 4 END AS max_fields FROM customer""")
def ragged_report(spark, sf_dir):
    return text.field_count_report(spark, _ragged(spark, sf_dir), Dialect(header=False))


@query("""SELECT CAST(c_custkey AS VARCHAR) AS column0, CAST(c_nationkey AS VARCHAR) AS column1, CASE WHEN c_custkey % 97 <> 0 THEN c_mktsegment END AS column2,
  CASE WHEN c_custkey % 97 <> 0 THEN 'end' END AS column3, CASE WHEN c_custkey % 97 <> 0 AND c_custkey % 101 = 0 THEN 'a' END AS column4,
  CASE WHEN c_custkey % 97 <> 0 AND c_custkey % 101 = 0 THEN 'b' END AS column5 FROM customer""")
def ragged_padded(spark, sf_dir):
    return text.read_all_text(spark, _ragged(spark, sf_dir), Dialect(header=False), null_padding=True)


@query("SELECT CAST(c_custkey AS VARCHAR) AS k, c_name AS name, c_mktsegment AS segment FROM customer")
def preamble_skip(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    rows = c.select(F.concat_ws(",", F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")).alias("value"))
    return text.read_all_text(spark, _headed(spark, "preamble", [*[f"generated file, line {i}" for i in range(3)], "k,name,segment"], rows), Dialect(skip=3))


def _headed(spark: SparkSession, name: str, first: list[str], rows: DataFrame, files: int = 4) -> str:
    """Text files as other programs write them: each has lines of its own above its rows."""
    path = fresh_path(spark, name)
    head = F.array(*[F.lit(x) for x in first]).cast("array<string>")
    place = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    numbered = rows.repartition(files, "value").withColumn("i", place)
    numbered.select(F.explode(F.when(F.col("i") == 0, F.concat(head, F.array("value"))).otherwise(F.array("value"))).alias("value")).write.text(path)
    return path


_QUOTED = "CASE WHEN c_custkey % 7 = 0 THEN 'first, line' || chr(10) || 'second' WHEN c_custkey % 11 = 0 THEN 'a \"mark\" ' || chr(10) || chr(10) ELSE c_name END"


def _quoted(c: DataFrame, n: int = 2) -> DataFrame:
    """Lines of a key and n quoted names with delimiters, quotes and line breaks in some of them."""
    k = F.col("c_custkey")
    name = F.when(k % 7 == 0, F.lit("first, line\nsecond")).when(k % 11 == 0, F.lit('a ""mark"" \n\n')).otherwise(F.col("c_name"))
    quoted = F.concat(F.lit('"'), name, F.lit('"'))
    return c.select(F.concat_ws(",", k.cast("string"), *[quoted] * (n - 1)).alias("value"))


@query(f"SELECT CAST(c_custkey AS VARCHAR) AS k, {_QUOTED} AS name FROM customer")
def preamble_quoted(spark, sf_dir):
    """A preamble, and quoted fields with delimiters and line breaks; the dialect is inferred, not given."""
    path = _headed(spark, "preamble-quoted", ["Report of customers", "", "k,name"], _quoted(table(spark, sf_dir, "customer")))
    return text.read_all_text(spark, path, text.infer_dialect(spark, path))


@query(f"SELECT c_custkey AS k, {_QUOTED} AS name, {_QUOTED} AS again FROM customer")
def scan_csv_multiline(spark, sf_dir):
    """Typed rows of text whose quoted fields hold line breaks, read in blocks."""
    path = _headed(spark, "multi-line", ["k,name,again"], _quoted(table(spark, sf_dir, "customer"), 3))
    return text.read_csv(spark, path, COMMA)


@query("""SELECT CAST(line_no AS BIGINT) AS line_no, n FROM (SELECT 1 + 2 * k AS line_no, count(*) AS n FROM
  (SELECT unnest(range(count(*))) AS k FROM customer) GROUP BY 1)""")
def record_lines(spark, sf_dir):
    """Numbers of the lines where records begin, in one file: every record but the header has a line break of its own."""
    rows = table(spark, sf_dir, "customer").select(F.concat(F.lit('"'), F.col("c_custkey").cast("string"), F.lit('\n",x')).alias("value"))
    path = _headed(spark, "record-lines", ["k,x"], rows, files=1)
    return text.blocks_of(spark, path, COMMA).records(header=True).groupBy("line_no").agg(F.count("*").alias("n"))


@query(f"SELECT {_CUSTOMER}, CASE WHEN c_nationkey >= 10 THEN 'x' || c_custkey END AS extra, CASE WHEN c_nationkey < 10 THEN 'a' ELSE 'b' END AS folder FROM customer")
def scan_folder_preambles(spark, sf_dir):
    """Members with lines above their headers and different columns; all of those lines go, in every member."""
    path, c = fresh_path(spark, "folder-preambles"), _customer(spark, sf_dir)
    fields = [F.col(x).cast("string") for x in c.columns]
    for folder, where, more in (("a", "c_nationkey < 10", []), ("b", "c_nationkey >= 10", [F.concat(F.lit("x"), F.col("c_custkey").cast("string"))])):
        rows = c.where(where).select(F.concat_ws(",", *fields, *more).alias("value"))
        written = _headed(spark, "members", ["Report, made today", 'of "customers"', ",".join([*c.columns, *["extra"] * len(more)])], rows)
        moved(spark, written, f"{path}/{folder}")
    out = text.read_folder_csv(spark, path, Dialect(skip=2))
    return out.select(*c.columns, "extra", F.regexp_extract("filename", "/([ab])/[^/]*$", 1).alias("folder"))


@query("SELECT c_custkey AS a, c_name AS b, c_mktsegment AS c FROM customer UNION ALL SELECT c_custkey, c_name, NULL FROM customer")
def ragged_headers(spark, sf_dir):
    """A header with fewer fields than its rows, and one with more: both are headers, and no line is a preamble."""
    c, out = table(spark, sf_dir, "customer"), None
    s = [F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")]
    for name, line in (("wide", F.concat(F.concat_ws(",", *s), F.lit(","))), ("narrow", F.concat_ws(",", *s[:2]))):
        path = _headed(spark, f"ragged-header-{name}", ["a,b,c"], c.select(line.alias("value")), files=1)
        found = text.infer_dialect(spark, path)
        part = text.read_all_text(spark, path, found).select(F.col("a").cast("long").alias("a"), "b", "c").where(F.lit((found.skip, found.header) == (0, True)))
        out = part if out is None else out.unionByName(part)
    return out


@query("SELECT event_id, user_id, event_type, value FROM events")
def scan_json_array(spark, sf_dir):
    """Arrays of objects, one a file, with brackets and quotes inside their texts."""
    df = table(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", F.lit('} "], [{\\').alias("odd"))
    size = sum(m.length for m in members(spark, f"{sf_dir}/events.parquet"))
    objects = df.select(F.to_json(F.struct("*")).alias("value"), "event_id").repartition(max(3, size // ARRAY), "event_id")

    def bracketed(batches):  # one array a file
        mark = "["
        for batch in batches:
            if not batch.num_rows:
                continue
            marks = pa.array([mark] + [","] * (batch.num_rows - 1))
            yield pa.RecordBatch.from_arrays([pc.binary_join_element_wise(marks, batch.column("value").cast(pa.string()), "")], ["value"])
            mark = ","
        yield pa.RecordBatch.from_pydict({"value": ["[]" if mark == "[" else "]"]})

    rows = objects.select("value").mapInArrow(bracketed, "value string")
    path = fresh_path(spark, "json-array")
    rows.write.text(path)
    return tables.read_json(spark, path, df.schema).where("odd is not null").drop("odd")


@query("""SELECT * FROM (VALUES ('comma', ',', '"', TRUE, 0), ('semicolon', ';', chr(39), FALSE, 0), ('preamble', '|', '"', TRUE, 2)) t(file, delimiter, quote, header, skip)
WHERE (SELECT count(*) FROM customer) > 2""")
def infer_dialect(spark, sf_dir):
    """What is inferred of three files written from customer."""
    c, out = table(spark, sf_dir, "customer"), []
    s = [F.col("c_custkey").cast("string"), F.col("c_name"), F.col("c_mktsegment")]
    quoted = [s[0], *[F.concat(F.lit("'"), x, F.lit("; '")) for x in s[1:]]]
    for name, first, line in (
        ("comma", ["key,name,segment"], F.concat_ws(",", *s)),
        ("semicolon", [], F.concat_ws(";", *quoted)),
        ("preamble", ["A report, made today", "of all customers", "key|name|segment"], F.concat_ws("|", *s)),
    ):
        rows = c.select(line.alias("value"))
        path = _headed(spark, f"dialect-{name}", first, rows)
        d = text.infer_dialect(spark, path)
        out.append((name, d.delimiter, d.quote, d.header, d.skip))
    return spark.createDataFrame(out, "file string, delimiter string, quote string, header boolean, skip int")


@query(_dirty("SELECT count(*) AS n FROM dirty_orders"))
def exact_count(spark, sf_dir):
    path = _csv(dirty_orders(spark, sf_dir), "count")
    spec = tables.SourceSpec(path, "csv", {"d": COMMA})
    n = tables.exact_count(spark, spec)
    return spark.range(1).select(F.lit(n).cast("long").alias("n"))


@query("SELECT count(*) AS exact, TRUE AS within_a_tenth, 'exact' AS confidence, 'high' AS confidence_of_some FROM customer")
def estimate_rows(spark, sf_dir):
    """The estimate from all members, which is exact, and whether one from some of them is within a tenth of it."""
    path = fresh_path(spark, "estimate")
    _customer(spark, sf_dir).repartition(8).write.csv(path)
    whole = tables.estimate_rows(spark, path, members_read=8).select(F.col("rows").alias("exact"), "confidence")
    some = tables.estimate_rows(spark, path, members_read=3).select("rows", F.col("confidence").alias("confidence_of_some"))
    near = (F.abs(F.col("rows") - F.col("exact")) <= 0.1 * F.col("exact")).alias("within_a_tenth")
    return whole.join(some).select("exact", near, "confidence", "confidence_of_some")  # two frames of one row each


@query("SELECT count(*) AS exact, TRUE AS covered, TRUE AS narrow, 'high' AS confidence FROM lineitem")
def row_interval(spark, sf_dir):
    """Whether the interval from 80 blocks of 512 bytes holds the number of lines written, and is no wider than a fifth of it."""
    path, lines = fresh_path(spark, "interval"), table(spark, sf_dir, "lineitem")
    lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_returnflag").repartition(6).write.csv(path)
    found = estimates.row_interval(spark, path, blocks=80, size=512)
    exact = F.col("exact")
    return found.join(spark.read.text(path).agg(F.count("*").alias("exact"))).select(  # two frames of one row each
        "exact", exact.between(F.col("low"), F.col("high")).alias("covered"), (F.col("high") - F.col("low") <= exact / 5).alias("narrow"), "confidence")


@query("SELECT 4 AS n_members, sum(length(c_name) + 1) AS bytes, TRUE AS same_again, TRUE AS changed FROM customer")
def source_token(spark, sf_dir):
    """Members and bytes of a source, whether its token stays while it does, and changes when a member comes to it."""
    path = fresh_path(spark, "token")
    names = table(spark, sf_dir, "customer").select(F.col("c_name").alias("value"))
    names.repartition(4).write.text(path)
    first, again = (tables.source_token(spark, path).first() for _ in range(2))
    names.limit(1).write.mode("append").text(path)
    row = (first.n_members, first.bytes, first.token == again.token, tables.source_token(spark, path).first().token != first.token)
    return spark.createDataFrame([row], "n_members int, bytes long, same_again boolean, changed boolean")


_MEMBER_FIELDS = "CAST(min({0}) AS VARCHAR) AS min, CAST(max({0}) AS VARCHAR) AS max, round(avg({0}), 6) AS avg, round(stddev_samp({0}), 6) AS std"


@query(f"""WITH twice AS (SELECT o_orderkey, o_custkey FROM orders UNION ALL SELECT o_orderkey, o_custkey FROM orders WHERE o_orderkey % 4 = 0)
SELECT step, "column", n, min, max, avg, std, n_scanned FROM (
  SELECT 'first' AS step, 'o_orderkey' AS "column", count(*) AS n, {_MEMBER_FIELDS.format("o_orderkey")}, 6 AS n_scanned FROM orders
  UNION ALL SELECT 'first', 'o_custkey', count(*), {_MEMBER_FIELDS.format("o_custkey")}, 6 FROM orders
  UNION ALL SELECT 'grown', 'o_orderkey', count(*), {_MEMBER_FIELDS.format("o_orderkey")}, 1 FROM twice
  UNION ALL SELECT 'grown', 'o_custkey', count(*), {_MEMBER_FIELDS.format("o_custkey")}, 1 FROM twice)""")
def profile_members(spark, sf_dir):
    """A profile of six members, and again when a seventh has come: that one alone is scanned."""
    path, df = fresh_path(spark, "profiled"), table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    df.repartition(6, "o_orderkey").write.parquet(path)
    folder, out = fresh_path(spark, "profiles"), None
    for step in ("first", "grown"):
        if step == "grown":
            df.where("o_orderkey % 4 = 0").coalesce(1).write.mode("append").parquet(path)
        store = partials.MemberProfiles(spark, folder)
        found = store.summary(path).select(F.lit(step).alias("step"), "column", "n", "min", "max", F.round("avg", 6).alias("avg"), F.round("std", 6).alias("std"), F.lit(store.scanned).alias("n_scanned"))
        out = found if out is None else out.unionByName(found)
    return out


# --- sinks ---------------------------------------------------------------------------------------------------------


@query(_dirty("SELECT o_orderkey, status, custkey_raw, orderdate_raw, price_raw FROM dirty_orders"))
def export_parquet(spark, sf_dir):
    return spark.read.parquet(sinks.export(dirty_orders(spark, sf_dir), fresh_path(spark, "export"), "parquet"))


def _export_text(fmt: str, d: Dialect) -> None:
    def run(spark, sf_dir):
        path = sinks.export(dirty_orders(spark, sf_dir), fresh_path(spark, "export"), fmt)
        return text.read_all_text(spark, path, d).withColumn("o_orderkey", F.col("o_orderkey").cast("long"))

    query(_dirty("SELECT o_orderkey, status, custkey_raw, orderdate_raw, price_raw FROM dirty_orders"), f"export_{fmt}")(run)


_export_text("csv", COMMA)
_export_text("tsv", Dialect(delimiter="\t"))


@query(_dirty("SELECT o_orderkey, status, custkey_raw, orderdate_raw, price_raw FROM dirty_orders"))
def export_ndjson(spark, sf_dir):
    df = dirty_orders(spark, sf_dir)
    return tables.read_json(spark, sinks.export(df, fresh_path(spark, "export"), "NDJSON"), df.schema)


@query("SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus")
def export_sql(spark, sf_dir):
    table(spark, sf_dir, "orders").createOrReplaceTempView("orders")
    path = sinks.export_sql(spark, "SELECT o_orderstatus, count(*) AS n FROM orders GROUP BY o_orderstatus", fresh_path(spark, "export"), "parquet")
    return spark.read.parquet(path)


# --- snapshots -----------------------------------------------------------------------------------------------------


@query(_dirty("SELECT o_orderkey, status, custkey_raw FROM dirty_orders"))
def snapshot_roundtrip(spark, sf_dir):
    return snapshots.snapshot(dirty_orders(spark, sf_dir).select("o_orderkey", "status", "custkey_raw"), fresh_path(spark, "snapshots"), "dirty_copy").drop("row_no")


def _source(spark: SparkSession, sf_dir: str, name: str) -> tuple[str, snapshots.Manifest, callable]:
    path = fresh_path(spark, name)
    _customer(spark, sf_dir).write.parquet(path)
    return path, snapshots.Manifest(spark, fresh_path(spark, "manifest")), lambda: spark.read.parquet(path)


@query("SELECT step, n FROM (SELECT 'rebuilt' AS step, count(*) AS n FROM customer UNION ALL SELECT 'adopted', count(*) FROM customer UNION ALL SELECT 'rebuilt', 2 * count(*) FROM customer)")
def snapshot_adopt(spark, sf_dir):
    path, manifest, read = _source(spark, sf_dir, "adopt")
    steps = []
    for again in (False, False, True):
        if again:
            _customer(spark, sf_dir).write.mode("append").parquet(path)
        done, copy = snapshots.adopt_or_rebuild(manifest, "customer_copy", path, read)
        steps.append((done, copy.count()))
    return spark.createDataFrame(steps, "step string, n long")


@query("SELECT 'a' AS name, 'changed' AS status, count(*) AS n FROM customer UNION ALL SELECT 'b', 'fresh', count(*) FROM customer UNION ALL SELECT 'c', 'gone', count(*) FROM customer")
def snapshot_status(spark, sf_dir):
    from ..sources.shared import delete

    manifest, paths, copies = snapshots.Manifest(spark, fresh_path(spark, "manifest")), {}, None
    for name in "abc":
        paths[name], _, read = _source(spark, sf_dir, f"status-{name}")
        copy = snapshots.adopt_or_rebuild(manifest, name, paths[name], read)[1].agg(F.count("*").alias("n")).withColumn("name", F.lit(name))
        copies = copy if copies is None else copies.unionByName(copy)
    _customer(spark, sf_dir).write.mode("append").parquet(paths["a"])
    delete(spark, paths["c"])
    return snapshots.stale_snapshots(manifest).join(copies, "name").select("name", "status", "n")


@query("SELECT step, n FROM (SELECT 'unchanged' AS step, count(*) AS n FROM customer UNION ALL SELECT 'refreshed', 2 * count(*) FROM customer)")
def refresh(spark, sf_dir):
    path, manifest, read = _source(spark, sf_dir, "refresh")
    snapshots.adopt_or_rebuild(manifest, "refreshed_copy", path, read)
    steps = []
    for again in (False, True):
        if again:
            _customer(spark, sf_dir).write.mode("append").parquet(path)
        done, copy = snapshots.refresh(manifest, "refreshed_copy", read)
        steps.append((done, copy.count()))
    return spark.createDataFrame(steps, "step string, n long")


@query(_dirty("""SELECT c.position, c.name AS "column", c.type, c.kind, n.n AS n_rows, 'counted on the text' AS basis, n.bad AS n_bad_rows,
  CASE c.name WHEN 'custkey_raw' THEN n.k WHEN 'orderdate_raw' THEN n.d WHEN 'price_raw' THEN n.p ELSE 0 END AS n_bad, 0 AS n_notes, 20 AS n_first
FROM (VALUES (0, 'o_orderkey', 'bigint', 'number'), (1, 'status', 'string', 'text'), (2, 'custkey_raw', 'bigint', 'number'),
  (3, 'orderdate_raw', 'date', 'temporal'), (4, 'price_raw', 'double', 'number')) c(position, name, type, kind),
(SELECT count(*) AS n, count(*) FILTER (WHERE """ + ANY_BAD_SQL + """) AS bad, count(*) FILTER (WHERE """ + BAD_SQL["custkey_raw"] + """) AS k,
  count(*) FILTER (WHERE """ + BAD_SQL["orderdate_raw"] + """) AS d, count(*) FILTER (WHERE """ + BAD_SQL["price_raw"] + """) AS p FROM dirty_orders) n"""))
def overview(spark, sf_dir):
    found = overview_of(spark, _csv(dirty_orders(spark, sf_dir), "overview"))
    return found.withColumn("n_notes", F.size("notes")).withColumn("n_first", F.size("first_values")).drop("notes", "first_values")



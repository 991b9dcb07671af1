import datetime
import gzip
import json
import os
import urllib.parse

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vistaframe.functions.model import Dialect, ExportError, Filter, QuerySpec, Sort, SQLRejected, UnsupportedSource
from vistaframe.operators import quality
from vistaframe.operators.overview import first_rows, overview
from vistaframe.sources import shared, sinks, snapshots, tables, text
from vistaframe.sources.detect import detect

HEADER = "order_id,region,amount,note"


def lines(n=1000, changes=None):
    rows = [f"{i},{'North South East West'.split()[i % 4]},{i}.50,note {i}" for i in range(n)]
    for i, row in (changes or {}).items():
        rows[i] = row
    return [HEADER, *rows]


def put(path, rows, end="\n", first=""):
    path.write_bytes((first + end.join(rows) + end).encode())
    return str(path)


def test_clean_file(spark, tmp_path):
    p = put(tmp_path / "clean.csv", lines())
    spec, df = tables.open_source(spark, p)
    assert spec.format == "csv" and df.count() == 1000 == tables.exact_count(spark, spec)
    assert [f.dataType.simpleString() for f in df.schema.fields] == ["bigint", "string", "double", "string"]


def test_a_late_bad_value_is_a_bad_cell(spark, tmp_path):
    p = put(tmp_path / "dirty.csv", lines(changes={500: "500,East,N/A,x"}))
    whole = text.read_all_text(spark, p)
    schema = text.inferred_schema(whole)
    assert schema["amount"].dataType == T.DoubleType() and whole.count() == 1000 and text.read_csv(spark, p).count() == 999
    assert quality.bad_rows(whole, schema).first().bad_columns == ["amount"]
    r = {x.column: x for x in overview(spark, p).collect()}
    assert r["amount"].n_bad == 1 and r["note"].n_bad == 0 and r["amount"].n_rows == 1000 and r["amount"].n_bad_rows == 1


def test_null_empty_and_marker_stay_three_things(spark, tmp_path):
    p = put(tmp_path / "nulls.csv", lines(4, {0: '0,,1.5,x', 1: '1,West,2.5,""', 2: "2,West,3.5,N/A"}))
    rows = text.read_all_text(spark, p).collect()
    assert rows[0].region is None and rows[1].note == "" and rows[2].note == "N/A"


def test_bom_crlf_and_preamble(spark, tmp_path):
    p = put(tmp_path / "weird.csv", ["junk", "junk 2", "junk 3", *lines(300)], "\r\n", "﻿")
    d = Dialect(skip=3)
    assert text.read_csv(spark, p, d).count() == 300 and text.read_all_text(spark, p, d).columns == HEADER.split(",")
    assert tuple(text.preamble_report(spark, p, d).first()) == (304, 3, 300, False)
    assert text.preamble_report(spark, p, Dialect(skip=304)).first().skipped_all
    q = put(tmp_path / "comments.csv", ["# generated", "# file", *lines(200)])
    assert text.read_csv(spark, q, Dialect(comment="#"), text.inferred_schema(text.read_all_text(spark, q, Dialect(skip=2)))).count() == 200


def test_dialects(spark, tmp_path):
    for d in ";\t|,":
        p = put(tmp_path / f"d{ord(d)}.csv", [r.replace(",", d) for r in lines(200)])
        assert text.infer_dialect(spark, p) == Dialect(delimiter=d)
    bare = put(tmp_path / "bare.csv", ["1,2", "3,4"])
    assert not text.infer_dialect(spark, bare).header
    only = put(tmp_path / "header.csv", ["order_id,region,amount"])
    assert text.read_all_text(spark, only).count() == 0 and text.read_all_text(spark, only).columns == ["order_id", "region", "amount"]


def test_quoted_line_breaks_and_quotes(spark, tmp_path):
    p = put(tmp_path / "q.csv", lines(400, {7: '7,East,1.5,"two\nlines, ""quoted"""'}))
    df = text.read_csv(spark, p)
    assert df.count() == 400 and df.where("order_id = 7").first().note == 'two\nlines, "quoted"'


def test_ragged(spark, tmp_path):
    p = put(tmp_path / "r.csv", ["order_id,region,amount", "1,a,2", "2,b", "3,c,4,x,y", '4,"d,e",5'])
    assert tuple(text.field_count_report(spark, p).first()) == (5, 3, 2, 5)
    assert text.read_all_text(spark, p, null_padding=True).columns == ["order_id", "region", "amount", "column3", "column4"]
    assert text.read_all_text(spark, p, null_padding=True).where("column4 = 'y'").count() == 1


def test_compressed_and_empty(spark, tmp_path):
    p = str(tmp_path / "z.csv.gz")
    with gzip.open(p, "wt") as f:
        f.write("\n".join(lines(500)) + "\n")
    assert detect(spark, p) == "csv" and text.read_csv(spark, p).count() == 500
    assert tables.estimate_rows(spark, p).first().confidence == "low"
    e = tmp_path / "empty.csv"
    e.write_text("")
    assert text.read_all_text(spark, str(e)).count() == 0
    assert tables.estimate_rows(spark, str(e)).first().rows == 0


def test_estimates(spark, tmp_path):
    for i in range(6):
        put(tmp_path / f"m{i}.csv", lines(100))
    r = tables.estimate_rows(spark, str(tmp_path)).first()
    assert r.confidence == "high" and abs(r.rows - 606) < 10
    assert tables.estimate_rows(spark, str(tmp_path), 10).first().confidence == "exact"


def test_json(spark, tmp_path):
    a = tmp_path / "a.json"
    a.write_text("[\n" + ",\n".join(json.dumps({"id": i, "nested": {"a": i}}) for i in range(120)) + "\n]")
    assert tables.open_source(spark, str(a))[1].select("nested.a").count() == 120
    b = tmp_path / "b.ndjson"
    b.write_text("\n".join(json.dumps({"id": i}) for i in range(200)))
    assert tables.open_source(spark, str(b))[1].count() == 200


def test_detection_and_refusals(spark, tmp_path):
    (tmp_path / "x").write_bytes(b"  {\"a\": 1}")
    assert detect(spark, str(tmp_path / "x")) == "json"
    (tmp_path / "y").write_bytes(b"a,b\n")
    assert detect(spark, str(tmp_path / "y")) == "csv"
    for name, data in (("z.zip", b"PK\x03\x04...."), ("o.xls", b"\xd0\xcf\x11\xe0...."), ("w.xlsx", b"")):
        (tmp_path / name).write_bytes(data)
        with pytest.raises(UnsupportedSource):
            detect(spark, str(tmp_path / name))
    (tmp_path / "none").mkdir()
    for p in (tmp_path / "none", tmp_path / "missing.csv"):
        with pytest.raises(UnsupportedSource):
            detect(spark, str(p))
    with pytest.raises(UnsupportedSource):
        tables.open_source(spark, str(tmp_path / "y"), version=1)


def test_folders(spark, tmp_path):
    df = spark.range(400).select("id", (F.col("id") % 2).alias("dt"), (F.col("id") % 3).alias("region"), (F.col("id") * 2).alias("qty"))
    df.write.partitionBy("dt", "region").parquet(f"{tmp_path}/hive")
    got = tables.open_source(spark, f"{tmp_path}/hive")[1]
    assert set(got.columns) == {"id", "qty", "dt", "region", "filename"} and got.where("dt = 1").count() == 200
    df.select("id").where("id < 10").write.parquet(f"{tmp_path}/mixed/k=1")
    df.select("id", "qty").where("id >= 10").write.parquet(f"{tmp_path}/mixed/plain")
    mixed = tables.read_folder_parquet(spark, f"{tmp_path}/mixed")
    assert set(mixed.columns) == {"id", "qty", "filename"} and mixed.count() == 400 and mixed.where("qty is null").count() == 10
    for n, head in ((1, "a,b"), (2, "b,a"), (3, "a,c")):
        (tmp_path / "csvs").mkdir(exist_ok=True)
        put(tmp_path / "csvs" / f"{n}.csv", [head, f"{n},{n * 10}", f"{n},{n * 10}"])
    got = tables.open_source(spark, str(tmp_path / "csvs"))[1]
    assert got.count() == 6 and sorted({(r.a, r.b, r.c) for r in got.collect()}, key=str) == sorted({(1, 10, None), (20, 2, None), (3, None, 30)}, key=str)
    assert got.select("filename").distinct().count() == 3


def log_table(spark, path, vectors=False):
    for i in range(3):
        spark.range(i * 50, i * 50 + 50).select("id", F.lit(f"g{i}").alias("g")).coalesce(1).write.mode("append").parquet(f"{path}/part {i}")
    files = [os.path.relpath(m.path.removeprefix("file:"), path) for m in shared.members(spark, str(path))]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("g", T.StringType())]).json()
    os.makedirs(f"{path}/_delta_log")
    add = lambda f, **x: json.dumps({"add": {"path": f.replace(" ", "%20"), "partitionValues": {}, "size": 1} | x})
    log = [[json.dumps({"metaData": {"schemaString": schema, "partitionColumns": []}}), add(files[0]), add(files[1])],
           [json.dumps({"remove": {"path": files[1].replace(" ", "%20")}}), add(files[2], **({"deletionVector": {"storageType": "z"}} if vectors else {}))]]
    for v, rows in enumerate(log):
        with open(f"{path}/_delta_log/{v:020d}.json", "w") as f:
            f.write("\n".join(rows))


def test_log_tables(spark, tmp_path):
    log_table(spark, tmp_path / "t")
    p = str(tmp_path / "t")
    spec, df = tables.open_source(spark, p)
    assert spec.format == "log" and df.count() == 100 and {r.g for r in df.collect()} == {"g0", "g2"}
    assert {r.g for r in tables.read_log_table(spark, p, 0).collect()} == {"g0", "g1"}
    with pytest.raises(UnsupportedSource):
        tables.read_log_table(spark, p, 7)
    log_table(spark, tmp_path / "v", vectors=True)
    with pytest.raises(UnsupportedSource, match="unknown kind"):
        tables.read_log_table(spark, str(tmp_path / "v"))


def test_partitioned_log_table_with_checkpoint(spark, tmp_path):
    p = tmp_path / "t"
    spark.range(5).coalesce(1).write.parquet(f"{p}/day=1")
    spark.range(5, 9).coalesce(1).write.parquet(f"{p}/day=2")
    files = [os.path.relpath(m.path.removeprefix("file:"), p) for m in shared.members(spark, str(p))]
    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("day", T.IntegerType())]).json()
    add = [{"path": f, "partitionValues": {"day": f[4]}, "deletionVector": None} for f in files]
    rows = [(add[0], None), (None, {"schemaString": schema, "partitionColumns": ["day"], "configuration": {}})]
    os.makedirs(f"{p}/_delta_log")
    spark.createDataFrame(rows, "add struct<path: string, partitionValues: map<string, string>>, metaData struct<schemaString: string, partitionColumns: array<string>, configuration: map<string, string>>"
        ).coalesce(1).write.parquet(f"{tmp_path}/c")
    part = next(x for x in os.listdir(f"{tmp_path}/c") if x.startswith("part"))
    os.rename(f"{tmp_path}/c/{part}", f"{p}/_delta_log/{3:020d}.checkpoint.parquet")
    open(f"{p}/_delta_log/_last_checkpoint", "w").write(json.dumps({"version": 3}))
    open(f"{p}/_delta_log/{4:020d}.json", "w").write(json.dumps({"add": {"path": add[1]["path"], "partitionValues": {"day": "2"}}}))
    got = tables.read_log_table(spark, str(p))
    assert {(r.id, r.day) for r in got.collect()} == {(i, 1 if i < 5 else 2) for i in range(9)}


def test_tokens_see_every_change(spark, tmp_path):
    for i in range(3):
        put(tmp_path / f"{i}.csv", lines(5))
    a = tables.source_token(spark, str(tmp_path)).first()
    assert a == tables.source_token(spark, str(tmp_path)).first() and a.n_members == 3
    put(tmp_path / "1.csv", lines(6))
    assert tables.source_token(spark, str(tmp_path)).first().token != a.token


@pytest.mark.parametrize("fmt", ["parquet", "CSV", "tsv", "ndjson"])
def test_exports(spark, tmp_path, fmt):
    df = spark.createDataFrame([(1, None), (2, ""), (3, 'q"u,o\tte'), (4, "line\nbreak")], "n long, s string")
    dest = sinks.export(df, f"{tmp_path}/out", fmt)
    back = {"parquet": lambda: spark.read.parquet(dest), "ndjson": lambda: spark.read.json(dest), "CSV": lambda: text.read_all_text(spark, dest, Dialect()),
            "tsv": lambda: text.read_all_text(spark, dest, Dialect(delimiter="\t"))}[fmt]()
    assert {(int(r.n), r.s) for r in back.collect()} == {(r.n, r.s) for r in df.collect()}
    with pytest.raises(ExportError):
        sinks.export(df, dest, fmt)
    sinks.export(df.limit(1), dest, fmt, overwrite=True)


def test_export_refusals(spark, tmp_path):
    with pytest.raises(ExportError):
        sinks.export(spark.range(1), f"{tmp_path}/x", "xlsx")
    with pytest.raises(SQLRejected):
        sinks.export_sql(spark, "DROP TABLE t", f"{tmp_path}/x", "csv")
    assert not os.path.exists(f"{tmp_path}/x")


def test_snapshots(spark, tmp_path):
    src = f"{tmp_path}/src"
    spark.range(100).orderBy(F.desc("id")).write.parquet(src)
    manifest, read = snapshots.Manifest(spark, f"{tmp_path}/m"), lambda: spark.read.parquet(src)
    steps = [snapshots.adopt_or_rebuild(manifest, "t", src, read, ["id"])[0] for _ in range(2)]
    assert steps == ["rebuilt", "adopted"] and spark.table("t").orderBy("row_no").first().id == read().first().id
    assert snapshots.adopt_or_rebuild(manifest, "t", src, read, ["other"])[0] == "rebuilt"
    assert snapshots.refresh(manifest, "t", read)[0] == "unchanged"
    spark.range(5).write.mode("append").parquet(src)
    assert snapshots.stale_snapshots(manifest).first().status == "changed"
    done, copy = snapshots.refresh(manifest, "t", read)
    assert done == "refreshed" and copy.count() == 105
    shared.delete(spark, src)
    assert snapshots.stale_snapshots(manifest).first().status == "gone" and spark.table("t").count() == 105
    with pytest.raises(KeyError):
        snapshots.refresh(manifest, "unknown", read)


def test_retention_ages_first_then_least_recent(spark):
    now = datetime.datetime(2026, 1, 30)
    rows = [("old", 5, now - datetime.timedelta(days=20)), ("a", 40, now - datetime.timedelta(days=3)), ("b", 40, now - datetime.timedelta(days=2)), ("c", 40, now)]
    got = {r.name: r.verdict for r in snapshots.retention(spark.createDataFrame(rows, "name string, bytes long, last_used timestamp"), now, 85, 14).collect()}
    assert got == {"old": "aged", "a": "over", "b": "keep", "c": "keep"}


def test_overview_of_typed_sources(spark, sf_dir):
    r = overview(spark, f"{sf_dir}/orders.parquet").collect()
    assert len(r) == 6 and r[0].n_bad is None and r[0].n_rows == spark.read.parquet(f"{sf_dir}/orders.parquet").count()
    assert first_rows(spark, f"{sf_dir}/orders.parquet", 3).count() == 3


def test_facts_the_readers_rest_on(spark, tmp_path):
    """By default quoted empties are NULL, counts of lossy reads are wrong, and short and long lines pass without a word."""
    p = put(tmp_path / "f.csv", ["a,b", '1,""', "2", "3,x,y"])
    assert spark.read.csv(p, header=True).first().b is None
    assert [r.b for r in spark.read.csv(p, header=True).collect()][1:] == [None, "x"]


def test_watching_a_folder(spark, tmp_path):
    from vistaframe.streaming.watch import text_stream, watch_missing

    (tmp_path / "in").mkdir()
    for i in range(2):
        put(tmp_path / "in" / f"{i}.csv", lines(10, {0: '0,,1,""'}))
        q = watch_missing(text_stream(spark, str(tmp_path / "in"), HEADER.split(",")), f"{tmp_path}/out", f"{tmp_path}/cp")
        q.awaitTermination(60)
    got = spark.read.parquet(f"{tmp_path}/out").where("column = 'region'").collect()
    assert [(r.n, r.n_null) for r in got] == [(10, 1)] * 2


def test_overview_takes_types_from_all_rows(spark, tmp_path):
    p = f"{tmp_path}/late.csv"
    with open(p, "w") as f:
        f.write("a,b\n" + "".join(f"{i},{i if i < 21_000 else 'x'}\n" for i in range(50_000)))
    r = {x.column: x for x in overview(spark, p).collect()}
    assert (r["a"].type, r["b"].type, r["b"].n_bad, r["b"].n_bad_rows) == ("bigint", "string", 0, 0)


def versioned(spark, path, versions, by=None, checkpoint=None, spell=lambda name: name):
    """A log-based table of ten rows a version, as a writer leaves it; by names a key column."""
    (path / "_delta_log").mkdir(parents=True)
    schema = spark.range(1).selectExpr("id", "'x' as k").schema
    adds = []
    for v in range(versions):
        df, key = spark.range(10 * v, 10 * v + 10).selectExpr("id", f"'k {v % 2}+' as k"), f"k {v % 2}+"
        name = f"k={key.replace(' ', '%20')}/part-{v}.parquet" if by == "folders" else f"part {v}+.parquet"
        (df.drop("k") if by else df).coalesce(1).write.parquet(f"{path}/tmp{v}")
        made = next(x for x in os.listdir(f"{path}/tmp{v}") if x.endswith(".parquet"))
        os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
        os.rename(f"{path}/tmp{v}/{made}", f"{path}/{name}")
        add = {"add": {"path": urllib.parse.quote(name, safe="/="), "partitionValues": {"k": key} if by else {}}}
        meta = {"metaData": {"schemaString": schema.json(), "partitionColumns": ["k"] if by else [], "configuration": {}}}
        adds.append(add)
        put(path / "_delta_log" / f"{v:020d}.json", [json.dumps(x) for x in ([meta] if v == 0 else []) + [add]])
        if v == checkpoint:
            rows = spark.read.schema(tables._LOG).json(spark.sparkContext.parallelize([json.dumps(x) for x in [meta, *adds]]))
            rows.coalesce(1).write.parquet(f"{path}/cp")
            part = next(x for x in os.listdir(f"{path}/cp") if x.endswith(".parquet"))
            os.rename(f"{path}/cp/{part}", f"{path}/_delta_log/{v:020d}.checkpoint.parquet")
    return str(path)


@pytest.mark.parametrize("by", [None, "folders", "log"])
def test_log_tables_are_one_scan(spark, tmp_path, by):
    p = versioned(spark, tmp_path / "t", 4, by)
    df = tables.read_log_table(spark, p)
    assert df.columns == ["id", "k"] and {(r.id, r.k) for r in df.collect()} == {(i, f"k {i // 10 % 2}+") for i in range(40)}
    assert df._jdf.queryExecution().optimizedPlan().toString().count("Relation") <= 1 + (by == "log")
    assert tables.read_log_table(spark, p, version=1).count() == 20


def test_log_tables_with_gaps_are_refused(spark, tmp_path):
    p = versioned(spark, tmp_path / "t", 5, checkpoint=3)
    os.remove(f"{p}/_delta_log/{0:020d}.json")
    assert tables.read_log_table(spark, p).count() == 50 and tables.read_log_table(spark, p, version=3).count() == 40
    for version in (0, 1, 2, 9, -1):
        with pytest.raises(UnsupportedSource):
            tables.read_log_table(spark, p, version=version)
    os.remove(f"{p}/_delta_log/{4:020d}.json")
    assert tables.read_log_table(spark, p).count() == 40


def test_skipped_lines_before_quoted_line_breaks(spark, tmp_path):
    p = put(tmp_path / "f.csv", ["made today", "k,v", '1,"x', 'y"', '2,"a ""b"", c"', "3,"])
    d = Dialect(skip=1)
    assert [(r.k, r.v) for r in text.read_all_text(spark, p, d).collect()] == [("1", "x\ny"), ("2", 'a "b", c'), ("3", None)]


def test_quotes_and_preambles_are_inferred(spark, tmp_path):
    p = put(tmp_path / "f.csv", ["A report, with a comma, and more", "", "k;v;w", *[f"{i};'a;b';'c'" for i in range(30)]])
    d = text.infer_dialect(spark, p)
    assert (d.delimiter, d.quote, d.skip, d.header) == (";", "'", 2, True)
    assert text.read_csv(spark, p).first().v == "a;b"
    said = overview(spark, p).first()
    assert said.notes[0].startswith("2 lines") and said.first_values[:2] == ["0", "1"]


def test_escapes_comments_and_ragged_headers_are_inferred(spark, tmp_path):
    p = put(tmp_path / "e.csv", ["k,name,n", *[f'{k},"say \\"x, y\\" to {k}",{k}' for k in range(30)]])
    d = text.infer_dialect(spark, p)
    assert d == Dialect(escape="\\") and {r.name for r in text.read_all_text(spark, p, d).collect()} == {f'say "x, y" to {k}' for k in range(30)}
    q = put(tmp_path / "d.csv", ["k,name", *[f'{k},"say ""x, y"" to {k}"' for k in range(30)]])
    assert text.infer_dialect(spark, q) == Dialect()
    c = put(tmp_path / "c.csv", ["k;name", "1;a", "# a remark, made late", "2;b", "#another", *[f"{k};x" for k in range(3, 40)]])
    d = text.infer_dialect(spark, c)
    assert d == Dialect(delimiter=";", comment="#") and text.read_csv(spark, c, d).count() == 39
    h = put(tmp_path / "h.csv", ["#tags;name", *[f"#t{k};x{k}" for k in range(30)]])  # marks that are data
    assert text.infer_dialect(spark, h).comment is None
    for rows in (["a,b,c", *[f"{k},x,y," for k in range(9)]], ["a,b,c", *[f"{k},x" for k in range(9)]]):
        r = put(tmp_path / "r.csv", rows)
        assert text.infer_dialect(spark, r) == Dialect() and text.read_all_text(spark, r).columns == ["a", "b", "c"] and text.read_all_text(spark, r).count() == 9
        (tmp_path / ".r.csv.crc").unlink(missing_ok=True)
    t = put(tmp_path / "t.csv", ["A report, made today", "k,name,n", *[f"{k},x,1" for k in range(9)]])
    assert text.infer_dialect(spark, t) == Dialect(skip=1)


def test_snapshots_outlive_their_session(spark, tmp_path):
    src, folder = f"{tmp_path}/src", f"{tmp_path}/m"
    spark.range(1000).repartition(7).write.parquet(src)
    read = lambda: spark.read.parquet(src)
    spec = QuerySpec((Filter("id", "<", (10,)),), (Sort("id", True),))
    _, copy = snapshots.adopt_or_rebuild(snapshots.Manifest(spark, folder), "t2", src, read, spec=spec)
    assert [r.row_no for r in copy.orderBy("row_no").collect()] == list(range(1, 1001))
    assert [r.id for r in copy.orderBy("row_no").collect()] == [r.id for r in read().collect()]
    later = snapshots.Manifest(spark.newSession(), folder)
    assert snapshots.adopt_or_rebuild(later, "t2", src, read)[0] == "adopted"
    spark.range(5, 7).write.mode("append").parquet(src)
    done, rows = snapshots.refresh(snapshots.Manifest(spark, folder), "t2", read)
    assert done == "refreshed" and [r.id for r in rows.collect()] == [9, 8, 7, 6, 6, 5, 5, 4, 3, 2, 1, 0]


def test_retention_over_many_ranges(spark):
    now = datetime.datetime(2026, 1, 30)
    rows = [(f"n{i:04d}", 10 + i % 7, now - datetime.timedelta(hours=i * 7 % 500)) for i in range(400)] + [("none", None, None)]
    got = {r.name: r.verdict for r in snapshots.retention(spark.createDataFrame(rows, "name string, bytes long, last_used timestamp"), now, 2000, 14).collect()}
    run, want = 0, {}
    for name, n, used in sorted(rows, key=lambda r: (r[2] is not None, r[2] or now, r[0]), reverse=True):
        if used is not None and used < now - datetime.timedelta(days=14):
            want[name] = "aged"
            continue
        run += n or 0
        want[name] = "over" if run > 2000 else "keep"
    assert got == want

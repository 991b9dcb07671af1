import csv
import io
import json
import os
import random

import duckdb
import pytest
from pyspark.sql import DataFrameReader
from pyspark.sql import functions as F

from vistaframe.functions.model import Dialect
from vistaframe.plans import catalog_files
from vistaframe.sources import tables, text
from vistaframe.sources.blocks import Blocks, Elements, QuotedLines


@pytest.fixture
def blocks_of_bytes(spark):
    """Sets the largest block, and brings the old one back."""
    key = "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    yield lambda n: spark.conf.set(key, str(n))
    spark.conf.set(key, before)


def made(rng, rows, fields=3, end="\n"):
    """Rows of awkward fields, and their text."""
    field = lambda: rng.choice(["", "a", "b c", 'he said "x"', "1,2", "two\nlines", "cr\r\nlf", "\n", "\n\n\n", '"', '",\n"', "é数😀", "long " * rng.randrange(9), "  ", '5" pipe'])
    data = [[f"{k}", *(field() for _ in range(fields - 1))] for k in range(rows)]
    out = io.StringIO()
    w = csv.writer(out, lineterminator=end, quoting=csv.QUOTE_MINIMAL)
    for r in data:
        w.writerow(r)
    return data, out.getvalue()


def put(path, text):
    path.write_bytes(text.encode())
    return str(path)


@pytest.mark.parametrize("size, end", [(60, "\n"), (90, "\r\n"), (1 << 20, "\n")])
def test_quoted_line_breaks_in_many_blocks(spark, tmp_path, blocks_of_bytes, size, end):
    data, body = made(random.Random(size), 12, end=end)
    p = put(tmp_path / "q.csv", f"k,x,y{end}{body}")
    blocks_of_bytes(size)
    df = text.read_all_text(spark, p, Dialect())
    got = sorted(([r.k, r.x or "", r.y or ""] for r in df.collect()), key=lambda r: int(r[0]))
    assert df.columns == ["k", "x", "y"] and got == data
    blocks = text.blocks_of(spark, p, Dialect())
    numbers = [(r.line_no, r.value) for r in blocks.records().orderBy("line_no").collect()]
    assert len(numbers) == 13 and numbers[0][0] == 0
    if size < 100:  # several blocks
        assert blocks.info().count() > 2


def test_stray_quotes_do_not_open(spark, tmp_path, blocks_of_bytes):
    rows = [f'{k},5" pipe,"x ""y"" z"' for k in range(20)] + ['20,"a\nb",c"d']
    p = put(tmp_path / "s.csv", "\n".join(["k,x,y", *rows]) + "\n")
    blocks_of_bytes(60)
    got = text.read_all_text(spark, p, Dialect()).collect()
    assert len(got) == 21 and all(r.x == ('5" pipe' if r.k != "20" else "a\nb") and r.y == ('x "y" z' if r.k != "20" else 'c"d') for r in got)


@pytest.mark.parametrize("size", [70, 1 << 20])
def test_folders_with_preambles(spark, tmp_path, blocks_of_bytes, size):
    """Skipped lines and headers go from every member, in whatever partitions and blocks they lie."""
    rng, want = random.Random(size), []
    for name, n in (("a", 5), ("b", 14), ("c", 0), ("d", 3)):
        data, body = made(rng, n)
        head = "k,x,y" if name != "d" else "k,y,extra"
        put(tmp_path / f"{name}.csv", f'Report "A"\nmade "today, it\'s"\n{head}\n{body}')
        want += [(name, r[0], *((r[1], r[2], None) if name != "d" else (None, r[1], r[2]))) for r in data]
    blocks_of_bytes(size)
    out = text.read_folder_csv(spark, str(tmp_path), Dialect(skip=2), typed=False)
    empty = lambda r, f: (getattr(r, f) or "") if (f != "extra") == ("d.csv" not in r.filename) or f == "y" else getattr(r, f)
    got = [(r.filename.rsplit("/", 1)[-1][0], r.k, empty(r, "x"), empty(r, "y"), empty(r, "extra")) for r in out.collect()]
    assert sorted(got, key=str) == sorted(want, key=str) and len(got) == 22
    assert tuple(text.preamble_report(spark, str(tmp_path), Dialect(skip=2)).first())[1:3] == (8, 22)


def test_comments_blank_lines_and_skipped_quotes(spark, tmp_path, blocks_of_bytes):
    p = put(tmp_path / "c.csv", '﻿open " here\n\n# note "\n  \nk,x\n# "more\n1,"a\n\n# inside\nb"\n\n2,"c"\n#"\n3,d')
    for size in (17, 1 << 20):
        blocks_of_bytes(size)
        df = text.read_all_text(spark, p, Dialect(skip=1, comment="#"))
        assert df.columns == ["k", "x"] and sorted((r.k, r.x) for r in df.collect()) == [("1", "a\n\n# inside\nb"), ("2", "c"), ("3", "d")]


def test_a_quote_that_never_closes(spark, tmp_path, blocks_of_bytes):
    p = put(tmp_path / "u.csv", 'k,x\n1,"a\nb"\n2,"open\n3,c\n\n4,d\n')
    for size in (9, 1 << 20):
        blocks_of_bytes(size)
        assert [(r.line_no, r.value) for r in text.blocks_of(spark, p, Dialect()).records(True).orderBy("line_no").collect()] == [
            (1, '1,"a\nb"'), (3, '2,"open'), (4, "3,c"), (6, "4,d")]


def test_header_with_a_line_break_and_other_escapes(spark, tmp_path, blocks_of_bytes):
    p = put(tmp_path / "h.csv", 'k;"two\nlines"\n1;"a \\" b\nc"\n2;d\n')
    for size in (14, 1 << 20):
        blocks_of_bytes(size)
        df = text.read_all_text(spark, p, Dialect(delimiter=";", escape="\\"))
        assert df.columns == ["k", "two\nlines"] and sorted(tuple(r) for r in df.collect()) == [("1", 'a " b\nc'), ("2", "d")]


def test_bare_carriage_returns(spark, tmp_path):
    p = put(tmp_path / "mac.csv", 'k,x\r1,"a"\r2,b\r')
    assert sorted(tuple(r) for r in text.read_all_text(spark, p, Dialect()).collect()) == [("1", "a"), ("2", "b")]


@pytest.mark.parametrize("seed", range(40))
def test_automaton_equals_a_parser(seed):
    """Run from its true state, a line's end is inside a field exactly if a parser needs the next line."""
    data, body = made(random.Random(seed), 30)
    scan, inside, n = QuotedLines(), 0, 0
    for line in body.encode().split(b"\n")[:-1]:
        inside, _ = scan.step(line, inside)
        n += not inside
    assert n == 30 and not inside


@pytest.mark.parametrize("size, indent", [(150, None), (250, 2), (1 << 20, None)])
def test_json_arrays_in_many_blocks(spark, tmp_path, blocks_of_bytes, size, indent):
    rng = random.Random(size)
    rows = [{"id": k, "s": rng.choice(['a "b" }', "{[", "\\", "\\\"}", "x\ny", "", "é}"]), "n": {"a": k, "l": [{"z": 1}, {"z": "}"}]}, "e": {}} for k in range(16)]
    p = put(tmp_path / "a.json", json.dumps(rows, indent=indent, ensure_ascii=False) + "\n")
    blocks_of_bytes(size)
    schema = "id long, s string, n struct<a: long, l: array<struct<z: string>>>"
    got = sorted((r.id, r.s, r.n.a, [x.z for x in r.n.l]) for r in tables.read_json(spark, p, schema).collect())
    assert got == [(r["id"], r["s"], r["n"]["a"], ["1", "}"]) for r in rows]
    assert tables.read_json(spark, p).count() == 16
    blocks = Blocks(spark, [p], Elements())
    assert sorted(json.loads(r.value)["id"] for r in blocks.records().collect()) == list(range(16))


def test_same_rows_as_duckdb(spark, tmp_path, blocks_of_bytes):
    _, body = made(random.Random(77), 60, 4)
    p = put(tmp_path / "d.csv", "k,x,y,z\n" + body)
    blocks_of_bytes(500)
    want = duckdb.sql(f"select * from read_csv('{p}', header=true, all_varchar=true, quote='\"', escape='\"', delim=',', new_line='\\n')").fetchall()
    key = lambda r: int(r[0])
    assert sorted((tuple(r) for r in text.read_all_text(spark, p, Dialect()).collect()), key=key) == sorted(want, key=key)


@pytest.mark.parametrize("size", [40, 1 << 20])
def test_first_lines_are_numbered_over_blocks(spark, tmp_path, blocks_of_bytes, size):
    """Lines keep their numbers, whatever blocks they lie in, and the sample is the file's beginning."""
    rows = [f"{k}|name {k}|x" for k in range(30)]
    p = put(tmp_path / "p.csv", "\n".join(["A report, made today,", "of all customers, by name", "", "key|name|segment", *rows, *["a;b"] * 300]) + "\n")
    blocks_of_bytes(size)
    first = text.first_lines(spark, p, 34)
    assert [(r.line_no, r.value) for r in first.where("line_no < 5").orderBy("line_no").collect()][3:] == [(3, "key|name|segment"), (4, rows[0])]
    assert first.count() == 34 and text.first_lines(spark, p, 1000).count() == 334
    assert text.infer_dialect(spark, p, 34) == Dialect(delimiter="|", skip=3)
    empty = put(tmp_path / "empty.csv", "")
    assert text.first_lines(spark, empty, 5).collect() == [] and text.infer_dialect(spark, empty) == Dialect(header=False)


def test_inferred_preambles_above_quoted_line_breaks(spark, tmp_path, blocks_of_bytes):
    """The preamble and the header lie in different blocks."""
    name = lambda k: "first, line\nsecond" if k % 7 == 0 else 'a "mark" \n\n' if k % 11 == 0 else f"name {k}"
    body = "".join('{},"{}"\n'.format(k, name(k).replace('"', '""')) for k in range(40))
    p = put(tmp_path / "q.csv", f"Report of customers, all of them, by key and name\n\nmade today or not long before {'.' * 80}\nk,name\n{body}")
    blocks_of_bytes(120)
    d = text.infer_dialect(spark, p)
    assert d == Dialect(skip=3) and text.read_all_text(spark, p, d).columns == ["k", "name"]
    assert {int(r.k): r.name for r in text.read_all_text(spark, p, d).collect()} == {k: name(k) for k in range(40)}


def test_inferred_dialect_is_of_the_first_lines(spark, tmp_path, blocks_of_bytes):
    """Later blocks of another form do not count, in a folder as in a file."""
    for f in "ab":
        put(tmp_path / f"{f}.csv", "\n".join(["A report, made today", f"of all customers {'.' * 90}", "key|name|segment", *[f"{k}|name {k}|x" for k in range(20)], *["'1';'2; 3'"] * 200]) + "\n")
    blocks_of_bytes(100)
    assert text.infer_dialect(spark, str(tmp_path), 23) == Dialect(delimiter="|", skip=2)


def test_first_lines_whatever_order_blocks_are_read_in(spark, tmp_path, blocks_of_bytes, monkeypatch):
    """Blocks read last to first, and several by one task: a preamble is still what stands above the header."""
    p = put(tmp_path / "r.csv", "\n".join(["Report of customers", "", "k,name", *[f'{k},"name {k}"' for k in range(60)]]) + "\n")
    blocks_of_bytes(100)
    read = DataFrameReader.text
    size = os.path.getsize(p)

    def backwards(self, path):
        b, n = (F.col(f"_metadata.file_block_{x}") for x in ("start", "length"))
        whole = read(self, path).select("value", F.struct(b.alias("file_block_start"), n.alias("file_block_length")).alias("_metadata"))
        late = F.col("_metadata.file_block_start") > size // 2
        return whole.where(late).union(whole.where(~late)).coalesce(3)

    want = read(spark.read, p).collect()
    monkeypatch.setattr(DataFrameReader, "text", backwards)
    for n in (3, 40, 1000):
        assert [r.value for r in text.first_lines(spark, p, n).orderBy("line_no").collect()] == [r.value for r in want][:n]
    assert text.infer_dialect(spark, p) == Dialect(skip=2)


def test_dialects_of_the_registered_files_whatever_block_is_read_first(spark, sf_dir, blocks_of_bytes, monkeypatch):
    """The three files of infer_dialect, in small blocks of which the first is read last."""
    read = DataFrameReader.text

    def first_last(self, path):
        b, n = (F.col(f"_metadata.file_block_{x}") for x in ("start", "length"))
        whole = read(self, path).select("value", F.struct(b.alias("file_block_start"), n.alias("file_block_length")).alias("_metadata"))
        return whole.where("_metadata.file_block_start > 0").union(whole.where("_metadata.file_block_start = 0"))

    blocks_of_bytes(400)
    monkeypatch.setattr(DataFrameReader, "text", first_last)
    got = [tuple(r) for r in catalog_files.infer_dialect(spark, sf_dir).collect()]
    assert got == [("comma", ",", '"', True, 0), ("semicolon", ";", "'", False, 0), ("preamble", "|", '"', True, 2)]


def test_arrays_of_a_folder_are_read_in_one_go(spark, tmp_path, blocks_of_bytes):
    """Arrays, empty ones and files of lines beside each other."""
    (tmp_path / "f").mkdir()
    rows = [{"id": k, "s": '} "], [{\\' * (k % 3)} for k in range(60)]
    for i in range(3):
        put(tmp_path / "f" / f"{i}.json", "[" + "\n,".join(json.dumps(r) for r in rows[i * 15 : i * 15 + 15]) + "]\n")
    put(tmp_path / "f" / "3.json", "[]\n")
    put(tmp_path / "f" / "4.json", "".join(json.dumps(r) + "\n" for r in rows[45:]))
    blocks_of_bytes(150)
    for schema in ("id long, s string", None):
        got = tables.read_json(spark, str(tmp_path / "f"), schema)
        assert sorted((r.id, r.s) for r in got.collect()) == [(r["id"], r["s"]) for r in rows]
    (tmp_path / "e").mkdir()
    put(tmp_path / "e" / "0.json", "[]\n")
    assert tables.read_json(spark, str(tmp_path / "e"), "id long").count() == 0

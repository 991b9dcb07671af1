import base64
import json
import os
import random
import struct
import uuid
import zlib

import numpy as np
import pytest

from vistaframe.sources import tables, vectors


def container(values, kind):
    if kind == "run":
        edges = np.flatnonzero(np.diff(values) != 1)
        firsts, lasts = values[np.r_[0, edges + 1]], values[np.r_[edges, len(values) - 1]]
        return struct.pack("<H", len(firsts)) + b"".join(struct.pack("<HH", a, b - a) for a, b in zip(firsts.tolist(), lasts.tolist()))
    if kind == "array":
        return values.astype("<u2").tobytes()
    bits = np.zeros(65536, np.uint8)
    bits[values] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def encoded(rows, runs=False):
    """A vector in the public format, written from its description."""
    rows, out = np.unique(np.array(rows, np.int64)), []
    for high in np.unique(rows >> 32).tolist():
        low = rows[rows >> 32 == high] & 0xFFFFFFFF
        groups = [(key, (low[low >> 16 == key] & 0xFFFF)) for key in np.unique(low >> 16).tolist()]
        kinds = ["run" if runs and k % 2 == 0 else "array" if len(v) <= 4096 else "bitmap" for k, v in groups]
        n = len(groups)
        if runs:
            flags = np.packbits([k == "run" for k in kinds], bitorder="little").tobytes()
            head = struct.pack("<I", 12347 | (n - 1) << 16) + flags
        else:
            head = struct.pack("<II", 12346, n)
        head += b"".join(struct.pack("<HH", k, len(v) - 1) for k, v in groups)
        bodies = [container(v, kind) for (_, v), kind in zip(groups, kinds)]
        if not runs or n >= 4:
            at = len(head) + 4 * n
            for body in bodies:
                head += struct.pack("<I", at)
                at += len(body)
        out.append(struct.pack("<I", high) + head + b"".join(bodies))
    return struct.pack("<Iq", 1681511377, len(out)) + b"".join(out)


@pytest.mark.parametrize("runs", [False, True])
@pytest.mark.parametrize("rows", [[], [0], [5, 6, 7, 70_000], list(range(0, 200_000, 3)), list(range(10, 9000)), [1, 2**16 * k, 2**33 + 9] if (k := 7) else [], list(range(0, 2**19, 2**14 + 1))])
def test_vectors_are_decoded(rows, runs):
    got = vectors.decoded(encoded(rows, runs))
    assert got.tolist() == sorted(set(rows))
    own = vectors.encoded(np.unique(np.array(rows, np.int64)))
    assert own == encoded(rows) and vectors.inline(vectors.as_text(own), len(own)) == own


def test_unknown_formats_are_refused():
    with pytest.raises(ValueError):
        vectors.decoded(b"\0" * 20)
    with pytest.raises(ValueError):
        vectors.decoded(struct.pack("<IqI", 1681511377, 1, 0) + b"\1\2\3\4\5\6\7\x08")


def write_vectors(folder, number, some):
    """A file with several vectors; gives the offset of each."""
    data, offsets = b"\1", []
    for rows in some:
        body = encoded(rows)
        offsets.append(len(data))
        data += struct.pack(">i", len(body)) + body + struct.pack(">I", zlib.crc32(body))
    os.makedirs(folder, exist_ok=True)
    with open(f"{folder}/deletion_vector_{number}.bin", "wb") as f:
        f.write(data)
    return offsets


def data_files(spark, path, n, keys):
    files = []
    for k in range(n):
        df = spark.range(100 * k, 100 * k + 100).selectExpr("id", f"{k % 2} as k")
        (df.drop("k") if keys else df).coalesce(1).write.parquet(f"{path}/tmp{k}")
        made = next(x for x in os.listdir(f"{path}/tmp{k}") if x.endswith(".parquet"))
        name = f"k={k % 2}/part {k}.parquet" if keys == "folders" else f"part {k}+.parquet"
        os.makedirs(os.path.dirname(f"{path}/{name}"), exist_ok=True)
        os.rename(f"{path}/tmp{k}/{made}", f"{path}/{name}")
        files.append(name)
    return files


def quoted(name):
    return name.replace(" ", "%20")


@pytest.mark.parametrize("keys", [None, "folders", "log"])
def test_rows_in_vectors_are_left_out(spark, tmp_path, keys, monkeypatch):
    """Vectors in the log, in a file beside the data, in one of another folder named in full, and files without one; two versions."""
    p = str(tmp_path / "t")
    files = data_files(spark, p, 5, keys)
    number, far, rng = uuid.uuid4(), uuid.uuid4(), random.Random(3)
    gone = [sorted(rng.sample(range(100), n)) for n in (7, 50, 1, 99)]
    a, b = write_vectors(f"{p}/ab", number, gone[:2])
    (c,) = write_vectors(str(tmp_path / "far"), far, [gone[2]])
    named = "ab" + base64.z85encode(number.bytes).decode()
    raw = encoded(gone[3])
    text = base64.z85encode(raw + b"\0" * (-len(raw) % 4)).decode()
    make = lambda kind, text, offset, rows, size=0: {"storageType": kind, "pathOrInlineDv": text, "offset": offset, "sizeInBytes": size, "cardinality": len(rows)}
    marks = [make("u", named, a, gone[0]), make("u", named, b, gone[1]), make("p", f"{tmp_path}/far/deletion_vector_{far}.bin", c, gone[2]), make("i", text, None, gone[3], len(raw)), None]
    os.makedirs(f"{p}/_delta_log")
    schema = spark.range(1).selectExpr("id", "1 as k").schema.json()
    add = lambda k, v: {"add": {"path": quoted(files[k]), "partitionValues": {"k": str(k % 2)} if keys else {}, "deletionVector": v}}
    log = [[{"metaData": {"schemaString": schema, "partitionColumns": ["k"] if keys else [], "configuration": {}}}, *(add(k, None) for k in range(5))],
           [x for k in range(4) for x in ({"remove": {"path": quoted(files[k])}}, add(k, marks[k]))]]
    for v, rows in enumerate(log):
        with open(f"{p}/_delta_log/{v:020d}.json", "w") as f:
            f.write("\n".join(map(json.dumps, rows)))
    left = {(100 * k + i, k % 2) for k in range(5) for i in range(100) if k == 4 or i not in gone[k]}
    for most in (1_000_000, 3):
        monkeypatch.setattr(tables, "BROADCAST_DELETED", most)
        got = [tuple(r) for r in tables.read_log_table(spark, p).select("id", "k").collect()]
        assert len(got) == len(left) and set(got) == left
    assert tables.read_log_table(spark, p, version=0).count() == 500
    with open(f"{p}/ab/deletion_vector_{number}.bin", "r+b") as f:
        f.seek(12)
        f.write(b"\xff")
    with pytest.raises(Exception, match="damaged"):
        tables.read_log_table(spark, p).count()


@pytest.mark.parametrize("kind", ["parquet", "json"])
def test_checkpoints_with_sidecars(spark, tmp_path, kind):
    p = str(tmp_path / "t")
    files = data_files(spark, p, 4, None)
    schema, log = spark.range(1).selectExpr("id", "1 as k").schema.json(), f"{p}/_delta_log"
    meta = {"metaData": {"schemaString": schema, "partitionColumns": [], "configuration": {}}}
    add = lambda k: {"add": {"path": quoted(files[k]), "partitionValues": {}}}
    os.makedirs(f"{log}/_sidecars")

    def parquet(rows, to, more=""):
        df = spark.read.schema(tables._LOG + more).json(spark.sparkContext.parallelize(list(map(json.dumps, rows)), 1))
        df.write.parquet(f"{to}.tmp")
        made = next(x for x in os.listdir(f"{to}.tmp") if x.endswith(".parquet"))
        os.rename(f"{to}.tmp/{made}", to)

    for n, k in enumerate((0, 1)):
        parquet([add(k)], f"{log}/_sidecars/s{n}.parquet")
    top = [meta, {"sidecar": {"path": "s0.parquet"}}, {"sidecar": {"path": "s1.parquet"}}]
    name = f"{log}/{5:020d}.checkpoint.{uuid.uuid4()}.{kind}"
    if kind == "json":
        with open(name, "w") as f:
            f.write("\n".join(map(json.dumps, top)))
    else:
        parquet(top, name, ", sidecar struct<path: string>")
    for v, rows in ((6, [add(2)]), (7, [{"remove": {"path": quoted(files[0])}}, add(3)])):
        with open(f"{log}/{v:020d}.json", "w") as f:
            f.write("\n".join(map(json.dumps, rows)))
    ids = lambda **x: {r.id // 100 for r in tables.read_log_table(spark, p, **x).collect()}
    assert ids() == {1, 2, 3} and ids(version=6) == {0, 1, 2} and ids(version=5) == {0, 1}

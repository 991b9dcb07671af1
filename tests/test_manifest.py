import datetime
import decimal
import threading

from vistaframe.functions.model import Filter, QuerySpec, Sort
from vistaframe.sources import shared, snapshots

NOW = datetime.datetime(2026, 1, 2, 3, 4, 5, 678, tzinfo=datetime.UTC)


def row(name, n=1):
    return (name, f"/p/{name}", "/s", f"t{n}", ["a", "b"], n, NOW, None)


def test_two_writers_keep_both_rows(spark, tmp_path):
    a, b = (snapshots.Manifest(spark, str(tmp_path / "m")) for _ in range(2))
    assert a.rows().count() == 0
    a.put(row("x"))
    b.put(row("y"))
    a.put(row("z"))
    b.put(row("x", 2))
    for m in (a, b, snapshots.Manifest(spark, str(tmp_path / "m"))):
        assert {r.name: (r.bytes, r.token, list(r.columns)) for r in m.rows().collect()} == {n: (k, f"t{k}", ["a", "b"]) for n, k in (("x", 2), ("y", 1), ("z", 1))}
    assert a.find("x").last_used == snapshots.Manifest(spark, str(tmp_path / "m")).find("y").last_used
    assert a.find("none") is None


def test_writers_at_once(spark, tmp_path):
    folder = str(tmp_path / "m")
    threads = [threading.Thread(target=lambda k=k: snapshots.Manifest(spark, folder).put(row(f"n{k}", k))) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert {r.name for r in snapshots.Manifest(spark, folder).rows().collect()} == {f"n{k}" for k in range(8)}


def test_a_taken_name_stays(spark, tmp_path):
    p = str(tmp_path / "f" / "c.json")
    assert shared.put_if_absent(spark, p, "one\n") and not shared.put_if_absent(spark, p, "two\n")
    assert (tmp_path / "f" / "c.json").read_text() == "one\n" and not [x for x in (tmp_path / "f").iterdir() if not x.name.startswith((".c.json", "c.json"))]
    assert not [x for x in (tmp_path / "f.new").iterdir() if not x.name.endswith(".crc")]


def test_checkpoints(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(snapshots.Manifest, "CHECKPOINT", 3)
    m = snapshots.Manifest(spark, str(tmp_path / "m"))
    for k in range(7):
        m.put(row(f"n{k % 5}", k))
    one, whole = m._commits()
    assert sorted(whole) == [3, 6] and len(one) == 7
    for n in (1, 2, 4):
        shared.delete(spark, one[n])
    assert {r.name: r.bytes for r in m.rows().collect()} == {"n0": 5, "n1": 6, "n2": 2, "n3": 3, "n4": 4}


def test_values_of_filters_keep_their_types():
    spec = QuerySpec((Filter("d", "between", (datetime.date(2026, 1, 2), datetime.date(2026, 2, 3))), Filter("t", ">", (NOW,)), Filter("n", "in", (decimal.Decimal("1.50"), None, 3, "x", True))), (Sort("d", True),))
    assert snapshots._read(snapshots._written(spec)) == spec

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from vistaframe.llm import fingerprint as fp


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_query_against_plain_python(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in fp.op10_fingerprint(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    ids = sorted(rows, reverse=True)
    off = 0
    for i, d in enumerate(ids):
        after = ids[(i + 1) % len(ids)]
        t, k = rows[d], len(rows[d]) // 3
        edited = t[: len(t) - k] + rows[after][:k]
        assert got[d].n_chars == len(t)
        assert got[d].edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
        a, b, c = shingles(t), shingles(edited), shingles(rows[after])
        assert abs(got[d].near_edited - len(a & b) / len(a | b)) < 0.3
        assert abs(got[d].near_next - len(a & c) / len(a | c)) < 0.3
        off += abs(got[d].near_edited - len(a & b) / len(a | b))
        assert len(a) >= fp.K or got[d].n_distinct == len(a)
    assert off / len(ids) < 0.06


def plain(rows):
    """(doc_id, edited text, next text) of rows (doc_id, text), where no id has two texts."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is None, -(r[0] or 0)))
    out = []
    for (i, t), (_, u) in zip(rows, rows[1:] + rows[:1]):
        k = len(t) // 3
        out.append((i, t[: len(t) - k] + u[:k], u))
    return out


@pytest.mark.parametrize("rows", [
    [(i * i, f"t{i} " * (i % 7)) for i in range(100)] + [(None, "a null id é")],
    [(5, "one two three")],
    [(5, "one two three")] * 4,
    [(5, "one two three")] * 40 + [(7, None), (3, ""), (3, ""), (None, "x" * 30), (None, "x" * 30), (9, "word " * 60_000)],
    [],
])
def test_any_rows_against_plain_python(spark, tmp_path, rows):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'mine' as hash", "1 as rows", "2 as part", "3 as copies", "4 as n_chars")
    df.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = fp.op10_fingerprint(spark, str(tmp_path)).collect()
    want = plain(rows)
    assert sorted(((r.doc_id, r.edited_sha256) for r in got), key=str) == sorted(((i, hashlib.sha256(e.encode()).hexdigest()) for i, e, _ in want), key=str)
    texts = {i: t or "" for i, t in rows}
    for r in got:
        a = shingles(texts[r.doc_id])
        assert r.n_chars == len(texts[r.doc_id]) and (len(a) >= fp.K or r.n_distinct == len(a)) and 0 <= r.contained <= 1
    likeness = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    small = [(i, e, u) for i, e, u in want if max(map(len, (e, u))) < 200]
    assert all(any(r.doc_id == i and r.near_next == pytest.approx(likeness(shingles(texts[i]), shingles(u))) and
                   r.n_distinct_both == len(shingles(texts[i]) | shingles(u)) for r in got) for i, _, u in small if len(texts[i]) < 200)


def test_texts_of_one_id_all_stay(spark, tmp_path):
    rows = [(1, f"text number {i % 7}") for i in range(21)] + [(2, "two")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = [fp.op10_fingerprint(spark, str(tmp_path)).collect() for _ in range(2)]
    assert len(got[0]) == 22 and sorted(got[0]) == sorted(got[1])


def test_edges_merge_and_containment(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "a"), (4, "a"), (5, " ".join(map(str, range(5000))))], "doc_id long, text string")
    got = {r.doc_id: r for r in df.withColumn("sketch", fp.sketch(F.col("text"))).collect()}
    assert got[1].sketch == [] and got[2].sketch == [] and got[3].sketch == got[4].sketch and len(got[5].sketch) == fp.K
    a, b = " ".join(map(str, range(3000))), " ".join(map(str, range(1500)))
    x = spark.createDataFrame([(a, b)], "a string, b string").select(fp.sketch(F.col("a"), 512).alias("a"), fp.sketch(F.col("b"), 512).alias("b"))
    r = x.select(fp.containment(F.col("b"), F.col("a"), 512).alias("c"), fp.resemblance(F.col("a"), F.col("b"), 512).alias("j"),
                 fp.distinct_count(F.col("a"), 512).alias("n"), fp.merge(F.col("a"), F.col("b"), 512).alias("m"), "a").first()
    assert r.c > 0.85 and r.j == pytest.approx(0.5, abs=0.1) and r.n == pytest.approx(2996, rel=0.15) and r.m == r.a
    halves = spark.createDataFrame([("g", a), ("g", b)], "k string, t string").withColumn("sketch", fp.sketch(F.col("t")))
    assert fp.merged(halves, ["k"]).first().sketch == spark.createDataFrame([(a,)], "t string").select(fp.sketch(F.col("t"))).first()[0]
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert fp.neighbours(empty, lambda t: t).collect() == []
    parts = halves.repartition(2).withColumn("g", F.lit(1))
    assert fp.merged(parts, ["g"]).first().sketch == fp.merged(parts.limit(1), ["g"]).unionByName(fp.merged(parts.exceptAll(parts.limit(1)), ["g"])).transform(lambda d: fp.merged(d, ["g"])).first().sketch

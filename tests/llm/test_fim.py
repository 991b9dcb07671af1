import hashlib
import random

import pytest

from vistaframe.llm import fim

TEXT = "".join(random.Random(1).choices("abcd <>PSMé数😀\n", k=1000))
PLAIN = TEXT.replace("<", "(")


def brute(doc_id, text):
    """(form, output, prefix, middle) as the rule says."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(digest[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return "plain", text, None, None
    p, m, s = text[:a], text[a:b], text[b:]
    return ("spm", f"<S>{s}<P>{p}<M>{m}", a, b - a) if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}", a, b - a)


@pytest.mark.parametrize("size", [1, 2, 3, 7, 64, 5000])
def test_frames_are_seekable(size):
    f = fim.Frames.of(TEXT, size)
    assert len(f) == len(TEXT) and f.text() == TEXT and f.sha256() == hashlib.sha256(TEXT.encode()).hexdigest()
    rng = random.Random(size)
    for _ in range(60):
        a, b = sorted((rng.randrange(1001), rng.randrange(1001)))
        part = f.part(a, b)
        assert part.text() == TEXT[a:b] and len(part) == b - a
    assert f.find(["<P>", "<", "none", "😀"]) == {m: TEXT.find(m) for m in ("<P>", "<", "😀") if m in TEXT}


def test_a_cut_opens_no_more_than_two_frames(monkeypatch):
    f = fim.Frames.of(TEXT, 10)
    opened, real = [], fim._opened
    monkeypatch.setattr(fim, "_opened", lambda x: opened.append(x) or real(x))
    part = f.part(5, 995)
    assert len(opened) == 2 and part.frames[1:-1] == f.frames[1:-1]


@pytest.mark.parametrize("size", [1, 5, 1000, 65536])
def test_outputs_and_back(size):
    forms = set()
    texts = [PLAIN, "<", "<S", "P>", "<<<", "a<P", "S><M", "", "x", "a<P>b", PLAIN[:7], "é" * 20 + "<"]
    for k in range(400):
        text = texts[k % len(texts)]
        form, out, a, m = fim.transformed(k, fim.Frames.of(text, size))
        assert (form, out.text(), a, m) == brute(k, text)
        assert fim.restored(form, out).text() == text
        assert fim.restored(form, fim.Frames.of(out.text(), 3)).text() == text  # from output and form alone
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}


def test_tables(spark):
    rows = [(k, PLAIN[: k * 7 % 400], "x", k) for k in range(60)] + [(60, None, "x", 60), (61, "", "x", 61), (None, PLAIN, "x", 62), (3, "again", "x", 63), (3, "again", "x", 64)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ends string, at long").repartition(3)
    framed = fim.framed(df, 16)
    assert framed.columns == ["doc_id", "at", "frames", "ends"]
    assert {r["at"]: r.text for r in fim.texts(framed).collect()} == {r[3]: r[1] or "" for r in rows}
    out = fim.fill_in_middle(framed)
    assert {r["at"]: (r.form, r.text, r.prefix_chars, r.middle_chars) for r in fim.texts(out).collect()} == {r[3]: brute(r[0], r[1] or "") for r in rows}
    assert {r["at"]: r.text for r in fim.texts(fim.undone(out)).collect()} == {r[3]: r[1] or "" for r in rows}
    assert all(r.n == len(rows[r["at"]][1] or "") for r in out.collect())
    assert fim.digests(fim.fill_in_middle(fim.framed(df.limit(0)))).collect() == []


def test_very_long_texts():
    text = "word é " * 500_000
    f = fim.Frames.of(text)
    form, out, a, m = fim.transformed(2, f)
    want = brute(2, text)
    assert (form, out.sha256(), a, m) == (want[0], hashlib.sha256(want[1].encode()).hexdigest(), *want[2:])
    assert fim.restored(form, out).sha256() == f.sha256()


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = fim.op13_fim(spark, sf_dir).collect()
    assert len(got) == len(docs)
    for r in got:
        form, out, a, m = brute(r.doc_id, docs[r.doc_id])
        assert (r.n, r.form, r.prefix_chars, r.middle_chars, r.output_sha256, r.restored_sha256) == (len(docs[r.doc_id]), form, a, m, sha(out), sha(docs[r.doc_id]))

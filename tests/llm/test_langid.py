import numpy as np
import pytest

from vistaframe.llm import langid


def test_pages_of_the_given_table(spark, sf_dir):
    got = langid.op9_langid(spark, sf_dir).collect()
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    assert len(got) == pages.count()
    assert np.mean([r.lang == r.declared for r in got]) > 0.97 and all(0 < r.confidence <= 1 for r in got)


def test_text_alone_tells_held_out_documents_apart(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = langid.train(docs.where("doc_id % 5 <> 0"))
    held = [r for r in docs.where("doc_id % 5 = 0").collect() if len(r.text) > 100]
    right = [model.langs[int(np.argmax(model.likelihood(r.text)))] == r.lang for r in held]
    assert np.mean(right) > 0.9


DOCS = [(f"the and with this {w}ing", "en") for w in "abcdefgh"] + [(f"der und nicht das {w}ung", "de") for w in "abcdefgh"]


def brute(pages, model):
    """The same fusion in plain Python, page by page."""
    import math
    import re

    rows, langs = [], model.langs
    for i, url, html in pages:
        host = re.match(r"https?://([^/:]+)", url or "")
        host = host[1].lower() if host else None
        d = re.search(r'<html lang="(\w+)"', html or "")
        text = model.likelihood(langid.visible(html))
        s = langid.SUFFIXES.get(host.split(".")[-1]) if host else None
        labels = host.split(".") if host else []
        n = 3 if len(labels) > 2 and len(labels[-1]) == 2 and labels[-2] in ("co", "com", "org", "net", "ac", "gov", "edu") else 2
        rows.append({"id": i, "host": host, "domain": ".".join(labels[-n:]) or None, "worded": any(text), "declared": d and d[1], "suffix": s, "own": text})
    norm = lambda x: [math.exp(v - max(x)) / sum(math.exp(u - max(x)) for u in x) for v in x]
    for r in rows:
        r["seen"] = norm(r["own"])
    for c in ("declared", "suffix"):
        have = [r for r in rows if r[c] in langs]
        shown = [r for r in have if r["worded"]]
        t = min(0.98, (sum(r["seen"][langs.index(r[c])] for r in shown) + 4) / (len(shown) + 5))
        for r in have:
            r["own"] = [v + math.log(t if x == r[c] else max((1 - t) / (len(langs) - 1), 1e-9)) for v, x in zip(r["own"], langs)]
    for r in rows:
        r["seen"] = norm(r["own"])
    k, size = langid.PRIOR_PAGES, len(langs)
    top = [(sum(r["seen"][j] for r in rows) + 1) / (len(rows) + size) for j in range(size)]
    for r in rows:
        p = top
        for level in ("domain", "host") if r["host"] else ():
            other = [q for q in rows if q[level] == r[level]]
            p = [(max(0, sum(q["seen"][j] for q in other) - r["seen"][j]) + k * p[j]) / (len(other) - 1 + k) for j in range(size)]
        r["p"] = norm([v + math.log(max(x, 1e-12)) for v, x in zip(r["own"], p)])
    return {r["id"]: r["p"] for r in rows}


def test_fusion_equals_plain_python(spark):
    pages = [(i, f"http://{h}/x{i}", f"<html{lang}><p>{t}</p></html>") for i, (h, lang, t) in enumerate([
        ("a.example.de", ' lang="de"', "der und das"), ("a.example.de", "", "nicht und"), ("b.example.de", ' lang="en"', ""), ("b.example.de", "", ""),
        ("x.example.org", ' lang="en"', "the with this"), ("x.example.org", "", ""), ("y.other.org", ' lang="xx"', "with the and"), ("z.org", ' lang="en"', "der"),
        ("a.one.co.uk", "", "the with"), ("b.one.co.uk", "", "this"), ("two.co.uk", "", "der"), ("two.co.uk", "", "der"), ("co.uk", "", "and"),
    ])] + [(90, None, None), (91, "no address", "<p>this"), (92, "http://A.example.de:80/", ""), (93, "http://long.de/", "<p>" + "der und " * 100_000)] * 1 + [(94, "http://long.de/", "x")] * 2
    p = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'x' as host", "1 as n")
    d = spark.createDataFrame(DOCS + [(None, "en"), ("x", None)], "text string, lang string")
    got, want = {r.page_id: r for r in langid.identify(p, d).collect()}, brute(pages, langid.train(d))
    assert got.keys() == want.keys()
    for i, probs in want.items():
        assert got[i].confidence == pytest.approx(max(probs)), i
        assert got[i].lang == ["de", "en"][int(np.argmax(probs))]
    assert got[3].lang == "de" and got[5].lang == "en"


def test_visible_text():
    assert langid.visible("<style>p{}</style><script>var t='</p>';</script><p>a &amp; b<!-- c --></p>").split() == ["a", "&", "b"]


def test_nothing_to_learn_from(spark):
    p = spark.createDataFrame([(1, "http://a.de/", "<p>x")], "page_id long, url string, html string")
    d = spark.createDataFrame([], "text string, lang string")
    assert [r.lang for r in langid.identify(p, d).collect()] == [None]
    some = spark.createDataFrame(DOCS, "text string, lang string")
    assert langid.identify(p.limit(0), some).collect() == []

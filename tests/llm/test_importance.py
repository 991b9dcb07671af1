import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from vistaframe.llm import importance as im
from vistaframe.llm.asciiwords import LOWER, PATTERN

WORD = re.compile(PATTERN)


def words(text):
    return WORD.findall((text or "").encode().translate(LOWER).decode())


def runs(text, orders):
    w = words(text)
    return [" ".join(w[k : k + n]) for n in range(orders[0], orders[1] + 1) for k in range(len(w) - n + 1)]


def brute(docs, target, orders=(1, 1), buckets=10_000, least=20, percent=10, seed="2024"):
    """(n_features, weight, score, rank) of each row, with ties by id and then by place."""
    bucket = lambda x: zlib.crc32(x.encode()) % buckets
    s, t = (Counter(bucket(x) for text in texts for x in runs(text, orders)) for texts in ([d for _, d in docs], target))
    big_s, big_t = sum(s.values()) + buckets, sum(t.values()) + buckets
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * big_s / ((s[b] + 1) * big_t)))
    rows = []
    for doc_id, text in docs:
        own = [gain(bucket(x)) for x in runs(text, orders)]
        h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        weight = sum(own) // len(own) if own else 0
        rows.append((len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = [k for k, (_, d) in enumerate(docs) if len(words(d)) >= least]
    order = sorted(may, key=lambda k: (-rows[k][2], docs[k][0] is None, docs[k][0] or 0, k))
    rank = {k: i + 1 for i, k in enumerate(order[: percent * len(may) // 100])}
    return [(*r, rank.get(k)) for k, r in enumerate(rows)]


def text(rng, n, vocabulary="the of Data é straße 42 x-ray don't 数据 end".split()):
    return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n\n", "--"]) for _ in range(n))


@pytest.mark.parametrize("orders", [(1, 1), (1, 2), (2, 3)])
def test_equals_plain_counts(spark, orders):
    rng = random.Random(5)
    docs = [(k, text(rng, rng.randrange(60))) for k in range(300)] + [(300, None), (301, ""), (302, " .;"), (None, text(rng, 50)), (None, text(rng, 50)), (7, "again " * 25)]
    target = [text(rng, 30, ["data", "end", "new"]) for _ in range(5)] + [None, ""]
    rows = spark.createDataFrame([(i, t, k, k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, score long, at long").coalesce(1)
    got = im.ranked(im.scored(rows, spark.createDataFrame([(t,) for t in target], "text string"), orders=orders), percent=25)
    assert got.columns == ["doc_id", "at", "n_words", "n_features", "weight", "score", "rank"]
    found = {r["at"]: (r.n_features, r.weight, r.score, r.rank) for r in got.collect()}
    want = brute(docs, target, orders, percent=25)
    assert [found[k] for k in range(len(docs))] == want
    assert sum(r[3] is not None for r in want) > 30


def test_repeated_rows_have_ranks_of_their_own(spark):
    rows = spark.createDataFrame([(4, "a " * 20)] * 50 + [(1, "b " * 20)] * 50, "doc_id long, text string").repartition(4)
    got = im.ranked(im.scored(rows, spark.createDataFrame([("b",)], "text string")), percent=50).collect()
    assert len(got) == 100 and sorted(r.rank for r in got if r.rank) == list(range(1, 51))
    assert len({r.doc_id for r in got if r.rank}) == 1


def test_empty_tables_and_texts(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    one = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert im.ranked(im.scored(none, one)).collect() == []
    r = im.ranked(im.scored(one, none)).first()
    assert (r.n_features, r.weight, r.score, r.rank) == (0, 0, im.noise(1), None)


@pytest.mark.parametrize("piece", [7, 50, 200_000])
def test_long_texts_are_cut_between_words(monkeypatch, piece):
    monkeypatch.setattr(im, "PIECE", piece)
    rng = random.Random(piece)
    t = text(rng, 300) + "y" * 120 + " é" + "z" * 60
    data = t.encode().translate(LOWER)
    assert [data[a:b].decode() for a, b in im.offsets(data)] == words(t)


def test_drawn_documents_lean_to_the_target(spark):
    rng = random.Random(2)
    docs = [(k, " ".join(rng.choices(["good", "fine"] if k % 4 == 0 else ["bad", "poor"], k=30))) for k in range(400)]
    df = spark.createDataFrame([(*d, "s") for d in docs], "doc_id long, text string, source string")
    got = im.drawn(df, spark.createDataFrame([("good fine",)] * 2000, "text string"), buckets=50).collect()
    assert len(got) == 40 and sum(r.doc_id % 4 == 0 for r in got) >= 38
    assert all(r.text == docs[r.doc_id][1] and r.source == "s" for r in got)


def test_query_equals_plain_counts(spark, sf_dir):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    target = [r.text for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    got = {r.doc_id: (r.n_features, r.weight, r.score, r["rank"]) for r in im.op12_importance(spark, sf_dir).collect()}
    assert [got[i] for i, _ in docs] == brute(docs, target) and len(got) == len(docs)

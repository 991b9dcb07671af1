import hashlib
import random

import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vistaframe.llm import bpe

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def ids(text):
    return LIBRARY.encode(text, add_special_tokens=False).ids


def test_query_equals_the_library(spark, sf_dir):
    rows = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bpe.op7_bpe(spark, sf_dir).collect()}
    assert got.keys() == rows.keys()
    for d, text in rows.items():
        want = ids(text)
        back = LIBRARY.decode(want, skip_special_tokens=False)
        assert got[d].n_tokens == len(want)
        assert got[d].ids_sha256 == hashlib.sha256(",".join(map(str, want)).encode()).hexdigest()
        assert got[d].decoded_sha256 == hashlib.sha256(back.encode()).hexdigest()


@settings(max_examples=300, deadline=None)
@given(st.lists(st.text(alphabet="ab 's\n\t1é漢!  ", max_size=9), min_size=1, max_size=6))
def test_any_cut_is_repaired(parts):
    parts = [p for p in parts if p] or ["a"]
    encode = lambda s: bpe.encoder().encode(s, allowed_special="all")
    assert bpe.joined(parts, encode, encode) == ids("".join(parts))


def test_long_texts_are_cut_by_content_and_reuse_chunks():
    rng = random.Random(3)
    words = ["the", "éléphant", "of", "x1", "hello,", "<|endoftext|>", "  ", "\n"]
    shared = " ".join(rng.choice(words) for _ in range(20000))
    a, b = "start " + shared, "another beginning, " + shared
    e = bpe.Encoder()
    assert len(bpe.cuts(a)) > 20 and e(a) == ids(a)
    calls = []
    e.chunks.encode = lambda s: calls.append(s) or e.encode(s)
    assert e(b) == ids(b) and sum(map(len, calls)) < 0.1 * len(b)


def test_edges(spark):
    data = [(1, None), (2, ""), (3, " "), (3, " "), (None, "x<|endoftext|>y"), (4, "漢字" * 3000)]
    df = spark.createDataFrame(data, "doc_id long, text string").selectExpr("*", "'mine' as ids", "1 as decoded")
    got = bpe.decode(bpe.encode(df)).collect()
    assert len(got) == len(data)
    for r in got:
        assert r.ids == ids(r.text or "") and r.decoded == (r.text or "")
    assert bpe.digests(df.limit(0), "doc_id").collect() == []


@pytest.mark.parametrize("n", [0, 63, 64, 65, 5000])
def test_cuts_are_places_in_the_text(n):
    text = ("é wörd " * 1000)[:n]
    assert all(0 < c < len(text) and text[c] == " " for c in bpe.cuts(text))


def test_texts_are_encoded_in_small_runs():
    texts = [None, "", *["some words, " * n for n in (5_000, 20_000, 1, 90_000, 30_000, 1, 10)], None] + ["é word " * 9_000] * 12
    batch = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": pa.array(texts, pa.string())})
    out = list(bpe._both(iter([batch, batch.slice(0, 0), batch.slice(3, 2)])))
    rows = [r for b in out for r in b.to_pylist()]
    assert [r["doc_id"] for r in rows] == [*range(len(texts)), 3, 4]
    for r in rows:
        assert r["ids"] == ids(texts[r["doc_id"]] or "") and r["decoded"] == (texts[r["doc_id"]] or "")
    sizes = [[len(r["decoded"].encode()) for r in b.to_pylist()] for b in out]
    assert all(sum(x[1:]) <= bpe.TAKEN for x in sizes) and max(map(len, sizes)) > 1

import hashlib

import corpus_pipeline
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from vistaframe.llm import pii

from .test_minhash import brute

LIBRARY = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def test_each_stage_against_plain_python(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, tables = docs.columns, [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, tables[-1], sf_dir).write.parquet(f"{tmp_path}/{name}")
        tables.append(spark.read.parquet(f"{tmp_path}/{name}"))
    assert all(t.columns == columns for t in tables[:-1])
    start, clean, single, hidden, mixed, encoded = ([r.asDict() for r in t.collect()] for t in tables)

    by_id = {r["doc_id"]: r for r in start}
    assert all(by_id[r["doc_id"]] == r for r in clean)
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf_dir}/labels.parquet").where("toxic = 1").collect()}
    assert len(start) * 0.8 < len(clean) < len(start)
    gone = by_id.keys() - {r["doc_id"] for r in clean}
    assert len(gone & toxic) > len(gone - toxic)

    want = {i for i, _, c, kept in brute([(r["doc_id"], r["text"]) for r in clean], size=5) if kept}
    assert {r["doc_id"] for r in single} == want and len(single) == len(want) < len(clean)

    plain = {r["doc_id"]: r["text"] for r in single}
    assert len(hidden) == len(single)
    for r in hidden:
        assert r["text"] == pii.replaced(plain[r["doc_id"]], corpus_pipeline.PII_KEY)[0] and r["n_chars"] == len(r["text"])

    texts = {r["doc_id"]: r for r in hidden}
    times = {}
    for r in mixed:
        assert r == texts[r["doc_id"]]
        times[r["doc_id"]] = times.get(r["doc_id"], 0) + 1
    assert max(times.values()) <= 2
    words = lambda rows: sum(len(r["text"].split()) for r in rows)
    most = max(len(r["text"].split()) for r in hidden)
    assert 1.5 * words(hidden) - 20 * most < words(mixed) <= 1.5 * words(hidden)

    assert len(encoded) == len(mixed)
    for r in encoded:
        ids = LIBRARY.encode(texts[r["doc_id"]]["text"], add_special_tokens=False).ids
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(texts[r["doc_id"]]["text"].encode()).hexdigest()

    again = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).collect()))
    assert again == sorted(tuple(r.values()) for r in encoded)


def test_stages_take_an_empty_table(spark, sf_dir, tmp_path):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, sf_dir).count() == 0, name


def test_stages_take_nulls_repeats_and_clashing_names(spark, sf_dir, tmp_path):
    extra = "'x' as score, 'p' as pii, 7 as size, 't' as target, 'i' as _id, 'n' as node, 'b' as band, 's' as s, 'd' as ids, 'r' as rank"
    rows = [(1, "mail bosbt.42@mail8.example.com now", "en", "a", 35), (1, "mail bosbt.42@mail8.example.com now", "en", "a", 35), (2, None, None, None, None),
            (None, "", "de", "b", 0), (None, "one two three four five six", None, None, 27), (3, "One two three four five six", "en", "b", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").selectExpr("*", *extra.split(", "))
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name != "bpe":
            assert out.columns[-10:] == ["score", "pii", "size", "target", "_id", "node", "band", "s", "ids", "rank"], name
            assert all(tuple(r)[-10:] == ("x", "p", 7, "t", "i", "n", "b", "s", "d", "r") for r in out.collect()), name
            docs = out
        if name == "near_dedup":
            assert sorted(((r.doc_id, r.text) for r in out.collect()), key=str) == sorted([rows[0][:2], rows[2][:2], rows[3][:2], rows[5][:2]], key=str)
        if name == "pii":
            assert not [r for r in out.collect() if "bosbt.42" in (r.text or "")] and {r.n_chars for r in out.where("doc_id = 2").collect()} == {None}
    assert out.count() == docs.count() > 0


def test_no_text_is_lost_with_another_of_its_id(spark, sf_dir):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    data = [(5, a, "en"), (5, b, "en"), (3, b, "de"), (7, a, "en"), (3, b, "de"), (None, a, "fr")]
    docs = spark.createDataFrame([(*r, "s", len(r[1])) for r in data], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.near_copies_out(spark, docs, sf_dir)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text, r.lang) for r in out.collect()), key=str) == sorted([data[0], data[2]], key=str)


def test_repeated_rows_go(spark, sf_dir):
    a, b = "one two three four five six", "seven eight nine ten eleven twelve"
    data = [(1, a, "en")] * 3 + [(None, b, "x")] * 3 + [(2, None, "en"), (2, "", "en"), (2, "", "de"), (2, None, "en"), (4, "other words", "en"), (4, "other words", "de")]
    docs = spark.createDataFrame([(*r, "s", 1) for r in data], "doc_id long, text string, lang string, source string, n_chars long").withColumn("m", F.create_map(F.lit("k"), "lang"))
    got = [sorted(((r.doc_id, r.text, r.lang, r.m["k"]) for r in corpus_pipeline.near_copies_out(spark, d, sf_dir).collect()), key=str) for d in (docs, docs.orderBy(F.desc("lang")))]
    assert got[0] == got[1] == sorted([(1, a, "en", "en"), (None, b, "x", "x"), (2, None, "en", "en"), (2, "", "de", "de"), (4, "other words", "de", "de")], key=str)


def test_key_of_the_session(spark, sf_dir):
    docs = spark.createDataFrame([(1, "mail bosbt.42@mail8.example.com now", "en", "a", 35)], "doc_id long, text string, lang string, source string, n_chars long")
    one = corpus_pipeline.pseudonyms(spark, docs, sf_dir).first().text
    spark.conf.set("spark.vistaframe.pii.key", "mine")
    try:
        assert corpus_pipeline.pseudonyms(spark, docs, sf_dir).first().text == pii.replaced(docs.first().text, "mine")[0] != one
    finally:
        spark.conf.unset("spark.vistaframe.pii.key")


def test_values_of_any_length_pass_through_every_stage(spark, sf_dir, tmp_path):
    text = "mail " + "abcXYZ019" * 20_000 + "@ex.com " + "word " * 50_000
    docs = spark.createDataFrame([(i, text + str(i % 2), "en", "s", len(text)) for i in range(3)], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() >= 1

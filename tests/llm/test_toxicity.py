import random
import zlib

import numpy as np
import pytest

from vistaframe.llm import toxicity

CLEAN = "river stone garden music window bread market train summer letter".split()
BAD = "grumblax snorvek plofing dretchy".split()


def corpus(n=600, identity=False):
    rng, docs, labels = random.Random(1), [], []
    for i in range(n):
        toxic = int(i % 5 == 0)
        words = [rng.choice(CLEAN) + rng.choice("abcdefgh") for _ in range(rng.randint(5, 60))]
        if toxic and not (identity and i % 10):
            words += rng.sample(BAD, 2)
        if identity and (toxic or i % 40 == 1):
            words.append(rng.choice(["gay", "lesbian"]) if toxic or i % 80 == 1 else "straight")
        rng.shuffle(words)
        docs.append((i, " ".join(words)))
        labels.append((i, toxic))
    return docs, labels


def frames(spark, docs, labels):
    return spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")


def test_held_out_documents_are_told_apart(spark, tmp_path):
    docs, labels = corpus()
    d, lab = frames(spark, docs + [(None, None), (9999, ""), (3, docs[3][1])], labels + labels[:5] + [(None, 1), (7, None)])
    d.selectExpr("*", "'x' as score").write.parquet(f"{tmp_path}/documents.parquet")
    lab.write.parquet(f"{tmp_path}/labels.parquet")
    got = toxicity.op4_toxicity(spark, str(tmp_path)).collect()
    assert len(got) == len(docs) + 3
    truth = dict(labels)
    for r in got:
        assert r.held_out == (zlib.crc32(str(r.doc_id if r.doc_id is not None else "").encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5)
        if r.doc_id in truth and r.held_out:
            assert r.predicted == truth[r.doc_id]
    assert [r.predicted for r in got if r.doc_id in (None, 9999)] == [0, 0]


def test_held_out_labels_are_never_learnt(spark):
    docs, labels = corpus(200)
    flip = [(i, 1 - t) if zlib.crc32(str(i).encode()) % 5 == 0 else (i, t) for i, t in labels]
    a, b = (toxicity.train(*frames(spark, docs, x)) for x in (labels, flip))
    assert a.weights == b.weights and a.bias == b.bias


TERMS = sorted(toxicity.swaps())


@pytest.fixture(scope="module")
def models(spark):
    """Models without and with the penalty, of sentences that name a group and are toxic more often than others."""
    rng, docs, labels = random.Random(4), [], []
    names = {}
    for term in TERMS:
        for k in range(30):
            rest = [rng.choice(CLEAN) + rng.choice("abcdefgh") for _ in range(12)]
            toxic = int(k < 27)
            words = [*rest, term] + (rng.sample(BAD, 1) if toxic and k % 3 == 0 else [])
            rng.shuffle(words)
            i = len(docs)
            docs.append((i, f"{' '.join(rest[:4])}. {' '.join(words)}! {' '.join(rest[4:8])}"))
            labels.append((i, toxic))
            names[i] = term
    for _ in range(len(docs)):
        i = len(docs)
        docs.append((i, ". ".join(" ".join(rng.choice(CLEAN) + rng.choice("abcdefgh") for _ in range(8)) for _ in range(3))))
        labels.append((i, 0))
    d, lab = frames(spark, docs, labels)
    return [toxicity.train(d, lab, penalty=x) for x in (0.0, toxicity.PENALTY)]


@pytest.mark.parametrize("term", TERMS)
def test_a_neutral_mention_of_any_group_is_no_toxicity(models, term):
    free, held = (m.score(f"a {term} teacher came home", toxicity.Extractor(m.weights)) for m in models)
    assert free > 0.5 > held


def test_what_is_toxic_beside_a_group_stays_toxic(models):
    held = models[1]
    assert held.twins > 0 and all(held.score(f"the {b} came", toxicity.Extractor(held.weights)) > 0.5 for b in BAD)


def test_twins_swap_one_group_for_each_other_of_its_kind():
    swap = toxicity.swaps()
    assert all(t not in others for t, lists in swap.items() for others in lists)
    assert sorted(map(sorted, toxicity.twins({"two", "frauen"}, swap))) == [["männer", "two"], ["two"]]
    got = toxicity.twins({"gay", "river"}, swap)
    assert len(got) == 6 and all("river" in x and "gay" not in x for x in got)
    assert toxicity.twins({"river"}, swap) == []
    assert "muslims" not in {w for x in toxicity.twins({"muslim"}, swap) for w in x}


def test_one_text_an_id_teaches(spark):
    docs, labels = corpus(100)
    d, lab = frames(spark, docs + [(1, f"other text {i}") for i in range(500)], labels)
    rows = toxicity.labelled_sample(d, lab)
    assert rows.count() <= 100 and toxicity.labelled_sample(d, lab, 7).count() == 7


@pytest.mark.parametrize("labels", [[], [(1, 0)], [(1, 1), (2, 1), (3, 1)]])
def test_labels_of_one_kind_or_none(spark, labels):
    docs = [(i, "a b") for i in range(5)]
    model = toxicity.train(*frames(spark, docs, labels))
    share = np.mean([t for i, t in labels if zlib.crc32(str(i).encode()) % 5]) if labels else 0
    got = toxicity.scored(frames(spark, docs, [])[0], model).collect()
    assert all(abs(r.score - share) < 1e-6 for r in got)


def test_long_clean_text_hides_nothing(spark):
    docs, labels = corpus()
    d, lab = frames(spark, docs, labels)
    model = toxicity.train(d, lab)
    e = toxicity.Extractor(model.weights)
    assert model.score(" ".join(CLEAN * 5000 + BAD[:2]), e) > 0.5 > model.score(" ".join(CLEAN * 5000), e)

import hashlib
import random
import re

import numpy as np
import pytest

from vistaframe.llm import decontaminate as dc
from vistaframe.llm.asciiwords import PATTERN

WORD = re.compile(PATTERN)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size=10):
    """{row: (n_words, hit words, item ids)} by looking for every window at every place."""
    windows = []
    for item, text in items:
        w = words(text)
        n = min(size, len(w))
        windows += [(item, w[k : k + n]) for k in range(len(w) - n + 1)] if n else []
    out = []
    for text in docs:
        w = words(text)
        met = [(i, k, len(x)) for i, x in windows for k in range(len(w) - len(x) + 1) if w[k : k + len(x)] == x]
        out.append((len(w), {k + j for _, k, n in met for j in range(n)}, sorted({str(i) for i, _, _ in met if i is not None})))
    return out


def spread(spans):
    return {k for a, b in zip(spans[::2], spans[1::2]) for k in range(a, b)}


def made(seed, n_docs=60, n_items=14):
    """Few different words, so that windows overlap, repeat and nearly match."""
    rng = random.Random(seed)
    vocabulary = ["a", "B", "é", "10", "Zz", "日本"]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice([" ", "  ", ", ", "\n", "-"]) for _ in range(n))
    items = [(k, text(rng.choice([1, 3, 9, 10, 11, 14, 30]) if k else 12)) for k in range(n_items)]
    docs = [text(rng.randrange(40)) for _ in range(n_docs)]
    for k in range(0, n_docs, 3):  # copies of items in other case and spacing, or parts of them
        w = words(rng.choice(items)[1])
        a = rng.randrange(len(w))
        docs[k] += " ".join(w[: a + 1]).upper().replace("É", "é") + "; " + docs[k - 1]
    return docs + [None, "", " .,", docs[0], docs[0]], items + [(100, ""), (101, None), (102, items[3][1])]


@pytest.mark.parametrize("seed", range(6))
def test_search_equals_every_window_at_every_place(seed):
    docs, items = made(seed)
    shard = dc.Shard([(str(i), " ".join(words(t))) for i, t in items if words(t)], 10)
    n, hits, ids = shard.search(docs, [[]] * len(docs), [[]] * len(docs))
    got = [(int(a), spread(b), c) for a, b, c in zip(n, hits, ids)]
    assert got == brute(docs, items)
    assert all(b == sorted(set(b)) for b in hits)  # spans neither touch nor overlap


def test_equal_hashes_do_not_matter(monkeypatch):
    docs, items = made(9)
    monkeypatch.setattr(dc, "_hash", lambda h, at, n: h[at] % np.uint64(3))
    shard = dc.Shard([(str(i), " ".join(words(t))) for i, t in items if words(t)], 10)
    n, hits, ids = shard.search(docs, [[]] * len(docs), [[]] * len(docs))
    assert [(int(a), spread(b), c) for a, b, c in zip(n, hits, ids)] == brute(docs, items)


def test_blocks_without_a_place_are_skipped(monkeypatch):
    """Over words that no item has, the search looks at one block in nine."""
    shard = dc.Shard([("1", " ".join(f"w{k}" for k in range(50)))], 10)
    seen = []
    slots = dc.Windows._slots
    monkeypatch.setattr(dc.Windows, "_slots", lambda self, h, at: seen.append(len(at)) or slots(self, h, at))
    shard.search([" ".join(f"x{k}" for k in range(9000))], [[]], [[]])
    assert sum(seen) < 9000 / 9 + 9000 / dc.LANE + 2


def test_shards_pieces_and_other_columns(spark, monkeypatch):
    monkeypatch.setattr(dc, "PIECE_WORDS", 7)
    docs, items = made(20, 40, 8)
    items += [(3, "one two three four five six seven eight nine ten eleven"), (None, "alpha beta gamma delta"), (5, " ".join(f"u{k}" for k in range(40)))]
    docs += ["x One two-three four five six seven eight nine ten", "alpha beta gamma delta!", " ".join(f"u{k}" for k in range(5, 33)), " ".join(f"u{k}" for k in range(40))]
    rows = spark.createDataFrame([(k, t, "kept", k) for k, t in enumerate(docs)], "doc_id long, text string, items string, `n ` long").repartition(3)
    target = spark.createDataFrame(items, "item_id long, text string").selectExpr("item_id", "text", "1 as hits")
    want = brute(docs, items)
    for shard_bytes in (1 << 20, 150):
        got = dc.contamination(rows, target, shard_bytes=shard_bytes)
        assert got.columns == ["doc_id", "text", "n ", "n_words", "n_hit", "n_items", "hits", "items", "contaminated"]
        found = {r.doc_id: r for r in got.collect()}
        assert len(found) == len(docs) and all(found[k].text == t and found[k]["n "] == k for k, t in enumerate(docs))
        assert [(found[k].n_words, spread(found[k].hits), found[k]["items"]) for k in range(len(docs))] == want
        assert all(r.n_hit == len(spread(r.hits)) and r.n_items == len(r["items"]) and r.contaminated == (r.n_hit > 0) for r in found.values())
    assert found[len(docs) - 3].n_hit == 4 and found[len(docs) - 3].n_items == 0


def test_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c"), (None, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r.contaminated) for r in dc.contamination(docs, none).collect()] == [(3, 0, False), (0, 0, False)]
    assert dc.contamination(docs.limit(0), spark.createDataFrame([(1, "a")], "item_id long, text string")).collect() == []


def test_very_long_texts():
    rng = random.Random(1)
    item = [f"i{k}" for k in range(30)]
    w = [f"w{rng.randrange(1000)}" for _ in range(400_000)]
    places = [5, 123_456, 399_960]
    for p in places:
        w[p : p + 30] = item
    n, hits, ids = dc.Shard([("7", " ".join(item))], 10).search([" ".join(w), "i0", "x" * 3_000_000], [[]] * 3, [[]] * 3)
    assert list(n) == [400_000, 1, 1] and ids == [["7"], [], []]
    assert hits[0] == [x for p in places for x in (p, p + 30)] and not hits[1] and not hits[2]


def test_query_on_the_tables(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    items = [(r.item_id, r.text) for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    own = {k: set() for k, _ in items}
    for k, t in items:
        w = words(t)
        own[k] = {tuple(w[j : j + 10]) for j in range(max(1, len(w) - 9))}
    hit = 0
    for r in dc.op11_decontaminate(spark, sf_dir).collect():
        w = words(docs[r.doc_id])
        at = {tuple(w[k : k + 10]) for k in range(len(w) - 9)}
        ids = sorted(str(k) for k in own if own[k] & at)
        assert (r.n_words, r.n_items, r.items_sha256) == (len(w), len(ids), hashlib.sha256(",".join(ids).encode()).hexdigest())
        assert r.contaminated == bool(ids) == (r.n_hit > 0)
        hit += r.contaminated
    assert hit > 0

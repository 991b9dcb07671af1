import random
import re
from itertools import combinations

import numpy as np
import pytest

from vistaframe.llm import minhash
from vistaframe.llm.shingles import shingles


def sets(text, size):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + size]) for i in range(len(w) - size + 1)} if len(w) >= size else {tuple(w)} if w else set()


def brute(rows, size=2, percent=80):
    rows = [(i, sets(t, size)) for i, t in rows]
    parent = {i: i for i, _ in rows if i is not None}
    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for (i, a), (j, b) in combinations([r for r in rows if r[0] is not None], 2):
        if a and b and 100 * len(a & b) >= percent * len(a | b):
            x, y = find(i), find(j)
            parent[max(x, y)] = min(x, y)
    out = []
    for i, s in rows:
        c = None if i is None else find(i)
        out.append((i, len(s), c, i == c))
    return sorted(out, key=str)


def got(spark, rows, size=2):
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 as node", "2 as band")
    return sorted([tuple(r) for r in minhash.near_duplicates(df, size).collect()], key=str)


def test_shingles_equal_plain_sets():
    rng = random.Random(2)
    texts = [None, "", " \t\n", "One", "one", "a b", "A  b\x0b", "É é", "x" * 3000] + [" ".join(rng.choices("a b c É dd".split(), k=rng.randint(1, 30))) for _ in range(200)]
    for size in (1, 2, 5):
        mine = shingles(texts, size)
        plain = [sets(t, size) for t in texts]
        assert [len(x) for x in mine] == [len(x) for x in plain]
        for i, j in combinations(range(0, len(texts), 3), 2):
            assert len(np.intersect1d(mine[i], mine[j])) == len(plain[i] & plain[j])


def test_query_against_all_pairs(spark, sf_dir):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    mine = sorted([tuple(r) for r in minhash.op1_minhash(spark, sf_dir).collect()], key=str)
    assert mine == brute(rows)
    assert sum(not r[3] for r in mine) > 0


@pytest.mark.parametrize("piece", [500, 1_000_000])
def test_chains_and_near_misses(spark, monkeypatch, piece):
    """Groups whose ends are not alike, and copies just below and above the limit, in small blocks and portions."""
    monkeypatch.setattr(minhash, "BLOCK", 8)
    monkeypatch.setattr(minhash, "PORTION", 4)
    monkeypatch.setattr(minhash, "PIECE", piece)
    rng, rows = random.Random(7), []
    for g in range(6):
        words = [f"w{rng.randint(0, 10**6)}" for _ in range(60)]
        for _ in range(25):
            for _ in range(rng.choice([1, 2, 3])):
                words[rng.randrange(60)] = f"v{rng.randint(0, 10**6)}"
            rows.append((rng.randint(0, 10**6), " ".join(words)))
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [
    [],
    [(1, None), (2, ""), (3, " \n")],
    [(5, "One"), (4, "one"), (4, "one"), (None, "one"), (None, None), (7, "a b c"), (8, "c b a")],
    [(9, "x y " * 5000), (3, "X y " * 4000), (3, "other text here"), (12, "Other text\there")],
])
def test_edges(spark, rows):
    assert got(spark, rows) == brute(rows)


@pytest.mark.parametrize("rows", [
    [(5, "a b c d"), (5, "x y z w"), (3, "x y z w"), (7, "a b c d")],
    [(5, "a b c d"), (3, "a b c d"), (5, ""), (5, None), (6, "")],
    [(2, " ".join(f"w{i}" for i in range(60))), (2, " ".join(f"v{i}" for i in range(60))), (2, " ".join(f"u{i}" for i in range(60)))]
    + [(9 + k, " ".join(f"{c}{i}" for i in range(59 - k))) for k, c in enumerate("wvu")],
])
def test_ids_of_several_texts_are_one_document(spark, rows):
    assert got(spark, rows) == got(spark, rows[::-1]) == brute(rows)


@pytest.fixture
def forty(spark):
    """Forty partitions a shuffle, however few the rows."""
    was = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in was}
    for k, v in was.items():
        spark.conf.set(k, v)
    yield spark
    for k, v in old.items():
        spark.conf.set(k, v)


def tasks_of(spark, name, work):
    """What work() returns, and the number of tasks that it ran."""
    spark.sparkContext.setJobGroup(name, name)
    out = work()
    seen = spark.sparkContext.statusTracker()
    stages = {s for j in seen.getJobIdsForGroup(name) for s in seen.getJobInfo(j).stageIds}
    spark.sparkContext.setJobGroup("others", "others")
    return out, sum(i.numCompletedTasks for i in map(seen.getStageInfo, stages) if i)


@pytest.mark.parametrize("few", [True, False])
def test_components_of_any_links(forty, monkeypatch, few):
    if not few:
        monkeypatch.setattr(minhash, "BROADCAST_PAIRS", 0)
    rng = random.Random(3)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(1000 + i, 1001 + i) for i in range(20)]
    links += [(2000, 2000 + i) for i in range(1, 50)] + [(3000 + i, 3001) for i in range(5)] + [(7, 7), (4000, 4000), (4001, 4002), (4002, 4001)]
    root = {}
    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    edges = minhash.stored(forty.createDataFrame(links, "a long, b long"), "edges")
    got = [tuple(r) for r in minhash.components(edges).collect()]
    assert sorted(got) == sorted((x, find(x)) for x in root if find(x) != x)


def test_components_shuffle_little(forty):
    """A step shuffles the smallest neighbours alone: two shuffles of forty tasks, and one to look whether it was the last."""
    rng = random.Random(5)
    names = rng.sample(range(10**6), 200)
    links = list(zip(names, names[1:]))  # one chain, in no order
    edges = minhash.stored(forty.createDataFrame(links, "a long, b long"), "edges")
    got, tasks = tasks_of(forty, "components", lambda: minhash.components(edges).collect())
    assert {r.root for r in got} == {min(names)} and len(got) == 199
    assert tasks < 1300, tasks


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(1)
    x = rng.integers(0, 2**63, 3000).astype(np.uint64)
    for share in (0.5, 0.8, 0.95):
        n = int(2000 * (1 + share) / 2 * 1)
        a, b = x[:n], x[2000 - n : 2000] if n < 2000 else x
        true = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
        est = (minhash.signature(np.unique(a)) == minhash.signature(np.unique(b))).mean()
        assert abs(est - true) < 0.12


def test_no_task_holds_two_python_processes(spark, sf_dir, monkeypatch):
    plans, stored = {}, minhash.stored

    def seen(df, name):
        plan = df._jdf.queryExecution().executedPlan().toString()
        plans[name] = max(plans.get(name, 0), len(re.findall(r"(?:ArrowEvalPython|BatchEvalPython|MapInArrow|MapInPandas|FlatMapGroupsInArrow) ", plan)))
        return stored(df, name)

    monkeypatch.setattr(minhash, "stored", seen)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert minhash.near_duplicates(docs, 5).where("not kept").count() > 0
    # each table is stored before the next, so that one node a plan is one node a task
    assert plans["signed"] == plans["agreeing"] == plans["links"] == 1 and max(plans.values()) == 1, plans

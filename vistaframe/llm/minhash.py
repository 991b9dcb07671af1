"""Near-duplicate groups by circulant MinHash, banding and exact Jaccard confirmation.

A text's shingle hashes are permuted once; coordinate k of its signature is the smallest value of a second permutation,
shifted circularly by k, over them. BANDS bands of ROWS coordinates give buckets. At a similarity of 0.8 two texts miss
all 40 buckets of 5 once in ten million times.

Texts with equal sets are one class from the start, and only its smallest id goes on. Members of a bucket are first
paired with the bucket's smallest id alone; pairs whose signatures agree too little are left out (at 0.8 that is a
deviation of five standard errors), and the others are confirmed on the full sets of their texts, best first, and only
while their ends lie in different groups. Buckets that then still hold members of several groups, beside the smallest
id, are compared in blocks by signature. A block gives back a forest that connects the groups which agree enough, and the
members that agree with a member of another group. Those of connected groups meet once more, in pieces of bounded size
with their full sets, where all pairs of different groups are compared exactly and a forest of links is given back. So no
group is ever written out as pairs, and no link that would join two groups is left out. Each piece meets each other one of
its bucket or family, so for a family of n texts that are nearly alike, and not linked, rows sent grow with n squared over BLOCK.

Confirming sends each text to its partner's place, in portions of PORTION members, so a text with a third of all rows as
its copies is spread over many tasks. Groups grow together by alternating large-star and small-star steps on the
confirmed links; each step is a table in the shared folder.

Defined results: a null text counts as empty; a text without words has an empty set, no links and its own id as group;
rows with one id are one document and have one group, linked by any of their texts; a row whose id is null has no links, a null group and
is kept; an empty table gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, dropped, small_batches, stored
from .shingles import mix, shingles

BANDS, ROWS = 40, 5
K = BANDS * ROWS
WORDS, PERCENT = 5, 80
#: Signatures may agree this much less than the similarity asked for.
SLACK = 0.15
PORTION = 200
BLOCK = 1024
#: Shingles of a piece of connected groups.
PIECE = 500_000
#: Pairs up to this number (16 bytes each) are broadcast to the texts; more are joined by shuffling.
BROADCAST_PAIRS = 200_000


# Two permutations of the 32-bit integers: shifts and odd factors, in order.
FIRST = ((16, 0x7FEB352D), (15, 0x846CA68B), (16, 1))
SECOND = ((16, 0x21F0AAAD), (15, 0x735A2D97), (15, 1))


def _permuted(x: np.ndarray, by: tuple) -> np.ndarray:
    """A permutation of the 32-bit integers, in place."""
    t = np.empty_like(x)
    for shift, factor in by:
        np.right_shift(x, np.uint32(shift), out=t)
        np.bitwise_xor(x, t, out=x)
        if factor != 1:
            np.multiply(x, np.uint32(factor), out=x)
    return x


_SHIFTS = np.arange(K, dtype=np.uint32)[:, None] * np.uint32(0x9E3779B1)  # odd steps around the circle


def signature(hashes: np.ndarray) -> np.ndarray:
    """K coordinates of a non-empty set of 64-bit hashes."""
    first = _permuted((hashes >> np.uint64(32)).astype(np.uint32), FIRST)
    best = np.full(K, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(first), 512):
        np.minimum(best, _permuted(first[None, i : i + 512] + _SHIFTS, SECOND).min(1), out=best)
    return best


def bands(coordinates: np.ndarray) -> np.ndarray:
    parts = coordinates.reshape(BANDS, ROWS).astype(np.uint64)
    out = np.arange(1, BANDS + 1, dtype=np.uint64) << np.uint64(40)
    for j in range(ROWS):
        out = mix(out + parts[:, j])
    return out.astype(np.int64)


SIGNED = "doc_id long, set_key binary, n_shingles long, bands array<long>, sig binary"


def _sign(words: int):
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = shingles(batch.column("text").to_pylist(), words)
            signs = [signature(s) if len(s) else None for s in sets]
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"),
                pa.array([hashlib.blake2b(s.tobytes(), digest_size=16).digest() for s in sets], pa.binary()),
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([None if s is None else bands(s) for s in signs], pa.list_(pa.int64())),
                pa.array([None if s is None else s.astype(np.uint8).tobytes() for s in signs], pa.binary()),
            ], ["doc_id", "set_key", "n_shingles", "bands", "sig"])

    return of


def _agreeing(least: float):
    """Pairs whose signatures sa and sb agree enough, with est: share of coordinates on which they do (by their low 8 bits).

    A filter on a UDF's result would be pushed below it, so that a task ran the UDF twice, in two Python processes at once.
    """
    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, K) for c in ("sa", "sb"))
            est = (x == y).mean(1)
            pairs = pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(est), batch.column("size")], ["a", "b", "est", "size"])
            yield pairs.filter(pa.array(est >= least))

    return of


def starred(edges: DataFrame) -> DataFrame:
    """node, root for every node of a stored table of edges (a, b) but the roots; a node may have several equal rows.

    A step sends each edge once through a large-star and a small-star step, so that edges never grow in number. It looks
    up the smallest neighbours, which are broadcast if they are few: only they are shuffled then, not the edges.
    """
    state = edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v")
    few = state.count() <= BROADCAST_PAIRS // 2

    def found(least: DataFrame) -> DataFrame:
        return F.broadcast(least) if few else least

    while True:
        ends = state.select(F.col("u").alias("x"), F.col("v").alias("up"), F.lit(False).alias("down"), F.col("v").alias("y")).unionByName(
            state.select(F.col("v").alias("x"), F.lit(None).cast("long").alias("up"), F.lit(True).alias("down"), F.col("u").alias("y"))
        )
        ways = ends.groupBy("x").agg(F.min("up").alias("lo"), F.max("up").alias("hi"), F.max("down").alias("down"))
        if ways.where("lo < hi or (lo is not null and down)").isEmpty():  # stars: each node has one way, to a root
            break
        least = ends.groupBy("x").agg(F.min("y").alias("m")).select(F.col("x").alias("v"), F.least("x", "m").alias("m"))
        large = state.join(found(least), "v").select("u", F.col("m").alias("v"))
        down = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(found(down), "u").select(F.when(F.col("v") == F.col("m"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("m").alias("v"))
        last, state = state, stored(small if few else small.distinct(), "components")
        dropped(last)
    return state.select(F.col("u").alias("node"), F.col("v").alias("root"))


def components(edges: DataFrame) -> DataFrame:
    """node, root for every node of a stored table of edges (a, b) but the roots: root is the smallest node reachable."""
    return starred(edges).groupBy("node").agg(F.min("root").alias("root"))


def _confirm(words: int, percent: int):
    def of(table: pa.Table) -> pa.Table:
        sets = shingles(table.column("text").to_pylist(), words)
        a, b = (table.column(c).to_pylist() for c in ("a", "b"))
        own = [s for x, y, s in zip(a, b, sets) if x == y]
        found = []
        for x, y, s in zip(a, b, sets):
            if x != y:
                for o in own:  # one set, but for ids that stand for several texts
                    shared = len(np.intersect1d(o, s, assume_unique=True))
                    if shared and 100 * shared >= percent * (len(o) + len(s) - shared):
                        found.append((x, y))
                        break
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return of


def confirmed(pairs: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Those of the pairs (a, b, size: shingles of b) whose full sets are similar enough."""
    many = F.ceil(F.greatest(F.count("*") / F.lit(PORTION), F.sum("size") / F.lit(PIECE)))
    degree = pairs.groupBy("a").agg(many.cast("int").alias("portions"))
    members = pairs.join(degree, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("portions")).cast("int").alias("portion"))
    own = degree.select("a", F.col("a").alias("b"), F.explode(F.sequence(F.lit(0), F.col("portions") - 1)).alias("portion"))
    sent = members.unionByName(own)
    if pairs.count() <= BROADCAST_PAIRS:
        sent = F.broadcast(sent)  # at most two rows a pair
    texts = docs.join(sent, F.col("doc_id") == F.col("b")).select("a", "b", "portion", "text")
    return texts.groupBy("a", "portion").applyInArrow(_confirm(words, percent), "a long, b long")


def _forest(roots: np.ndarray, rows: np.ndarray, alike) -> tuple[list[tuple[int, int]], np.ndarray]:
    """A forest over groups that `alike` connects, as pairs of places, and the places that are alike across groups.

    alike(x) tells for a place which places are alike to it.
    """
    label, active, edges = roots.copy(), np.zeros(len(roots), bool), []
    for x in rows:
        across = alike(x) & (roots != roots[x])
        if across.any():
            active |= across
            active[x] = True
            while len(left := np.flatnonzero(across & (label != label[x]))):
                edges.append((x, left[0]))
                label[label == label[left[0]]] = label[x]
    return edges, active


def _blocks(least: float):
    """Per block: (a, b, false) for groups a and b that a forest connects, (node, group, true) for nodes alike across groups."""
    def of(table: pa.Table) -> pa.Table:
        node, root, mine = (table.column(c).to_numpy() for c in ("node", "root", "mine"))
        sig = np.frombuffer(b"".join(table.column("sig").to_pylist()), np.uint8).reshape(-1, K)
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        right = mine == j
        edges, active = _forest(root, np.flatnonzero(mine == i), lambda x: right & ((sig == sig[x]).sum(1) >= least * K))
        a = np.concatenate([root[[x for x, _ in edges]], node[active]]) if edges else node[active]
        b = np.concatenate([root[[y for _, y in edges]], root[active]]) if edges else root[active]
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64()), "active": np.arange(len(a)) >= len(edges)})

    return of


def _pieces(words: int, percent: int):
    """Links (a, b) that connect different groups, from the full sets of two pieces of members."""
    def of(table: pa.Table) -> pa.Table:
        node, root, mine = (table.column(c).to_numpy() for c in ("node", "root", "mine"))
        i, j = (table.column(c)[0].as_py() for c in ("i", "j"))
        sets = shingles(table.column("text").to_pylist(), words)
        size = np.array([len(x) for x in sets])
        _, at, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        owner, shared = np.repeat(np.arange(len(sets)), size), seen[at] > 1
        place = np.cumsum(seen > 1) - 1  # shingles of one member alone need no column
        owner, column = owner[shared], place[at[shared]]
        order = np.argsort(column, kind="stable")
        owner, column = owner[order], column[order]
        left, right = np.flatnonzero(mine == i), np.flatnonzero(mine == j)
        both = np.zeros((len(left), len(right)), np.float32)  # sizes of intersections; exact below 2**24
        for c in range(0, int(column[-1]) + 1 if len(column) else 0, 2048):
            lo, hi = np.searchsorted(column, [c, c + 2048])
            x = np.zeros((len(sets), 2048), np.float32)
            x[owner[lo:hi], column[lo:hi] - c] = 1
            both += x[left] @ x[right].T
        row = {x: n for n, x in enumerate(left)}

        def alike(x: int) -> np.ndarray:
            out = np.zeros(len(sets), bool)
            n = both[row[x]].astype(np.int64)
            out[right] = (n > 0) & (100 * n >= percent * (size[x] + size[right] - n))
            return out

        edges, _ = _forest(root, left, alike)
        return pa.table({k: pa.array([node[e[n]] for e in edges], pa.int64()) for n, k in enumerate("ab")})

    return of


def _dealt(members: DataFrame, pieces) -> DataFrame:
    """members with mine, i, j: dealt into pieces, and sent wherever their piece meets another one (or itself)."""
    out = members.withColumn("mine", F.pmod(F.xxhash64("node"), pieces).cast("int"))
    out = out.withColumn("_o", F.explode(F.sequence(F.lit(0), pieces - 1)))
    return out.withColumns({"i": F.least("mine", "_o"), "j": F.greatest("mine", "_o")}).drop("_o")


def across(buckets: DataFrame, roots: DataFrame, unique: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links (a, b) between groups whose members share a bucket, neither being its smallest id."""
    members = buckets.where("node <> leader").join(roots, "node", "left").select("band", "node", F.coalesce("root", "node").alias("root"))
    mixed = members.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    several = members.join(mixed.select("band", F.ceil(F.col("n") / F.lit(BLOCK)).cast("int").alias("pieces")), "band")
    met = _dealt(several, F.col("pieces")).drop("pieces").join(unique.select("node", "sig"), "node")
    found = stored(met.groupBy("band", "i", "j").applyInArrow(_blocks(percent / 100 - SLACK), "a long, b long, active boolean").distinct(), "alike")
    wholes = components(found.where("not active").select("a", "b"))
    active = found.where("active").select(F.col("a").alias("node"), F.col("b").alias("root"))
    placed = active.join(wholes.select(F.col("node").alias("root"), F.col("root").alias("whole")), "root", "left")
    placed = placed.select("node", "root", F.coalesce("whole", "root").alias("whole")).join(unique.groupBy("node").agg(F.sum("n_shingles").alias("n_shingles")), "node")
    count = F.greatest(F.sum("n_shingles") / F.lit(PIECE), F.count("*") / F.lit(BLOCK))
    sizes = placed.groupBy("whole").agg(F.ceil(count).cast("int").alias("pieces"))
    sent = stored(_dealt(placed.join(sizes, "whole"), F.col("pieces")).select("node", "root", "whole", "mine", "i", "j"), "sent")
    small = sent.count() <= BROADCAST_PAIRS  # 36 bytes a row
    texts = docs.join(F.broadcast(sent) if small else sent, F.col("doc_id") == F.col("node")).drop("doc_id")
    return texts.groupBy("whole", "i", "j").applyInArrow(_pieces(words, percent), "a long, b long")


class Groups:
    """Groups that grow by confirming candidate pairs."""

    def __init__(self, docs: DataFrame, words: int, percent: int) -> None:
        self.docs, self.words, self.percent = docs, words, percent
        self.stars: DataFrame | None = None
        self.roots = docs.sparkSession.createDataFrame([], "node long, root long")

    def link(self, good: DataFrame) -> None:
        good = stored(good, "links")
        if good.isEmpty():
            return
        if self.stars is not None:
            good = good.unionByName(self.stars.select(F.col("node").alias("a"), F.col("root").alias("b")))
        self.stars = starred(good)
        self.roots = self.stars.groupBy("node").agg(F.min("root").alias("root"))

    def ends(self, pairs: DataFrame) -> DataFrame:
        """pairs between different groups, with the groups' roots ra and rb."""
        if self.stars is None:
            return pairs.withColumns({"ra": F.col("a"), "rb": F.col("b")})
        r = self.roots
        return (
            pairs.join(r.select(F.col("node").alias("a"), F.col("root").alias("ra")), "a", "left")
            .join(r.select(F.col("node").alias("b"), F.col("root").alias("rb")), "b", "left")
            .withColumns({"ra": F.coalesce("ra", "a"), "rb": F.coalesce("rb", "b")})
            .where("ra <> rb")
        )

    def grow(self, pairs: DataFrame) -> None:
        """Confirm stored pairs (a, b, est, size) in rounds, best first; pairs within one group need no confirming."""
        left, most = pairs, 1
        while True:
            ends = self.ends(left).withColumn("_of", F.greatest("ra", "rb"))
            # the best pairs of each group's larger end; all of them from the third round on
            from_here = ends
            if most is not None:
                best = ends.groupBy("_of").agg(F.max("est").alias("_best"))
                from_here = ends.join(best, "_of").withColumn("now", F.col("est") >= F.col("_best") - F.lit(0.02 * (most - 1)))
            else:
                from_here = ends.withColumn("now", F.lit(True))
            state = stored(from_here.select("a", "b", "est", "size", "now"), "pairs")
            if state.isEmpty():
                return
            self.link(confirmed(state.where("now").select("a", "b", "size"), self.docs, self.words, self.percent))
            left = state.where("not now").select("a", "b", "est", "size")
            most = {1: 3, 3: None}.get(most)


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest id of the group), kept (whether it is the document's own)."""
    small_batches(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    signed = stored(docs.mapInArrow(_sign(words), SIGNED), "signed")
    linked = signed.where("n_shingles > 0 and doc_id is not null")
    # rows with one key have one set, and so equal numbers, bands and signatures
    same = [F.any_value(c).alias(c) for c in ("n_shingles", "bands", "sig")]
    classes = stored(linked.groupBy("set_key").agg(F.min("doc_id").alias("node"), *same), "classes")
    unique = classes.select("node", "n_shingles", "bands", "sig")
    each = unique.select("node", F.explode("bands").alias("band"))
    leaders = each.groupBy("band").agg(F.min("node").alias("leader"), F.count("*").alias("n")).where("n > 1").drop("n")
    buckets = stored(each.join(leaders, "band"), "buckets")
    least = percent / 100 - SLACK
    stars = buckets.where("node <> leader").select(F.col("leader").alias("a"), F.col("node").alias("b")).distinct()
    agreeing = (
        stars.join(unique.select(F.col("node").alias("a"), F.col("sig").alias("sa")), "a")
        .join(unique.select(F.col("node").alias("b"), F.col("sig").alias("sb"), F.col("n_shingles").alias("size")), "b")
        .select("a", "b", "sa", "sb", "size")
        .mapInArrow(_agreeing(least), "a long, b long, est double, size long")
        .groupBy("a", "b").agg(F.max("est").alias("est"), F.sum("size").alias("size"))  # an id may have several signatures
    )
    groups, several = Groups(docs, words, percent), None
    again = signed.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1")
    if not again.isEmpty():
        # ids that stand for several texts: their classes are linked, and rows without words go with them
        named = linked.select("doc_id", "set_key").join(classes.select("set_key", "node"), "set_key").select("doc_id", "node")
        blank = signed.where("n_shingles = 0 and doc_id is not null").select("doc_id")
        both = named.unionByName(blank.withColumn("node", F.lit(None).cast("long")))
        ids = both.groupBy("doc_id").agg(F.min("node").alias("least"), F.max("node").alias("most"), F.count_if(F.col("node").isNull()).alias("blank"))
        several = stored(ids.where("least < most or (blank > 0 and least is not null)").select("doc_id", "least"), "several")
        groups.docs = docs = docs.dropDuplicates(["doc_id", "text"])  # a text that comes often under one id is compared once
        groups.link(named.join(several, "doc_id").select(F.col("least").alias("a"), F.col("node").alias("b")).where("a <> b").distinct())
    groups.grow(stored(agreeing, "agreeing"))
    groups.link(across(buckets, groups.roots, unique, docs, words, percent))
    rows = signed.select("doc_id", "set_key", "n_shingles")
    worded = rows.where("n_shingles > 0 and doc_id is not null").join(classes.select("set_key", "node"), "set_key", "left")
    others = rows.where("n_shingles = 0 or doc_id is null")
    others = others.withColumn("node", F.lit(None).cast("long")) if several is None else others.join(several.withColumnRenamed("least", "node"), "doc_id", "left")
    return (
        worded.unionByName(others)
        .join(groups.roots, "node", "left")
        .withColumn("component_id", F.coalesce("root", "node", "doc_id"))
        .select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))
    )


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of two-word shingles are at least 80 percent alike."""
    return near_duplicates(documents(spark, sf_dir), words=2)


QUERIES = {"op1_minhash": op1_minhash}
ORACLE_SQL: dict = {}

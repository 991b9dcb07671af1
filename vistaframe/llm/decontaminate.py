"""Benchmark decontamination: Wu-Manber search for all windows of the benchmark items in all documents.

The letters of the search are words, its blocks pairs of words. A window is ten consecutive words of an item; an item of
fewer words is one window. Windows of one length have tables of their own:

- the shift table says, by block, how far the search may move on: to where the block could stand in some window, or
  beyond the block if it stands in none;
- where a block may be a window's last one (shift 0), the bucket of that suffix gives the test strings with the same hash
  of all their words;
- each of those is compared with the document word by word.

A batch of documents is one row of words, which many searches cross at once, each from its own start (numpy); windows
that would reach from one document into the next are left out. The benchmark is dealt into shards of bounded size, so
that what is broadcast stays bounded however large it grows; every shard is one pass over the documents and adds to the
hits so far. Documents never move: no shuffle, no groups.

Defined results: null and empty texts have no words and no hits; repeated documents have repeated results; repeated
items, or different texts under one item id, count as one item; items without an id count as none, though their windows
hit; items without words and an empty benchmark hit nothing; other columns are kept, those named like a result replaced.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .asciiwords import PATTERN, lowered, words
from .common import documents, small_batches, stored
from .shingles import mix

SIZE = 10
#: Bytes of benchmark text in a shard, on average, and words of an item that stay together.
SHARD_BYTES = 4 << 20
PIECE_WORDS = 10_000
#: Windows that one of the searches crossing a batch looks after.
LANE = 512
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def _hash(hashes: np.ndarray, starts: np.ndarray, length: int) -> np.ndarray:
    """A hash of so many words from each start on."""
    out = np.full(len(starts), length, np.uint64)
    for j in range(length):
        out = out * _FACTOR + hashes[starts + j]
    return mix(out)


class Windows:
    """The tables for windows of one length: pieces are lists of words, one after the other in one lower-cased text."""

    def __init__(self, length: int, pieces: list[tuple[int, bytes]]) -> None:
        self.length, self.block = length, min(2, length)
        self.data, begins = b"\0".join([*(p for _, p in pieces), b""]), np.cumsum([0, *(len(p) + 1 for _, p in pieces)])
        hashes, self.starts, self.ends = words(self.data)
        limits = np.searchsorted(self.starts, begins)
        windows = np.concatenate([np.arange(a, b - length + 1) for a, b in zip(limits, limits[1:])])
        items = np.repeat([i for i, _ in pieces], np.maximum(0, np.diff(limits) - length + 1))
        # shift by slot of a block: the least distance from there to the end of a window
        bits = max(16, min(24, int(8 * max(1, len(windows))).bit_length()))
        self.mask = np.uint64((1 << bits) - 1)
        last = length - self.block
        self.shift = np.full(1 << bits, last + 1, np.uint8)
        for j in range(last + 1):
            slots = self._slots(hashes, windows + j)
            self.shift[slots] = np.minimum(self.shift[slots], last - j)
        # buckets: windows by slot of their last block and hash of all their words; equal ones are one test string
        keys = self._keys(self._slots(hashes, windows + last), _hash(hashes, windows, length))
        order = np.argsort(keys, kind="stable")
        keys, windows, items = keys[order], windows[order], items[order]
        tests, of = [], np.zeros(len(keys), np.int64)
        first = 0  # of the test strings with the present key
        for k in range(len(keys)):
            if not k or keys[k] != keys[k - 1]:
                first = len(tests)
            text = self._test(windows[k])
            same = next((t for t in range(first, len(tests)) if tests[t][1] == text), None)
            if same is None:
                same = len(tests)
                tests.append((keys[k], text))
            of[k] = same
        self.keys = np.array([t[0] for t in tests], np.uint64)
        self.tests = [t[1] for t in tests]
        by = np.argsort(of, kind="stable")
        self.items, self.limits = items[by], np.searchsorted(of[by], np.arange(len(tests) + 1))

    def _slots(self, hashes: np.ndarray, at: np.ndarray) -> np.ndarray:
        return _hash(hashes, at, self.block) & self.mask

    def _keys(self, slots: np.ndarray, whole: np.ndarray) -> np.ndarray:
        return (slots << np.uint64(40)) | (whole >> np.uint64(24))

    def _test(self, at: int) -> bytes:
        return b" ".join(self.data[a:b] for a, b in zip(self.starts[at : at + self.length].tolist(), self.ends[at : at + self.length].tolist()))

    def found(self, data: bytes, hashes: np.ndarray, starts: np.ndarray, ends: np.ndarray, limits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(first word, test string) of every occurrence; limits: where each document's words begin, and the end of all."""
        last = self.length - self.block
        pos = np.arange(0, max(0, len(hashes) - self.length + 1), LANE)  # the window that begins there is looked at
        stop = np.minimum(pos + LANE, len(hashes) - self.length + 1)
        some = []
        while len(pos):
            slots = self._slots(hashes, pos + last)
            shift = self.shift[slots]
            maybe = shift == 0
            if maybe.any():
                some.append((pos[maybe], slots[maybe]))
            pos = pos + np.maximum(shift, 1)
            going = pos < stop
            pos, stop = pos[going], stop[going]
        none = np.zeros(0, np.int64)
        if not some:
            return none, none
        at, slots = (np.concatenate(x) for x in zip(*some))
        doc = np.searchsorted(limits, at, "right")
        inside = at + self.length <= limits[np.minimum(doc, len(limits) - 1)]
        at, slots = at[inside], slots[inside]
        keys = self._keys(slots, _hash(hashes, at, self.length))
        low, high = np.searchsorted(self.keys, keys), np.searchsorted(self.keys, keys, "right")
        hit = high > low
        out = []
        for p, a, b in zip(at[hit].tolist(), low[hit].tolist(), high[hit].tolist()):
            text = data[starts[p] : ends[p + self.length - 1]]
            plain = None
            for t in range(a, b):
                if self.tests[t] != text:  # words may be parted by something else than one space
                    plain = plain or b" ".join(data[starts[k] : ends[k]] for k in range(p, p + self.length))
                    if self.tests[t] != plain:
                        continue
                out.append((p, t))
        return tuple(np.array(out, np.int64).T) if out else (none, none)


class Shard:
    """The windows of a shard of the benchmark, by length."""

    def __init__(self, rows: list[tuple[str | None, str]], size: int) -> None:
        names = sorted({i for i, _ in rows if i is not None})
        number = {n: k for k, n in enumerate(names)} | {None: -1}
        self.names = np.array(names, object)
        by: dict[int, list] = {}
        for item, text in rows:
            by.setdefault(min(size, text.count(" ") + 1), []).append((number[item], text.encode("utf-8", "surrogatepass")))
        self.tables = [Windows(length, pieces) for length, pieces in sorted(by.items())]

    def search(self, texts: list[str | None], hits: list[list[int]], items: list[list[str]]) -> tuple[np.ndarray, list, list]:
        """Number of words, hit spans (begin and end by turns) and item ids of each text; hits and items are those so far."""
        data, begins = lowered(texts)
        hashes, starts, ends = words(data)
        limits = np.searchsorted(starts, begins)
        edge = np.zeros(len(starts) + 1, np.int32)
        for low, spans in zip(limits.tolist(), hits):
            if spans:
                np.add.at(edge, low + np.array(spans[::2]), 1)
                np.add.at(edge, low + np.array(spans[1::2]), -1)
        found = [set(x) for x in items]
        for table in self.tables:
            at, tests = table.found(data, hashes, starts, ends, limits)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + table.length, -1)
            pairs = np.unique(np.stack([np.searchsorted(limits, at, "right") - 1, tests]), axis=1)
            for doc, t in pairs.T.tolist():
                own = table.items[table.limits[t] : table.limits[t + 1]]
                found[doc].update(self.names[own[own >= 0]])
        covered = np.zeros(len(starts) + 2, bool)
        covered[1:-1] = np.cumsum(edge[:-1]) > 0
        turns = np.flatnonzero(covered[1:] != covered[:-1])  # spans of all texts; one that reaches over a text's end is cut there
        spans = []
        for low, high in zip(limits.tolist(), limits[1:].tolist()):
            own = turns[np.searchsorted(turns, low, "right") : np.searchsorted(turns, high)]
            first, last = high > low and covered[low + 1], high > low and covered[high]
            spans.append([*([0] if first else []), *(own - low).tolist(), *([high - low] if last else [])])
        return np.diff(limits), spans, [sorted(x) for x in found]


def _pieces(size: int):
    """item, n, words: the words of each item joined by spaces, in pieces that overlap by all but one word of a window."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item, text in zip(batch.column("item").to_pylist(), batch.column("text").to_pylist()):
                data, _ = lowered([text])
                _, starts, ends = words(data)
                for n, low in enumerate(range(0, max(1, len(starts) - size + 1), PIECE_WORDS)):
                    high = min(len(starts), low + PIECE_WORDS + size - 1)
                    some = b" ".join(data[a:b] for a, b in zip(starts[low:high].tolist(), ends[low:high].tolist()))
                    if some:
                        yield pa.RecordBatch.from_pydict({"item": pa.array([item], pa.string()), "n": pa.array([n], pa.int64()), "words": pa.array([some.decode("utf-8", "surrogatepass")], pa.string())})

    return cut


#: The shard that a worker built last, by name: it serves all of the worker's tasks.
_BUILT: dict = {}


def _searched(name: str, rows, size: int, kept: list[str]):
    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _BUILT:
            _BUILT.clear()
            _BUILT[name] = Shard(rows.value, size)
        shard = _BUILT[name]
        for batch in batches:
            n, hits, items = shard.search(batch.column("text").to_pylist(), batch.column("hits").to_pylist(), batch.column("items").to_pylist())
            own = [batch.column(c) for c in kept]
            yield pa.RecordBatch.from_arrays(
                [*own, pa.array(n, pa.int64()), pa.array(hits, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], [*kept, "n_words", "hits", "items"]
            )

    return search


RESULTS = ("n_words", "n_hit", "n_items", "hits", "items", "contaminated")


def contamination(docs: DataFrame, benchmark: DataFrame, item: str = "item_id", size: int = SIZE, columns: list[str] | None = None, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """docs (or the given columns of it) with n_words, n_hit, n_items, contaminated; hits: first word and word behind each
    hit span, by turns; items: the ids, as text in order, of the items with windows in the document."""
    spark = docs.sparkSession
    small_batches(spark)
    keep = [c for c in (docs.columns if columns is None else columns) if c not in RESULTS]
    items = benchmark.select(F.col(item).cast("string").alias("item"), F.col("text").cast("string").alias("text"))
    pieces = stored(items.mapInArrow(_pieces(size), "item string, n bigint, words string"), "benchmark-pieces")
    n_bytes = pieces.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    n_shards = max(1, -(-n_bytes // shard_bytes))
    carried = list(dict.fromkeys([*keep, "text"]))
    out = docs.select(*carried).withColumns({"hits": F.array().cast("array<int>"), "items": F.array().cast("array<string>")})
    for k in range(n_shards):
        of = F.pmod(F.xxhash64("item", "n"), F.lit(n_shards)) == k
        rows = spark.sparkContext.broadcast([(r.item, r.words) for r in pieces.where(of).select("item", "words").collect()])
        own = keep if k == n_shards - 1 else carried
        fields = [f for c in own for f in docs.select(c).schema.fields]
        schema = T.StructType([*fields, T.StructField("n_words", T.LongType()), T.StructField("hits", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
        out = out.mapInArrow(_searched(uuid.uuid4().hex, rows, size, own), schema)
        if k < n_shards - 1:  # a worker holds one shard at a time
            out = stored(out, f"hits-{k}").drop("n_words")
    ends = F.transform("hits", lambda x, i: F.when(i % 2 == 1, x).otherwise(-x).cast("long"))
    n_hit = F.aggregate(ends, F.lit(0).cast("long"), lambda s, x: s + x)
    return out.select(
        *keep, "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), "hits", "items", (F.size("hits") > 0).alias("contaminated"),
    )


def op11_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256 and contaminated for every document."""
    out = contamination(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), columns=["doc_id"])
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


_LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWERED}, '{PATTERN}') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all({_LOWERED}, '{PATTERN}') AS w FROM benchmark),
p AS (SELECT item_id, w, least(len(w), {SIZE}) AS n, unnest(range(1, len(w) - least(len(w), {SIZE}) + 2)) AS a FROM i WHERE len(w) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(w[a : a + n - 1], ' ') AS t FROM p),
lengths AS (SELECT DISTINCT n FROM windows),
q AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS a FROM d, lengths WHERE len(w) >= n),
spots AS (SELECT doc_id, n, a, array_to_string(w[a : a + n - 1], ' ') AS t FROM q),
met AS (SELECT doc_id, item_id, s.n, a FROM spots s JOIN windows USING (n, t)),
hit AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(a, a + n)) AS k FROM met) GROUP BY 1),
ids AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
        FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN ids USING (doc_id)
"""

QUERIES = {"op11_decontaminate": op11_decontaminate}
ORACLE_SQL = {"op11_decontaminate": SQL}

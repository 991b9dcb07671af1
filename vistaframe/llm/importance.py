"""Target-distribution importance resampling over hashed word n-grams.

An untrained Split of the tokenizers library cuts each ASCII-lowered text into words with byte offsets. A window over the
list of offset pairs is a run of words: each run is hashed by CRC-32 into one of 10,000 buckets. The buckets' counts over
all documents and over all texts of the target give each bucket a gain, the logarithm of how much likelier it is in the
target; a document's weight is the mean gain of its runs, and Gumbel noise from a hash of its id makes the highest scores
a sample without replacement.

Texts are cut into words once: each document's buckets and their counts are stored, and counted, scored and ranked from
there. What is collected is a bucket's two counts, so 10,000 rows at most. Ranks come from a range-partitioned sort that
is stored once, and the number of rows before each of its parts.

Defined results: null and empty texts have no words, no features, weight 0 and no rank; a null id is noised as an empty
text, and comes last among ties; repeated rows are rows of their own, with ranks of their own; an empty target or table
leaves all counts at 0; other columns are kept where asked for, and those named like a result replaced.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from functools import cache
from itertools import starmap

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .asciiwords import LOWER, PATTERN
from .common import documents, small_batches, stored

BUCKETS = 10_000
ORDERS = (1, 1)
SEED = "2024"
LEAST_WORDS, PERCENT = 20, 10
#: Bytes of a long text that are cut into words at a time, and distinct runs whose buckets a task remembers.
PIECE, KEPT = 200_000, 200_000
_APART = bytes(c for c in range(128) if not (48 <= c <= 57 or 97 <= c <= 122))


@cache
def _split():
    from tokenizers import Regex, pre_tokenizers

    return pre_tokenizers.Split(Regex(PATTERN), behavior="removed", invert=True)


def _pieces(data: bytes) -> Iterator[tuple[int, list]]:
    """Words with offsets of a lower-cased text in UTF-8, and where the offsets begin; long texts in pieces that end between words."""
    from tokenizers import PreTokenizedString

    at = 0
    while at < len(data):
        end = min(len(data), at + PIECE)
        while end < len(data) and data[end - 1] not in _APART:
            end += 1
        piece = PreTokenizedString(data[at:end].decode("utf-8", "surrogatepass"))
        _split().pre_tokenize(piece)
        yield at, piece.get_splits("original", "byte")
        at = end


def offsets(data: bytes) -> list[tuple[int, int]]:
    """The bytes where each word begins and ends."""
    out: list[tuple[int, int]] = []
    for at, words in _pieces(data):
        out += [w[1] for w in words] if not at else [(at + w[1][0], at + w[1][1]) for w in words]
    return out


class Buckets:
    """Buckets of a text's runs of words, with counts."""

    def __init__(self, orders: tuple[int, int], buckets: int) -> None:
        self.orders, self.buckets, self.known = orders, buckets, {}

    def _bucket(self, run: bytes) -> int:
        found = self.known.get(run)
        if found is None:
            if len(self.known) >= KEPT:
                self.known = {}
            found = self.known[run] = zlib.crc32(run) % self.buckets
        return found

    def __call__(self, text: str | None) -> tuple[int, Counter]:
        """Number of words, and how many runs each bucket has."""
        data = (text or "").encode("utf-8", "surrogatepass").translate(LOWER)
        places = offsets(data)
        runs: Counter = Counter()
        for n in range(self.orders[0], self.orders[1] + 1):
            if n == 1:
                runs.update(map(data.__getitem__, starmap(slice, places)))
            else:  # words of a run are joined by one space, whatever stands between them
                runs.update(b" ".join(data[a:b] for a, b in places[k : k + n]) for k in range(len(places) - n + 1))
        out: Counter = Counter()
        for run, n in runs.items():
            out[self._bucket(run)] += n
        return len(places), out


def _cells(kept: list[str], orders: tuple[int, int], buckets: int):
    def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = Buckets(orders, buckets)
        for batch in batches:
            rows = [(n, sorted(c.items())) for n, c in map(count, batch.column("text").to_pylist())]
            ends = pa.array(np.cumsum([0, *(len(c) for _, c in rows)]), pa.int32())
            each = np.array([x for _, c in rows for x in c], np.int64).reshape(-1, 2)
            lists = [pa.ListArray.from_arrays(ends, pa.array(each[:, k], pa.int32())) for k in (0, 1)]
            totals = pa.array([sum(v for _, v in c) for _, c in rows], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([n for n, _ in rows], pa.int64()), totals, *lists], [*kept, "n_words", "n_features", "cells", "counts"])

    return cells


def bucketed(df: DataFrame, columns: list[str] | None = None, orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS) -> DataFrame:
    """The given columns of df (all but text, if none are given), n_words, n_features, and the buckets of its texts' runs with their counts."""
    small_batches(df.sparkSession)
    results = {"n_words": T.LongType(), "n_features": T.LongType(), "cells": T.ArrayType(T.IntegerType()), "counts": T.ArrayType(T.IntegerType())}
    keep = [c for c in (df.columns if columns is None else columns) if c not in results and c != "text"]
    schema = T.StructType([*df.select(*keep).schema.fields, *(T.StructField(k, t) for k, t in results.items())])
    return df.select(*keep, "text").mapInArrow(_cells(keep, orders, buckets), schema)


def _summed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(0, np.int64)
    for batch in batches:
        cells, counts = (batch.column(c).flatten().to_numpy(zero_copy_only=False) for c in ("cells", "counts"))
        if len(cells):
            own = np.bincount(cells, counts.astype(np.float64), len(total)).astype(np.int64)  # exact below 2 to the 53
            own[: len(total)] += total
            total = own
    there = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(there, pa.int64()), pa.array(total[there], pa.int64())], ["bucket", "n"])


def histogram(cells: DataFrame) -> DataFrame:
    """bucket, n: runs of all texts by bucket; each task sends one row a bucket at most."""
    return cells.select("cells", "counts").mapInArrow(_summed, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: dict[int, int], target: dict[int, int], buckets: int = BUCKETS) -> list[int]:
    """By bucket, 1,000 times the logarithm of its share in the target by its share in the source, floored."""
    s, t = float(sum(source.values()) + buckets), float(sum(target.values()) + buckets)
    return [math.floor(1000 * math.log((target.get(b, 0) + 1) * s / ((source.get(b, 0) + 1) * t))) for b in range(buckets)]


def noise(doc_id, seed: str = SEED) -> int:
    """1,000 times a Gumbel number that depends on the seed and the id alone, floored."""
    h = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def _scored(kept: list[str], by_bucket: np.ndarray, seed: str, id_column: str):
    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists, n = batch.column("cells"), batch.column("n_features").to_numpy()
            cells, counts = (batch.column(c).flatten().to_numpy() for c in ("cells", "counts"))
            sums = np.concatenate([np.zeros(1, np.int64), np.cumsum(by_bucket[cells] * counts)])
            ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(np.diff(lists.offsets.to_numpy()))])
            weight = np.where(n > 0, (sums[ends[1:]] - sums[ends[:-1]]) // np.maximum(n, 1), 0)
            noises = np.array([noise(i, seed) for i in batch.column(id_column).to_pylist()], np.int64)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(weight, pa.int64()), pa.array(weight + noises, pa.int64())], [*kept, "weight", "score"])

    return score


def scored(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", columns: list[str] | None = None, orders=ORDERS, buckets: int = BUCKETS, seed: str = SEED) -> DataFrame:
    """The given columns of docs (all but text, if none are given) with n_words, n_features, weight and score."""
    keep = [c for c in (docs.columns if columns is None else columns) if c not in ("n_words", "n_features", "cells", "counts", "weight", "score", "rank", "text")]
    cells = stored(bucketed(docs, list(dict.fromkeys([*keep, id_column])), orders, buckets), "importance-cells")
    counts = [{r.bucket: r.n for r in histogram(x).collect()} for x in (cells, bucketed(target, [], orders, buckets))]  # a row a bucket
    own = [*keep, "n_words", "n_features"]
    schema = T.StructType([*cells.select(*own).schema.fields, T.StructField("weight", T.LongType()), T.StructField("score", T.LongType())])
    return cells.mapInArrow(_scored(own, np.array(gains(*counts, buckets), np.int64), seed, id_column), schema)


def ranked(rows: DataFrame, id_column: str = "doc_id", least_words: int = LEAST_WORDS, percent: int = PERCENT) -> DataFrame:
    """rows with rank: place among the drawn, null if not drawn. Drawn are the given percentage (floored) of the rows with
    enough words, by score; ties go to smaller ids, then to the row that comes first."""
    rows = stored(rows.drop("rank").withColumn("__row", F.monotonically_increasing_id()), "importance-scores")
    order = [F.desc("score"), F.asc_nulls_last(id_column), F.asc("__row")]
    may = rows.where(F.col("n_words") >= least_words).repartitionByRange(*order).sortWithinPartitions(*order)
    may = stored(may.withColumn("__at", F.monotonically_increasing_id()), "importance-order")  # part of the sort, place in it
    part = F.shiftright("__at", 33)
    sizes = sorted((r[0], r[1]) for r in may.groupBy(part).count().collect())  # a row a part
    drawn = percent * sum(n for _, n in sizes) // 100
    before, so_far = {}, 0
    for p, n in sizes:
        before[p], so_far = so_far, so_far + n
    first = may.sparkSession.createDataFrame(list(before.items()), "__part bigint, __before bigint")
    place = F.col("__before") + F.col("__at") - F.shiftleft(part, 33) + 1
    may = may.withColumn("__part", part).join(F.broadcast(first), "__part").withColumn("rank", F.when(place <= drawn, place))
    few = rows.where(f"not coalesce(n_words >= {least_words}, false)").withColumn("rank", F.lit(None).cast("bigint"))
    return may.select(*rows.columns, "rank").unionByName(few).drop("__row")


def drawn(docs: DataFrame, target: DataFrame, id_column: str = "doc_id", percent: int = PERCENT, **more) -> DataFrame:
    """The drawn documents, all columns, with weight, score and rank; ids must be distinct."""
    found = ranked(scored(docs, target, id_column, [id_column], **more), id_column, percent=percent).where("rank is not null")
    kept = docs.drop("weight", "score", "rank")
    return kept.join(found.select(id_column, "weight", "score", "rank"), id_column)


def op12_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_features, weight, score and rank of every document."""
    rows = scored(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"), columns=["doc_id"])
    return ranked(rows).select("doc_id", "n_features", "weight", "score", "rank")


_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{PATTERN}')"
SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
words AS (SELECT doc_id, unnest(w) AS x FROM d),
target AS (SELECT unnest({_WORDS}) AS x FROM benchmark),
crc AS (SELECT list_transform(range(256), lambda n: list_reduce(list_prepend(n, range(8)),
        lambda c, i: CASE WHEN c % 2 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
distinct_words AS (SELECT DISTINCT x FROM (SELECT x FROM words UNION ALL SELECT x FROM target)),
bytes AS (SELECT x, list_transform(range(1, octet_length(encode(x)) + 1), lambda i: CAST('0x' || substr(hex(encode(x)), 2 * i - 1, 2) AS BIGINT)) AS b
          FROM distinct_words),
buckets AS (SELECT x, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, b), lambda c, y: xor(c >> 8, t[(xor(c, y) & 255) + 1]))) % {BUCKETS} AS bucket
            FROM bytes, crc),
s AS (SELECT bucket, count(*) AS n FROM words JOIN buckets USING (x) GROUP BY 1),
t AS (SELECT bucket, count(*) AS n FROM target JOIN buckets USING (x) GROUP BY 1),
sums AS (SELECT (SELECT count(*) FROM words) + {BUCKETS} AS big_s, (SELECT count(*) FROM target) + {BUCKETS} AS big_t),
gain AS (SELECT s.bucket, CAST(floor(1000 * ln(CAST((coalesce(t.n, 0) + 1) * big_s AS DOUBLE) / CAST((s.n + 1) * big_t AS DOUBLE))) AS BIGINT) AS g
         FROM s LEFT JOIN t ON s.bucket = t.bucket, sums),
means AS (SELECT doc_id, CAST(floor(CAST(sum(g) AS DOUBLE) / count(*)) AS BIGINT) AS weight FROM words JOIN buckets USING (x) JOIN gain USING (bucket) GROUP BY 1),
scores AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
           coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8) AS BIGINT) + 0.5) / 4294967296::DOUBLE))) AS BIGINT) AS score
           FROM d LEFT JOIN means USING (doc_id)),
places AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS k, count(*) OVER () AS n FROM scores WHERE n_features >= {LEAST_WORDS})
SELECT doc_id, n_features, weight, score, CASE WHEN k <= {PERCENT} * n // 100 THEN k END AS rank FROM scores LEFT JOIN places USING (doc_id)
"""

QUERIES = {"op12_importance": op12_importance}
ORACLE_SQL = {"op12_importance": SQL}

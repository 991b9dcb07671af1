"""Exact top-k search by inner product with MaxScore over shards.

A vector's components are its terms. Candidates are dealt into shards of bounded size, queries into blocks of bounded
size, and every block meets every shard once. A shard keeps two posting lists a term, of candidates with positive and
with negative components; the list whose sign is the query's holds those that the term can lift. A term's score bound is
the query's weight times the largest such component. Terms are sorted by bound; those whose bounds together stay below
the k-th best score so far are non-essential, as no candidate reaches the top without one of the others. Essential
postings are traversed, and the candidates found there are probed term by term as long as what is still to come could
lift them to the k-th score. Shards' best k are merged by rank; ties go to the smaller id.

Every pair of query and candidate must be looked at somewhere, so a candidate is sent once a block and a query once a
shard; both are as large as a task's memory bears (16 MB each at 256 terms), which keeps the copies few. Where a query's
k-th score is not above 0, no bound can leave a candidate out, and the shard is scored in full.

Defined results: rows whose id or vector is null, or whose vector holds a null or non-finite component, take no part;
rows with one id are rows of their own, as queries and as candidates, and only the query's own row is left out; terms that a shorter vector lacks are 0; an empty vector scores 0 with
all; an empty table gives an empty result; extra columns are ignored. Components count as 64-bit integers, and scores
must fit into 63 bits.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import stored

K = 10
SCALE = 1024
#: Candidates of a shard and queries of a block, at most; small tables are dealt into LEAST_SHARDS shards for the sake of all cores.
SHARD_ROWS = 8192
BLOCK_QUERIES = 8192
LEAST_SHARDS = 24
#: Terms that a probe adds between two looks at the bounds.
PROBE = 8


def integers(vector: Column, scale: int = SCALE) -> Column:
    """floor(scale * x) of each component, x as double."""
    return F.transform(vector, lambda x: F.floor(x.cast("double") * F.lit(float(scale))).cast("bigint"))


def usable(vector: Column) -> Column:
    odd = lambda x: x.isNull() | F.isnan(x.cast("double")) | (F.abs(x.cast("double")) == F.lit(math.inf))
    return vector.isNotNull() & ~F.exists(vector, odd)


class Shard:
    """Posting lists of a set of vectors, and MaxScore over them."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, rows: np.ndarray | None = None) -> None:
        order = np.argsort(ids, kind="stable")
        self.ids, self.x = ids[order], x[order]
        self.rows = self.ids if rows is None else rows[order]
        self.most = np.maximum(self.x.max(0, initial=0), 0)
        self.least = np.minimum(self.x.min(0, initial=0), 0)
        self.lists: dict[tuple[int, bool], np.ndarray] = {}

    def postings(self, term: int, positive: bool) -> np.ndarray:
        """Places of the candidates that the term lifts, largest component first."""
        found = self.lists.get((term, positive))
        if found is None:
            column = self.x[:, term] if positive else -self.x[:, term]
            places = np.flatnonzero(column > 0)
            found = self.lists[term, positive] = places[np.argsort(-column[places], kind="stable")]
        return found

    def top(self, query: np.ndarray, own, k: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, scores) of the k best candidates but the row `own`."""
        lifts = np.where(query > 0, query * self.most, query * self.least)
        terms = np.argsort(-lifts, kind="stable")
        # a first k-th score: the heads of the strongest lists, scored in full
        heads = [self.postings(t, query[t] > 0)[: 2 * k] for t in terms[:4] if lifts[t] > 0]
        seeds = np.unique(np.concatenate([*heads, np.arange(min(len(self.ids), k + 1))]))
        seeds = seeds[self.rows[seeds] != own]
        scores = self.x[seeds] @ query
        least = np.partition(scores, len(scores) - k)[len(scores) - k] if len(scores) >= k else None
        rest = np.append(np.cumsum(lifts[terms][::-1])[::-1], 0)  # rest[i]: bounds of terms[i:] together
        if least is None or least <= 0:
            found = np.arange(len(self.ids))  # every candidate could reach the top, even one without a lift
            lifted = np.full(len(found), rest[0])
        else:
            essential = int(np.argmax(rest < least))
            lifted = np.zeros(len(self.ids), np.int64)
            for t in terms[:essential]:
                at = self.postings(t, query[t] > 0)
                lifted[at] += self.x[at, t] * query[t]
            found = np.flatnonzero(lifted)
            lifted = lifted[found] + rest[essential]
            found = found[lifted >= least]
        found = found[self.rows[found] != own]
        scores = np.zeros(len(found), np.int64)
        for i in range(0, len(terms), PROBE):
            some = terms[i : i + PROBE]
            scores += self.x[np.ix_(found, some)] @ query[some]
            if least is not None:
                keep = scores + rest[min(i + PROBE, len(terms))] >= least
                found, scores = found[keep], scores[keep]
        best = np.lexsort((self.ids[found], -scores))[:k]
        return self.ids[found[best]], scores[best]


def _matrix(table: pa.Table, width: int) -> np.ndarray:
    lists = table.column("v").combine_chunks()
    lists = lists if isinstance(lists, pa.Array) else lists.chunk(0)
    lengths = np.diff(lists.offsets.to_numpy())
    out = np.zeros((len(lengths), width), np.int64)
    out[np.repeat(np.arange(len(lengths)), lengths), np.concatenate([np.arange(n) for n in lengths] or [np.zeros(0, np.int64)])] = (
        lists.flatten().to_numpy(zero_copy_only=False)
    )
    return out


def _width(*tables: pa.Table) -> int:
    return max([1, *(max(t.column("v").combine_chunks().value_lengths().to_pylist(), default=0) for t in tables if t.num_rows)])


def _search(k: int):
    def of(queries: pa.Table, candidates: pa.Table) -> pa.Table:
        found = {"query_id": [], "query_row": [], "vec_id": [], "score": []}
        if queries.num_rows and candidates.num_rows:
            width = _width(queries, candidates)
            shard = Shard(candidates.column("id").to_numpy(), _matrix(candidates, width), candidates.column("row").to_numpy())
            for name, own, q in zip(queries.column("id").to_pylist(), queries.column("row").to_pylist(), _matrix(queries, width)):
                ids, scores = shard.top(q, own, k)
                found["query_id"].append(np.full(len(ids), name))
                found["query_row"].append(np.full(len(ids), own))
                found["vec_id"].append(ids)
                found["score"].append(scores)
        return pa.table({n: pa.array(np.concatenate(x) if x else [], pa.int64()) for n, x in found.items()})

    return of


def top_k(queries: DataFrame, candidates: DataFrame, k: int = K) -> DataFrame:
    """query_id, query_row, rank, vec_id, score: each query's k best candidates.

    Both frames have row (long, one a row; equal for a query and its own candidate), id (long), v (array of long).
    """
    n = candidates.count()
    shards = max(1, math.ceil(n / SHARD_ROWS), min(LEAST_SHARDS, n // 1024))
    blocks = max(1, math.ceil(queries.count() / BLOCK_QUERIES))
    deal = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    q = queries.select("row", "id", "v", deal(blocks).alias("block"), every(shards).alias("shard"))
    c = candidates.select("row", "id", "v", every(blocks).alias("block"), deal(shards).alias("shard"))
    found = q.groupBy("block", "shard").cogroup(c.groupBy("block", "shard")).applyInArrow(
        _search(k), "query_id long, query_row long, vec_id long, score long"
    )
    best = Window.partitionBy("query_id", "query_row").orderBy(F.col("score").desc(), "vec_id")  # k rows a shard at most
    return found.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "query_row", "rank", "vec_id", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best partners of every vector whose id is divisible by 100."""
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").where(F.col("vec_id").isNotNull() & usable(F.col("embedding")))
    vectors = stored(
        rows.select(F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("long").alias("id"), integers(F.col("embedding")).alias("v")),
        "topk-vectors",
    )
    return top_k(vectors.where(F.col("id") % 100 == 0), vectors).drop("query_row")


_VECTORS = """
SELECT vec_id, row_number() OVER () AS own, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
"""
QUERIES = {"op3_topk": op3_topk}
ORACLE_SQL = {
    "op3_topk": f"""
WITH vectors AS MATERIALIZED ({_VECTORS}),
scored AS (
  SELECT q.vec_id AS query_id, q.own, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.own <> c.own WHERE q.vec_id % 100 = 0)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY query_id, own ORDER BY score DESC, vec_id) AS rank FROM scored)
WHERE rank <= 10
"""
}

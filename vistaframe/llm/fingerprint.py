"""Document fingerprints: bottom-k sketches of shingle hashes, with DataFrame functions only.

A sketch is the sorted list of the k smallest 64-bit hashes of a text's five-word shingles. Sketches of the parts of a
corpus merge into the sketch of the whole, and estimate how many distinct shingles a text has, how alike two texts are
and how much of one is contained in the other.

Defined results: a null text counts as empty; an empty text has an empty sketch; fewer than five words are one shingle;
two empty sketches are alike (1.0), an empty and a non-empty one are not (0.0). Documents of one id follow one another by
a hash of their texts, null ids come last; repeated rows give a row each, and all but the last of them have their own text
as the next one. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import SPACE, documents, stored

K = 64
WORDS = 5


def sketch(text: Column, k: int = K, words: int = WORDS) -> Column:
    """The k smallest distinct shingle hashes of a text, sorted, as array<bigint>."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), f"[{SPACE}]+"), lambda w: w != "")
    hashes = F.transform(parts, lambda w: F.xxhash64(w))

    def shingles(hs: Column) -> Column:
        at = F.sequence(F.lit(0), F.size(hs) - F.lit(words))
        long = F.transform(at, lambda i: F.xxhash64(*[F.get(hs, i + j) for j in range(words)]))
        whole = F.when(F.size(hs) > 0, F.array(F.xxhash64(hs))).otherwise(F.array().cast("array<bigint>"))
        return F.when(F.size(hs) >= words, long).otherwise(whole)

    # a let-binding: transform over a one-element array keeps the hashes from being computed at every use
    every = F.get(F.transform(F.array(hashes), shingles), F.lit(0))
    return F.slice(F.sort_array(F.array_distinct(every)), 1, k)


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of the union of what two sketches stand for."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def distinct_count(s: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) / (position of the k-th hash in the range)."""
    position = (F.element_at(s, -1).cast("double") + F.lit(2.0**63)) / F.lit(2.0**64)
    return F.when(F.size(s) < k, F.size(s).cast("double")).otherwise(F.lit(k - 1.0) / position)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimated Jaccard similarity: the share of the union's bottom k that both sketches hold."""
    union = merge(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, F.lit(1.0)).otherwise(both / F.size(union))


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too."""
    r = resemblance(a, b, k)
    shared = r * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, F.lit(1.0)).otherwise(F.least(F.lit(1.0), shared / distinct_count(a, k)))


def merged(df: DataFrame, by: list[str], column: str = "sketch", k: int = K) -> DataFrame:
    """One sketch a group, combined on the map side: each hash of a group crosses the network at most once a task,
    and the k smallest are then taken from hash ranges, so that no group's hashes meet in one list."""
    each = df.select(*by, F.explode(column).alias("_h")).groupBy(*by, "_h").agg(F.lit(1).alias("_one"))
    piece = F.pmod(F.xxhash64("_h"), F.lit(256))
    few = each.withColumn("_piece", piece).withColumn(
        "_r", F.row_number().over(Window.partitionBy(*by, "_piece").orderBy("_h"))
    ).where(F.col("_r") <= k)
    return few.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("_h")), 1, k).alias(column))


def as_text(s: Column) -> Column:
    return F.array_join(F.transform(s, lambda h: F.lower(F.hex(h))), ",")


#: What tells documents apart, without nulls: id (0 for null), whether it is null, hash of the text.
KEY = ("id", "none", "hash")


def order(docs: DataFrame) -> DataFrame:
    """KEY, copies, the KEY of the document before (before_id, ...) and part of each distinct document (KEY, n_chars).

    The order is by descending id, nulls last; before the first document stands the last one. part is a third of the
    characters of the document before. Only ids, hashes and lengths are sorted, over ranges; a row's number is its place in
    its range behind all ranges before.
    """
    keys = docs.groupBy(*KEY).agg(F.count("*").alias("copies"), F.first("n_chars").alias("n_chars"))
    by = ["none", F.col("id").desc(), "hash"]
    place = F.monotonically_increasing_id()  # the partition above 33 bits of the place in it
    ranges = keys.repartitionByRange(*by).sortWithinPartitions(*by)
    placed = stored(ranges.withColumn("range", F.shiftright(place, 33)).withColumn("place", place.bitwiseAND(F.lit((1 << 33) - 1))), "order")
    sizes = placed.groupBy("range").agg(F.count("*").alias("rows"))  # a row a partition
    ahead = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("range", F.coalesce(F.sum("rows").over(ahead), F.lit(0)).alias("ahead"), F.sum("rows").over(Window.partitionBy()).alias("all"))
    numbered = placed.join(F.broadcast(offsets), "range").withColumn("at", F.col("ahead") + F.col("place"))
    part = F.floor(F.col("n_chars") / 3).cast("int").alias("part")
    after = numbered.select(F.pmod(F.col("at") + 1, F.col("all")).alias("at"), *[F.col(k).alias(f"before_{k}") for k in KEY], part)
    return stored(numbered.select("at", *KEY, "copies").join(after, "at").drop("at"), "order")


def neighbours(docs: DataFrame, carried) -> DataFrame:
    """doc_id, text, head, carried and rows of every distinct document: head is the first third of its length (in code
    points) of the document with the next smaller doc_id, carried = carried(that one's text), rows how often it comes so;
    the smallest one's next is the largest.

    docs has doc_id and text. Each text is sent once, to the place of its id and hash; from there the head that the document
    before it needs goes on to that one's place. Repeated rows are sent as one.
    """
    keyed = docs.select(
        F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("none"), F.xxhash64("text").alias("hash"), "text", F.char_length("text").alias("n_chars")
    )
    found = order(keyed.drop("text"))
    several = not found.where("copies > 1").isEmpty()
    texts = keyed.groupBy(*KEY).agg(F.first("text").alias("text")) if several else keyed.select(*KEY, "text")
    rows = texts.join(found, list(KEY))
    heads = rows.select(
        *[F.col(f"before_{k}").alias(k) for k in KEY],
        F.struct(F.substring("text", F.lit(1), F.col("part")).alias("head"), carried(F.col("text")).alias("carried")).alias("next"),
    )
    both = rows.select(*KEY, "text", "copies").join(heads, list(KEY))
    own = F.struct(F.substring("text", F.lit(1), F.floor(F.char_length("text") / 3).cast("int")).alias("head"), carried(F.col("text")).alias("carried"))
    last = F.struct(F.lit(1).cast("long").alias("rows"), F.col("next"))
    among = F.struct((F.col("copies") - 1).alias("rows"), own.alias("next"))  # a repeated row before the last
    each = both.select("id", "none", "text", F.explode(F.when(F.col("copies") == 1, F.array(last)).otherwise(F.array(last, among))).alias("_x"))
    return each.select(F.when(~F.col("none"), F.col("id")).alias("doc_id"), "text", "_x.next.head", "_x.next.carried", "_x.rows")


def repeated(df: DataFrame, times: str = "rows") -> DataFrame:
    """df with each row as often as its column `times` says, without that column."""
    return df.withColumn("_of", F.explode(F.sequence(F.lit(1).cast("long"), F.col(times)))).drop("_of", times)


def op10_fingerprint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of every text and of its edited form, with likenesses.

    Beside the columns asked for: contained, the share of the text's shingles that its edited form has too; n_distinct, the
    number of distinct shingles of the text, and n_distinct_both, of the text and the next one together (merged sketches).
    """
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n = F.char_length("text")
    edited = F.concat(F.substring("text", F.lit(1), n - F.floor(n / 3).cast("int")), F.col("head"))
    out = neighbours(docs, sketch).select(
        "doc_id", "rows", n.cast("long").alias("n_chars"), sketch(F.col("text")).alias("sketch"), edited.alias("edited"), F.col("carried").alias("_after")
    )
    out = out.withColumn("edited_sketch", sketch(F.col("edited")))
    return repeated(out.select(
        "doc_id",
        "rows",
        "n_chars",
        F.sha2(F.encode("edited", "UTF-8"), 256).alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited_sketch")).alias("near_edited"),
        resemblance(F.col("sketch"), F.col("_after")).alias("near_next"),
        containment(F.col("sketch"), F.col("edited_sketch")).alias("contained"),
        distinct_count(F.col("sketch")).alias("n_distinct"),
        distinct_count(merge(F.col("sketch"), F.col("_after"))).alias("n_distinct_both"),
    ))


QUERIES = {"op10_fingerprint": op10_fingerprint}
ORACLE_SQL: dict = {}

"""BPE encoding and decoding with content-defined chunk reuse.

A rolling hash over a text's bytes picks places that depend on nothing but the sixteen bytes before them; each is moved
to the next start of a word, and the text is cut there. Equal passages of different documents so give equal chunks, and
a task encodes each chunk once, as long as it stays in a store of bounded size. Where two chunks meet, a window of the
last word of one and the first word of the other is encoded in one piece and compared with what the two chunks gave; a
window that disagrees is widened word by word until its ends agree, and its ids replace theirs.

Encoding uses the vocabulary as ranks; ids equal those of the tokenizers library for byte_bpe_50k.json, special token
included.

Defined results: a null or empty text has no ids and decodes to an empty text; repeated rows give repeated results;
columns of the input are kept, and those named like the result are replaced.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches

RANKS = "byte_bpe_50k.tiktoken"
SPECIAL = {"<|endoftext|>": 50256}
#: A chunk ends where this many low bits of the rolling hash are 0: about every 1,024 bytes.
MASK = np.uint32((1 << 10) - 1)
#: Characters whose chunks' ids a task keeps in each of two generations: about a byte and a half a character.
KEPT_CHARS = 2_000_000
#: Bytes of texts that are encoded at a time: an id takes some forty bytes while it is a Python integer.
TAKEN = 500_000


@cache
def encoder():
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(RANKS), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=SPECIAL)


@cache
def _gear() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(1)).integers(0, 2**32, 256, np.uint32)


def cuts(text: str) -> list[int]:
    """Places (in code points) where the text is cut into chunks: starts of words that follow a hash hit."""
    data = np.frombuffer(text.encode("utf-8"), np.uint8)
    if len(data) < 64:
        return []
    h = _gear()[data]
    for step in (1, 2, 4, 8):  # after these, h[i] is a hash of bytes i-15..i
        h[step:] += h[:-step] << np.uint32(step)
    hits = np.flatnonzero((h[16:] & MASK) == 0) + 16
    if not len(hits):
        return []
    space = data == 32
    starts = np.flatnonzero(space[1:-1] & ~space[:-2] & (data[:-2] > 32) & (data[2:] > 32)) + 1
    at = np.searchsorted(starts, hits)
    places = np.unique(starts[at[at < len(starts)]])
    if len(data) == len(text):
        return places.tolist()
    return np.searchsorted(np.flatnonzero((data & 0xC0) != 0x80), places).tolist()


class Chunks:
    """Ids of chunks by digest, each encoded once while it is kept; two generations bound what is kept."""

    def __init__(self, encode) -> None:
        self.encode, self.new, self.old, self.chars = encode, {}, {}, 0
        self.seen = self.reused = 0

    def ids(self, chunk: str) -> list[int]:
        key = hashlib.blake2b(chunk.encode("utf-8", "surrogatepass"), digest_size=16).digest()
        self.seen += len(chunk)
        found = self.new.get(key)
        if found is None:
            found = self.old.get(key)
            if found is None:
                ids = self.encode(chunk)
                found = np.array(ids, np.int32).tobytes()
            else:
                ids = None
            self.new[key] = found
            self.chars += len(chunk)
            if self.chars > KEPT_CHARS:
                self.old, self.new, self.chars = self.new, {}, 0
            if ids is not None:
                return ids
        self.reused += len(chunk)
        return np.frombuffer(found, np.int32).tolist()


def _tail(text: str, words: int) -> int:
    at = len(text)
    for _ in range(words):
        at = text.rfind(" ", 0, at)
        if at <= 0:
            return 0
    return at


def _head(text: str, words: int) -> int:
    at = 0
    for _ in range(words):
        at = text.find(" ", at + 1)
        if at < 0:
            return len(text)
    return at


def joined(chunks: list[str], ids_of, encode) -> list[int]:
    """Ids of the chunks' text: ids of each chunk, repaired where two of them meet."""
    out = list(ids_of(chunks[0]))
    left = chunks[0]  # the text whose ids are the last ones of out
    for right in chunks[1:]:
        ids, words = ids_of(right), 1
        while True:
            a, b = _tail(left, words), _head(right, words)
            tail, head = encode(left[a:]), encode(right[:b])
            agree = out[len(out) - len(tail):] == tail and ids[: len(head)] == head
            if agree or (a == 0 and b == len(right)):
                break
            words *= 2
        window, rest = encode(left[a:] + right[:b]), ids[len(head):]
        if window != tail + head:
            out[len(out) - len(tail):] = window
        else:
            out += head
        out += rest
        left = right[b:] if b < len(right) else left[a:] + right
    return out


class Encoder:
    def __init__(self) -> None:
        tk = encoder()
        self.encode = lambda s: tk.encode(s, allowed_special="all")
        self.chunks = Chunks(self.encode)

    def __call__(self, text: str) -> list[int]:
        if not text:
            return []
        at = cuts(text)
        if not at:
            return self.chunks.ids(text)
        edges = [0, *at, len(text)]
        return joined([text[a:b] for a, b in zip(edges, edges[1:])], self.chunks.ids, self.encode)


def _taken(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches' rows in runs of about TAKEN bytes of text, one row at least."""
    for batch in batches:
        ends = np.cumsum(pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
        edges = [0, *(np.flatnonzero(np.diff(ends // TAKEN)) + 1).tolist(), len(ends)]
        for a, b in zip(edges, edges[1:]):
            yield batch.slice(a, b - a)


def _ids(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = Encoder()
    for batch in _taken(batches):
        yield _with(batch, "ids", _lists([encode(t or "") for t in batch.column("text").to_pylist()]))


def _lists(ids: list[list[int]]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, ids)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.fromiter(chain.from_iterable(ids), np.int32, int(ends[-1]))))


def _both(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """ids in place of text, and decoded: one pass through Python for the way there and back."""
    encode, tk = Encoder(), encoder()
    for batch in _taken(batches):
        ids = [encode(t or "") for t in batch.column("text").to_pylist()]
        keep = [n for n in batch.schema.names if n != "text"]
        decoded = pa.array([tk.decode_bytes(x).decode("utf-8", "replace") for x in ids], pa.string())
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), _lists(ids), decoded], [*keep, "ids", "decoded"])


def _texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    tk = encoder()
    for batch in batches:
        lists = batch.column("ids")
        values, ends = lists.values.to_pylist(), lists.offsets.to_pylist()
        texts = [tk.decode_bytes(values[a:b]).decode("utf-8", "replace") for a, b in zip(ends, ends[1:])]
        yield _with(batch, "decoded", pa.array(texts, pa.string()))


def _with(batch: pa.RecordBatch, name: str, values: pa.Array) -> pa.RecordBatch:
    keep = [n for n in batch.schema.names if n != name]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in keep), values], [*keep, name])


def encode(df: DataFrame) -> DataFrame:
    """df with ids: array<int>, the ids of its column text."""
    small_batches(df.sparkSession)
    kept = df.drop("ids")
    schema = T.StructType([*kept.schema.fields, T.StructField("ids", T.ArrayType(T.IntegerType()))])
    return kept.mapInArrow(_ids, schema)


def decode(df: DataFrame) -> DataFrame:
    """df with decoded: the text of its column ids."""
    small_batches(df.sparkSession)
    kept = df.drop("decoded").withColumn("ids", F.coalesce("ids", F.array().cast("array<int>")))
    schema = T.StructType([*kept.schema.fields, T.StructField("decoded", T.StringType())])
    return kept.mapInArrow(_texts, schema)


def digests(df: DataFrame, *columns: str) -> DataFrame:
    """The given columns, n_tokens, ids_sha256 and decoded_sha256 of df's texts, encoded and decoded again."""
    small_batches(df.sparkSession)
    rows = df.select(*columns, "text")
    results = [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    both = rows.mapInArrow(_both, T.StructType([f for f in rows.schema.fields if f.name != "text"] + results))
    return both.select(
        *columns,
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2(F.encode("decoded", "UTF-8"), 256).alias("decoded_sha256"),
    )


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 for every document."""
    return digests(documents(spark, sf_dir), "doc_id")


QUERIES = {"op7_bpe": op7_bpe}
ORACLE_SQL: dict = {}

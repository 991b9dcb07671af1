"""Fill-in-middle transformation over seekable compressed frames.

A text is stored as independent zstandard frames of so many code points (its units) each, with the cumulative unit counts:
to cut it at a place, the frame that holds the place is found by its count and decompressed, and nothing else is. The
transformed document is the frames of prefix, middle and suffix in their new order: whole frames are taken over as they
are, and the cut ones and the markers become frames of their own. Digests and searches stream over frames in order, so
no more than a frame is ever decompressed at a time.

The places of the cuts, whether a document is transformed and in which of two orders come from a hash of its id. Texts
that hold a marker stay plain, so the markers of the others tell their parts, and the text is rebuilt from the output and
its form alone.

Defined results: null and empty texts are plain with 0 units; repeated rows give repeated results; a null id is hashed as
an empty text; empty tables give empty ones; other columns are kept, and those named like a result replaced.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches

PREFIX, SUFFIX, MIDDLE = MARKERS = "<P>", "<S>", "<M>"
SEED = "1"
#: Of 100 documents, how many are transformed, and how many of those begin with the suffix.
RATE, SUFFIX_FIRST = 90, 20
#: Code points of a frame.
FRAME = 1 << 16
LEVEL = 1


@cache
def _zstd():
    import zstandard

    return zstandard.ZstdCompressor(level=LEVEL), zstandard.ZstdDecompressor()


def _packed(piece: str) -> bytes:
    return _zstd()[0].compress(piece.encode("utf-8", "surrogatepass"))


def _opened(frame: bytes) -> bytes:
    return _zstd()[1].decompress(frame)


class Frames:
    """A text as compressed frames, and the number of units up to the end of each."""

    def __init__(self, frames: list[bytes] | None = None, ends: list[int] | None = None) -> None:
        self.frames, self.ends = frames or [], ends or []

    @classmethod
    def of(cls, text: str, size: int = FRAME) -> Frames:
        out = cls()
        for at in range(0, len(text), size):
            out.add(text[at : at + size])
        return out

    def __len__(self) -> int:
        return self.ends[-1] if self.ends else 0

    def add(self, piece: str) -> None:
        if piece:
            self.frames.append(_packed(piece))
            self.ends.append(len(self) + len(piece))

    def take(self, frame: bytes, units: int) -> None:
        self.frames.append(frame)
        self.ends.append(len(self) + units)

    def extend(self, other: Frames) -> Frames:
        for k, frame in enumerate(other.frames):
            self.take(frame, other.units(k))
        return self

    def units(self, k: int) -> int:
        return self.ends[k] - (self.ends[k - 1] if k else 0)

    def bytes(self) -> Iterator[bytes]:
        return map(_opened, self.frames)

    def part(self, low: int, high: int) -> Frames:
        """Units low to high: whole frames as they are, and of those at the ends what belongs to it."""
        out = Frames()
        for k in range(bisect_right(self.ends, low), len(self.ends)):
            begin = self.ends[k] - self.units(k)
            if begin >= high:
                break
            if low <= begin and self.ends[k] <= high:
                out.take(self.frames[k], self.units(k))
            else:
                out.add(_opened(self.frames[k]).decode("utf-8", "surrogatepass")[max(0, low - begin) : high - begin])
        return out

    def find(self, marks: Iterable[str]) -> dict[str, int]:
        """The unit where each mark first begins, if it is there, in one pass."""
        out, tail, at, left = {}, "", 0, set(marks)
        longest = max(map(len, left))
        for k, raw in enumerate(self.bytes()):
            text = tail + raw.decode("utf-8", "surrogatepass")
            for m in [m for m in left if m in text]:
                out[m] = at - len(tail) + text.index(m)
                left.discard(m)
            at += self.units(k)
            tail = text[-(longest - 1) :] if longest > 1 else ""
        return out

    def text(self) -> str:
        return b"".join(self.bytes()).decode("utf-8", "surrogatepass")

    def sha256(self) -> str:
        out = hashlib.sha256()
        for raw in self.bytes():
            out.update(raw)
        return out.hexdigest()


def _joined(*parts: str | Frames) -> Frames:
    out = Frames()
    for p in parts:
        out.add(p) if isinstance(p, str) else out.extend(p)
    return out


def transformed(doc_id, text: Frames, seed: str = SEED) -> tuple[str, Frames, int | None, int | None]:
    """(form, output, units of the prefix, units of the middle) of one document."""
    digest = hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(text)
    if not n or h[2] % 100 >= RATE or text.find(MARKERS):
        return "plain", text, None, None
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = text.part(0, a), text.part(a, b), text.part(b, n)
    if h[3] % 100 < SUFFIX_FIRST:
        return "spm", _joined(SUFFIX, suffix, PREFIX, prefix, MIDDLE, middle), a, b - a
    return "psm", _joined(PREFIX, prefix, SUFFIX, suffix, MIDDLE, middle), a, b - a


def restored(form: str, output: Frames) -> Frames:
    """The text that an output and its form stand for."""
    if form == "plain":
        return output
    at = output.find(MARKERS)
    order = sorted(MARKERS, key=at.get)
    ends = {m: at[x] for m, x in zip(order, order[1:])} | {order[-1]: len(output)}
    return _joined(*(output.part(at[m] + len(m), ends[m]) for m in (PREFIX, MIDDLE, SUFFIX)))


FRAMED = {"frames": T.ArrayType(T.BinaryType()), "ends": T.ArrayType(T.LongType())}
MOVED = FRAMED | {"n": T.LongType(), "form": T.StringType(), "prefix_chars": T.LongType(), "middle_chars": T.LongType()}


def _mapped(df: DataFrame, gone: tuple[str, ...], results: dict, of) -> DataFrame:
    """df without the columns gone, and with the results that `of` gives for a row of the columns it names first."""
    small_batches(df.sparkSession)
    needs, make = of
    kept = [c for c in df.columns if c not in results and c not in gone]
    schema = T.StructType([*df.select(*kept).schema.fields, *(T.StructField(k, t) for k, t in results.items())])
    types = [f.type for f in pa.schema([(k, _arrow(t)) for k, t in results.items()])]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [make(*r) for r in zip(*(batch.column(c).to_pylist() for c in needs))]
            arrays = [pa.array([m[k] for m in made], t) for k, t in enumerate(types)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *arrays], [*kept, *results])

    return df.select(*dict.fromkeys([*kept, *needs])).mapInArrow(rows, schema)


def _arrow(t: T.DataType) -> pa.DataType:
    if isinstance(t, T.ArrayType):
        return pa.list_(_arrow(t.elementType))
    return {T.BinaryType(): pa.binary(), T.LongType(): pa.int64(), T.StringType(): pa.string()}[t]


def framed(df: DataFrame, size: int = FRAME) -> DataFrame:
    """df with its column text as frames: array<binary> and ends: array<long>, the units up to the end of each."""

    def make(text: str | None):
        f = Frames.of(text or "", size)
        return f.frames, f.ends

    return _mapped(df, ("text",), FRAMED, (["text"], make))


def fill_in_middle(df: DataFrame, id_column: str = "doc_id", seed: str = SEED) -> DataFrame:
    """Framed documents with the frames of their outputs, n (units of the text), form, prefix_chars and middle_chars."""

    def make(doc_id, frames, ends):
        form, out, prefix, middle = transformed(doc_id, Frames(frames, ends), seed)
        return out.frames, out.ends, ends[-1] if ends else 0, form, prefix, middle

    return _mapped(df, (), MOVED, ([id_column, "frames", "ends"], make))


def undone(df: DataFrame) -> DataFrame:
    """Outputs as framed documents again, by their form."""

    def make(form, frames, ends):
        out = restored(form, Frames(frames, ends))
        return out.frames, out.ends

    return _mapped(df, (), FRAMED, (["form", "frames", "ends"], make))


def texts(df: DataFrame) -> DataFrame:
    """Framed documents with their texts."""
    return _mapped(df, ("frames", "ends"), {"text": T.StringType()}, (["frames"], lambda frames: (Frames(frames).text(),)))


def digests(df: DataFrame) -> DataFrame:
    """output_sha256, and restored_sha256 of the text that is rebuilt from output and form, in place of the frames."""

    def make(form, frames, ends):
        out = Frames(frames, ends)
        return out.sha256(), restored(form, out).sha256()

    return _mapped(df, ("frames", "ends"), {"output_sha256": T.StringType(), "restored_sha256": T.StringType()}, (["form", "frames", "ends"], make))


def op13_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output_sha256, restored_sha256 of every document."""
    docs = documents(spark, sf_dir).select("doc_id", "text")
    return digests(fill_in_middle(framed(docs))).select("doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256", "restored_sha256")


SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, sha256('{SEED}:' || doc_id) AS x FROM documents),
h AS (SELECT doc_id, t, CAST(length(t) AS BIGINT) AS n, {", ".join(f"CAST('0x' || substr(x, {8 * k + 1}, 8) AS BIGINT) AS h{k + 1}" for k in range(4))} FROM d),
cuts AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
         CASE WHEN n = 0 OR contains(t, '{PREFIX}') OR contains(t, '{SUFFIX}') OR contains(t, '{MIDDLE}') OR h3 % 100 >= {RATE} THEN 'plain'
              WHEN h4 % 100 < {SUFFIX_FIRST} THEN 'spm' ELSE 'psm' END AS form FROM h),
parts AS (SELECT *, substr(t, 1, a) AS p, substr(t, a + 1, b - a) AS m, substr(t, b + 1) AS s FROM cuts)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN a END AS prefix_chars, CASE WHEN form <> 'plain' THEN b - a END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{PREFIX}' || p || '{SUFFIX}' || s || '{MIDDLE}' || m
              ELSE '{SUFFIX}' || s || '{PREFIX}' || p || '{MIDDLE}' || m END) AS output_sha256,
       sha256(t) AS restored_sha256 FROM parts
"""

QUERIES = {"op13_fim": op13_fim}
ORACLE_SQL = {"op13_fim": SQL}

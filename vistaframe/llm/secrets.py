"""Secret scans: fixed patterns, and a randomness test battery with false-discovery control.

Patterns find assigned values, access keys and long hex strings. Beside them every unbroken run of SHORTEST or more
encoding characters is a token, also where it only touches a pattern's find; its encoding (hex, base32, base64) is inferred
from its characters, and three tests say how well it fits uniform random symbols of that alphabet: chi-squared over symbol
counts, runs about the middle of the alphabet, and lag-one serial correlation. Their squared deviates sum to one p-value,
large for random-looking tokens. The values that the patterns find go through the same battery, and their p-values are given.

Decoys go through the same tests: ordinary words and plain numbers that are tokens, and the words of every text written
without gaps, in pieces of the bands' lengths, for base32 in capitals. For each encoding and length band the share of
decoys above a p-value, counted over the whole corpus, gives the rate of false finds there among all tested values, those
of the patterns included; the lowest p-value at which that rate stays within ALPHA is the band's threshold. An
encoding that has no decoys in a band takes those of the next wider one there, under that one's tests; where none has any,
those of shorter bands count (the longer a decoy, the less it looks random, so this can only raise the rate). Without any
decoys a band finds nothing.

Defined results: a null text counts as empty; an empty text or table has no spans; repeated rows give repeated results;
offsets are code points, end exclusive; tokens may be of any length; columns beside doc_id and text are ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import documents, small_batches, stored

KINDS = ("assign", "access", "hex", "random")
ALPHA = 0.05
BINS = 100
LAST_BAND = 12
SHORTEST = 12

# The patterns of the base scan. A run of [A-Z0-9] or [0-9a-f] is matched whole either way, so the
# lengths 18 and 16 can stand in the pattern; an assigned value's length cannot, as a short match uses up its text.
ASSIGN = re.compile(
    r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII
)
ACCESS = re.compile(r"AKIA[A-Z0-9]{14,}")
HEX = re.compile(r"[0-9a-f]{16,}")
TOKEN = re.compile(rf"[A-Za-z0-9+/_-]{{{SHORTEST},}}")

#: Encodings: name, alphabet in order (as many symbols as the second number), characters that tell it.
ENCODINGS = (
    ("hex", 16, "0123456789abcdef", re.compile(r"[0-9a-f]+|[0-9A-F]+")),
    ("base32", 32, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", re.compile(r"[A-Z2-7]+")),
    ("base64", 64, "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", re.compile(r"[A-Za-z0-9+/_-]+")),
)


def _tables() -> list[np.ndarray]:
    out = []
    for name, _, alphabet, _ in ENCODINGS:
        t = np.zeros(128, np.int64)
        for i, c in enumerate(alphabet):
            t[ord(c)] = i
            if name == "hex":
                t[ord(c.upper())] = i
        t[ord("-")], t[ord("_")] = (62, 63) if name == "base64" else (0, 0)
        out.append(t)
    return out


def battery(tokens: list[str], encoding: int) -> np.ndarray:
    """p-value of each token under uniform random symbols of the encoding."""
    size, table = ENCODINGS[encoding][1], _tables()[encoding]
    lengths = np.array([len(t) for t in tokens])
    x = table[np.frombuffer("".join(tokens).encode("ascii"), np.uint8)]
    owner = np.repeat(np.arange(len(tokens)), lengths)
    keys, counts = np.unique(owner * size + x, return_counts=True)
    squares = np.bincount(keys // size, counts.astype(float) ** 2, len(tokens))
    n = lengths.astype(float)
    chi = (squares * size / n - n - (size - 1)) / np.sqrt(2 * (size - 1) * (n - 1) / n)
    same = owner[1:] == owner[:-1]
    high = x >= size // 2
    runs = 1 + np.bincount(owner[1:][same], (high[1:] != high[:-1])[same], len(tokens))
    run_z = (runs - 1 - (n - 1) / 2) / np.sqrt((n - 1) / 4)
    c = x - (size - 1) / 2
    products = np.bincount(owner[1:][same], (c[1:] * c[:-1])[same], len(tokens))
    serial_z = products / ((size * size - 1) / 12) / np.sqrt(n - 1)
    total = np.maximum(chi, 0) ** 2 + run_z**2 + serial_z**2
    root = np.sqrt(total / 2)  # upper tail of chi-squared with three degrees of freedom
    return np.array([math.erfc(r) for r in root]) + np.sqrt(2 * total / math.pi) * np.exp(-total / 2)


def kind_of_token(token: str) -> tuple[int, bool] | None:
    """(encoding, is a decoy), or None for what is neither a plausible secret nor a plain word or number."""
    low, up, digit = (any(f(c) for c in token) for f in (str.islower, str.isupper, str.isdigit))
    plain = low + up + digit <= 1 or (low and not digit and token[1:].islower())
    for i, e in enumerate(ENCODINGS):
        if e[3].fullmatch(token):
            return i, plain
    return None


def base_spans(text: str) -> list[tuple[str, int, int]]:
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= 12]
    found += [("access", *m.span()) for m in ACCESS.finditer(text)]
    found += [("hex", *m.span()) for m in HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


SPAN = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
BASE = T.StructType([*SPAN.fields, T.StructField("encoding", T.IntegerType()), T.StructField("band", T.IntegerType()), T.StructField("p", T.DoubleType())])
TESTED = T.StructType([
    *(T.StructField(n, T.IntegerType()) for n in ("start", "end", "encoding", "band", "bin")), T.StructField("p", T.DoubleType()),
])
DECOYS = T.StructType([T.StructField(n, T.IntegerType()) for n in ("encoding", "band", "bin", "n")])
SCAN = T.StructType([
    T.StructField("base", T.ArrayType(BASE)), T.StructField("tested", T.ArrayType(TESTED)), T.StructField("decoys", T.ArrayType(DECOYS)),
])


#: Ordinary words, the lengths of pieces that are made of them by turns, one a band, and characters that are tested at a time.
WORD = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z]{2,11}(?![A-Za-z0-9+/_=-])")
LENGTHS = (12, 17, 23, 33, 46, 65, 91)
TESTED_CHARS = 200_000


def written_on(text: str) -> tuple[list[str], list[str]]:
    """The words of a text without gaps, in pieces of LENGTHS: for base32, in capitals, and for base64."""
    letters, out, at, k = "".join(WORD.findall(text)), ([], []), 0, 0
    while at + (size := LENGTHS[k // 2 % len(LENGTHS)]) <= len(letters):
        piece = letters[at : at + size]
        out[k % 2].append(piece if k % 2 else piece.upper())
        at += size
        k += 1
    return out


def band(token: str) -> int:
    """Length bands, two for each doubling of the length."""
    return min(LAST_BAND, int(2 * math.log2(len(token))))


def tokens(text: str, spans: list[tuple[str, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of the tokens of a text, cut where base spans (sorted by start) begin or end, without those inside them."""
    taken: list[list[int]] = []  # the spans' places without overlaps
    for _, a, b in spans:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    out, i = [], 0
    for m in TOKEN.finditer(text):
        at, end = m.span()
        while i < len(taken) and taken[i][1] <= at:
            i += 1
        j = i
        while j < len(taken) and taken[j][0] < end:
            out.append((at, taken[j][0]))
            at = taken[j][1]
            j += 1
        out.append((at, end))
    return [(a, b) for a, b in out if b - a >= SHORTEST]


@F.pandas_udf(SCAN)
def scan(texts: pd.Series) -> pd.DataFrame:
    """Base spans, tested tokens outside them, and counts of decoys, per text."""
    base, places = [], [[] for _ in ENCODINGS]
    for row, text in enumerate(texts):
        text = text or ""
        spans = base_spans(text)
        base.append([{"kind": k, "start": a, "end": b, "encoding": None, "band": None, "p": None} for k, a, b in spans])
        for i, (k, a, b) in enumerate(spans):
            value = (ASSIGN.match(text, a, b)[2] if k == "assign" else text[a:b]).rstrip("=")
            if len(value) >= 2 and (found := kind_of_token(value)):
                places[found[0]].append((row, i, None, False, value))
        for a, b in tokens(text, spans):
            if found := kind_of_token(text[a:b]):
                places[found[0]].append((row, a, b, found[1], text[a:b]))
    tested, decoys = [[] for _ in base], [{} for _ in base]
    for encoding, found in enumerate(places):
        if found:
            for (row, a, b, plain, token), p in zip(found, battery([f[4] for f in found], encoding).tolist()):
                at = (encoding, band(token), min(BINS - 1, int(p * BINS)))
                if b is None:
                    base[row][a] |= {"encoding": encoding, "band": at[1], "p": p}
                elif plain:
                    decoys[row][at] = decoys[row].get(at, 0) + 1
                else:
                    tested[row].append(dict(zip(("start", "end", "encoding", "band", "bin", "p"), (a, b, *at, p))))
    pieces, size = ([], []), 0
    for row, text in enumerate(texts):
        for held, new in zip(pieces, written_on(text or "")):
            held += new
            size += sum(map(len, new))
        if size and (size > TESTED_CHARS or row == len(base) - 1):
            for encoding, held in zip((1, 2), pieces):
                for at in range(0, len(held), TESTED_CHARS // LENGTHS[-1]):
                    some = held[at : at + TESTED_CHARS // LENGTHS[-1]]
                    bins = np.minimum(BINS - 1, (battery(some, encoding) * BINS).astype(int)).tolist()
                    for key, n in Counter(zip([encoding] * len(some), map(band, some), bins)).items():
                        decoys[row][key] = decoys[row].get(key, 0) + n
            pieces, size = ([], []), 0
    lists = [[dict(zip(("encoding", "band", "bin", "n"), (*k, n))) for k, n in d.items()] for d in decoys]
    return pd.DataFrame({"base": base, "tested": tested, "decoys": lists})


def thresholds(scanned: DataFrame, alpha: float = ALPHA) -> dict[tuple[int, int], int]:
    """(encoding, band) -> the lowest bin of p-values whose false-discovery rate is within alpha; bands without one are missing."""
    t = scanned.select(F.explode("s.tested").alias("x")).select("x.encoding", "x.band", "x.bin", F.lit(1).alias("tokens"), F.lit(0).alias("plain"))
    bin_of = F.least(F.lit(BINS - 1), F.floor(F.col("x.p") * BINS)).cast("int").alias("bin")
    b = scanned.select(F.explode("s.base").alias("x")).where("x.p is not null").select("x.encoding", "x.band", bin_of, F.lit(1).alias("tokens"), F.lit(0).alias("plain"))
    d = scanned.select(F.explode("s.decoys").alias("x")).select("x.encoding", "x.band", "x.bin", F.lit(0).alias("tokens"), F.col("x.n").alias("plain"))
    counts = t.unionByName(b).unionByName(d).groupBy("encoding", "band", "bin").agg(F.sum("tokens").alias("tokens"), F.sum("plain").alias("plain"))
    # at most 3 encodings x LAST_BAND bands x BINS bins come to the driver
    n = np.zeros((2, len(ENCODINGS), LAST_BAND + 1, BINS))
    for r in counts.collect():
        n[:, r.encoding, r.band, r.bin] = r.tokens, r.plain
    return chosen(n, alpha)


def chosen(n: np.ndarray, alpha: float = ALPHA) -> dict[tuple[int, int], int]:
    """The thresholds by counts of tokens and of decoys, each by encoding, band and bin."""
    above = n[:, :, :, ::-1].cumsum(3)[:, :, :, ::-1]
    own, shorter = above[1], above[1].cumsum(1)
    for pool in (own, shorter):
        for e in reversed(range(len(ENCODINGS) - 1)):
            pool[e] = np.where(pool[e][:, :1] == 0, pool[e + 1], pool[e])
    decoys = np.where(own[:, :, :1] > 0, own, shorter)
    false_share = (decoys + 1) / (decoys[:, :, :1] + 1)
    rate = false_share * above[0][:, :, :1] / np.maximum(above[0], 1)
    good = (rate <= alpha) & (above[0] > 0) & (np.arange(BINS) >= 1)
    return {(int(e), int(b)): int(good[e, b].argmax()) for e, b in zip(*np.nonzero(good.any(2)))}


def find_secrets(df: DataFrame, alpha: float = ALPHA) -> DataFrame:
    """doc_id, spans: array of (kind, start, end) by start, then kind; base spans are always among them.

    base_tests has for each base span its value's p-value (null if it fits no encoding), and whether it passes for random.
    """
    small_batches(df.sparkSession)
    scanned = stored(df.select("doc_id", scan(F.coalesce("text", F.lit(""))).alias("s")), "secret-scan")
    # at most 3 encodings x 13 bands: the thresholds travel as one small map
    found = {f"{e}-{b}": n for (e, b), n in thresholds(scanned, alpha).items()}
    least = F.create_map(*[F.lit(x) for kv in (found or {"": BINS}).items() for x in kv])

    def limit(x: Column) -> Column:
        return F.coalesce(F.try_element_at(least, F.concat_ws("-", x["encoding"].cast("string"), x["band"].cast("string"))), F.lit(BINS))

    passed = F.filter("s.tested", lambda x: x["bin"] >= limit(x))
    base = F.transform("s.base", lambda x: F.struct(*[x[c].alias(c) for c in ("kind", "start", "end")]))
    rank = lambda k: F.array_position(F.array(*[F.lit(x) for x in KINDS]), k)
    spans = F.array_sort(
        F.transform(
            F.concat(base, F.transform(passed, lambda x: F.struct(F.lit("random").alias("kind"), x["start"].alias("start"), x["end"].alias("end")))),
            lambda x: F.struct(x["start"].alias("start"), rank(x["kind"]).alias("rank"), x["end"].alias("end"), x["kind"].alias("kind")),
        )
    )
    judged = F.transform("s.base", lambda x: F.struct(x["p"].alias("p"), F.coalesce(F.floor(x["p"] * BINS) >= limit(x), F.lit(False)).alias("random")))
    return scanned.select(
        "doc_id", F.transform(spans, lambda x: F.struct(x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))).alias("spans"),
        judged.alias("base_tests"),
    )


def as_text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans, base_p, n_base_random for every document."""
    found = find_secrets(documents(spark, sf_dir))
    kinds = F.transform("spans", lambda x: x["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    base = F.filter("spans", lambda x: x["kind"] != "random")
    return found.select(
        "doc_id", *n, F.sha2(as_text(base), 256).alias("base_sha256"), as_text(F.col("spans")).alias("spans"),
        F.array_join(F.transform("base_tests", lambda x: F.coalesce(F.round(x["p"], 6).cast("string"), F.lit("-"))), ",").alias("base_p"),
        F.size(F.filter("base_tests", lambda x: x["random"])).cast("long").alias("n_base_random"),
    )


QUERIES = {"op2_secrets": op2_secrets}
ORACLE_SQL: dict = {}

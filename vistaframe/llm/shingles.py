"""Word shingles of whole batches of texts as sorted 64-bit hashes, with numpy."""

from __future__ import annotations

import numpy as np

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[32, 9, 10, 11, 12, 13]] = True
#: An odd multiplier, so that its powers can be undone, and odd factors for the words of a shingle.
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_FACTOR = np.uint64(0xC2B2AE3D27D4EB4F)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    if n:
        out[0] = 1
    return np.multiply.accumulate(out)


def words(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of every word, number of words of each text); A-Z count as a-z."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    data = _LOWER[np.frombuffer(b" " + b" ".join(raw) + b" ", np.uint8)]
    space = _SPACE[data]
    starts = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    ends = np.flatnonzero(~space[:-1] & space[1:]) + 1
    terms = (data.astype(np.uint64) + np.uint64(1)) * _powers(_BASE, len(data))
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(terms)])
    hashes = mix((sums[ends] - sums[starts]) * _powers(_INVERSE, len(data))[starts])
    limits = np.cumsum([1, *(len(r) + 1 for r in raw)])
    return hashes, np.diff(np.searchsorted(starts, limits))


#: Characters of texts that are taken at a time, if there is more than one text: a byte costs some forty while it is hashed.
TAKEN = 500_000


def shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text; fewer words than size are one shingle, no word is none."""
    out, some, chars = [], [], 0
    for t in texts:
        if some and chars + len(t or "") > TAKEN:
            out += _shingles(some, size)
            some, chars = [], 0
        some.append(t)
        chars += len(t or "")
    return out + (_shingles(some, size) if some else [])


def _shingles(texts: list[str | None], size: int) -> list[np.ndarray]:
    hashes, counts = words(texts)
    n = len(hashes)
    rolled = np.zeros(max(0, n - size + 1), np.uint64)
    for j in range(size):
        rolled = rolled * _FACTOR + hashes[j : n - size + 1 + j] if len(rolled) else rolled
    rolled = mix(rolled)
    out, at = [], 0
    for c in counts.tolist():
        if c >= size:
            out.append(np.unique(rolled[at : at + c - size + 1]))
        elif c:
            whole = np.uint64(c)
            with np.errstate(over="ignore"):
                for h in hashes[at : at + c]:
                    whole = whole * _FACTOR + h
            out.append(mix(np.array([whole])))
        else:
            out.append(np.zeros(0, np.uint64))
        at += c
    return out

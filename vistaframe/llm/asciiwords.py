"""Words of letters, digits and all characters beyond ASCII, A-Z counted as a-z, as places and 64-bit hashes, with numpy."""

from __future__ import annotations

from functools import cache

import numpy as np

from .shingles import mix

LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))
#: By byte of a lower-cased text in UTF-8, whether it belongs to a word. As a pattern over characters: PATTERN.
IN_WORD = np.zeros(256, bool)
IN_WORD[48:58] = IN_WORD[97:123] = IN_WORD[128:] = True
PATTERN = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Bytes that are hashed at a time; a byte costs some forty meanwhile.
PIECE = 1 << 19
_BASE = 0x9E3779B97F4A7C15


def lowered(texts: list[str | None]) -> tuple[bytes, np.ndarray]:
    """The texts in UTF-8 with A-Z as a-z, one zero byte behind each, and where each begins, with the end of all."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    begins = np.zeros(len(raw) + 1, np.int64)
    np.cumsum([len(r) + 1 for r in raw], out=begins[1:])
    return b"\0".join([*raw, b""]).translate(LOWER), begins


@cache
def _powers(inverse: bool, n: int) -> np.ndarray:
    base = pow(_BASE, -1, 1 << 64) if inverse else _BASE
    out = np.full(n, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


def words(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """hash, start and end of every word of lower-cased bytes. Long data is hashed in pieces that end between words."""
    out, at, raw = [], 0, np.frombuffer(data, np.uint8)
    while at < len(raw):
        end = min(len(raw), at + PIECE)
        while end < len(raw) and IN_WORD[raw[end - 1]]:  # not inside a word
            rest = np.flatnonzero(~IN_WORD[raw[end : end + PIECE]])
            end = end + int(rest[0]) + 1 if len(rest) else min(len(raw), end + PIECE)
        out.append(_words(raw[at:end], at))
        at = end
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*out))


def _words(raw: np.ndarray, offset: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    inside = np.zeros(len(raw) + 2, bool)
    inside[1:-1] = IN_WORD[raw]
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    size = 1 << max(12, int(len(raw) - 1).bit_length())
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * _powers(False, size)[: len(raw)], out=sums[1:])
    hashes = mix((sums[ends] - sums[starts]) * _powers(True, size)[starts])
    return hashes, starts + offset, ends + offset

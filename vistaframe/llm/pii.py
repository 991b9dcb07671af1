"""PII: format-preserving pseudonyms from a keyed Feistel permutation.

E-mail addresses, payment cards, bank accounts (IBAN), social security numbers, IPv4 addresses, phone numbers and dates
are found by pattern and validated (check digits, ranges, the calendar). Each valid value is numbered within the set of
values of its format, its number is permuted under a key, and the result is written in the same format: check digits
stay right, dates stay dates. The permutation depends on the key, the kind and the format alone, so equal values have
equal pseudonyms in every document, and whoever holds the key can undo it. It has no fixed points.

A phone number ends before a value that stands next to it: at its country's length where that is fixed, and else before
a value of another kind; a bare number behind a phone of no fixed length counts as its last digits.

What stays: an address's domain, a card's first digit and whether its check digit is right, a phone number's country
code, all separators. Unbroken runs of 13 to 19 digits and digits grouped 4-4-4-4, 4-6-5 or 4-6-4 are permuted as cards
even if their check digit is wrong; other groupings only if it is right. What is written must be read at the same place
again: a number whose own reading hangs on the digits beside it (groups with a wrong check digit, followed by one to three
digits; irregular groupings) may have another pseudonym there.

Defined results: a null text stays null with no finds; empty texts and tables stay as they are; texts without finds are
unchanged; repeated rows give repeated results; other columns are kept, and one named pii is replaced. Values may be of
any length.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, small_batches

KINDS = ("email", "iban", "ssn", "ip", "card", "phone", "date")
#: For tests and the registered query only: give `pseudonymised` a key of your own.
KEY = "vistaframe example key"
ROUNDS = 8
#: Characters of a value that are permuted as one number at most; a number's cost grows with the square of its length.
LONG = 256

# The patterns of each kind.
PATTERNS = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){2,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "ssn": r"(?<![A-Za-z0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![A-Za-z0-9-])",
    "ip": r"(?<![A-Za-z0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![A-Za-z0-9]|\.[0-9])",
    "card": r"(?<![A-Za-z0-9.+-])[0-9](?:[\x20-]?[0-9]){12,18}(?![A-Za-z0-9-])",
    "phone": r"(?<![A-Za-z0-9.+])(?:\+[0-9]{1,3}[\x20.-]?)?(?:\([0-9]{2,4}\)|[0-9]{2,4})(?:[\x20.-]?[0-9]{2,5}){1,4}(?![A-Za-z0-9-])",
    "date": r"(?<![A-Za-z0-9./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}/[0-9]{1,2}/[0-9]{4}|[0-9]{1,2}\.[0-9]{1,2}\.[0-9]{4})(?![A-Za-z0-9/-])",
}
# in an order in which a kind's pattern never takes a part of an earlier kind's value
FIND = re.compile("|".join(f"(?P<{k}>{PATTERNS[k]})" for k in ("email", "iban", "date", "ssn", "ip", "card", "phone")))
MAYBE = re.compile(r"[0-9]|@")
# what may stand inside a phone's match as a value of its own, and where a phone may end before it
SECOND = r"(?P<phone>(?<![A-Za-z0-9.+-])[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}(?![A-Za-z0-9-]))"
INNER, NO_CARD = (re.compile("|".join([*(f"(?P<{k}>{PATTERNS[k]})" for k in kinds), SECOND])) for kinds in (("date", "ssn", "ip", "card"), ("date", "ssn", "ip")))
PHONE = re.compile(PATTERNS["phone"])
BORDER = re.compile(r"(?![A-Za-z0-9-]|\.[0-9])")
NATIONAL = re.compile(r"\([0-9]{3}\)\x20?[0-9]{3}[\x20.-][0-9]{4}|[0-9]{3}[.-][0-9]{3}[.-][0-9]{4}")
# a card's digits: one run of 13 to 19, or groups with one separator; these are cards whatever their check digit is
GROUPED = re.compile(r"[0-9]{13,19}(?![0-9])|[0-9]{4}([\x20-])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}|[0-9]{6}\1[0-9]{4,5})(?![0-9])")
# and these if their check digit is right
LONGER = re.compile(r"[0-9]{4}([\x20-])(?:[0-9]{4}\1[0-9]{4}\1[0-9]{4}\1[0-9]{1,3}|[0-9]{4}\1[0-9]{4}\1[0-9]{1,3}|[0-9]{4}\1[0-9]{5}|[0-9]{5}\1[0-9]{6})(?![0-9])|[0-9]{6}([\x20-])(?:[0-9]{10}|[0-9]{13})(?![0-9])|[0-9]{8}[\x20-][0-9]{8}(?![0-9])")
RUN, BESIDE = re.compile(r"[0-9]+"), re.compile(r"[\x20-][0-9]")
#: Digits behind country codes whose numbers all have one length.
LENGTHS = {"1": 10, "7": 10, "31": 9, "33": 9, "34": 9, "41": 9, "45": 8, "47": 8, "48": 9, "52": 10, "61": 9, "91": 10}
#: Characters behind a value that its reading may depend on.
AHEAD = 120
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


def _round(key: bytes, tweak: bytes, i: int, half: int, bits: int) -> int:
    size = (bits + 7) // 8
    data, out = half.to_bytes(size, "big"), []
    for block in range(-(-size // 64)):
        head = tweak + bytes([i]) + block.to_bytes(4, "big")
        out.append(hashlib.blake2b(head + data, key=key, digest_size=min(64, size)).digest())
    return int.from_bytes(b"".join(out)[:size], "big") & ((1 << bits) - 1)


def feistel(value: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A permutation of range(size): a balanced Feistel network on the next even number of bits, walked into the range."""
    bits = max(1, ((size - 1).bit_length() + 1) // 2)
    mask = (1 << bits) - 1
    while True:
        left, right = value >> bits, value & mask
        if inverse:
            for i in reversed(range(ROUNDS)):
                left, right = right ^ _round(key, tweak, i, left, bits), left
        else:
            for i in range(ROUNDS):
                left, right = right, left ^ _round(key, tweak, i, right, bits)
        value = (left << bits) | right
        if value < size:
            return value


def permuted(value: int, size: int, key: bytes, tweak: bytes, step: int = 1) -> int:
    """One step along the key's single cycle through range(size): no value maps to itself. step -1 undoes it."""
    if size < 2:
        return value
    at = (feistel(value, size, key, tweak) + step) % size
    return feistel(at, size, key, tweak, inverse=True)


#: First character and size of the class of each ASCII letter and digit.
_LOW, _SIZE = np.arange(128, dtype=np.uint8), np.ones(128, np.int32)
for _first, _last in ("09", "az", "AZ"):
    _LOW[ord(_first) : ord(_last) + 1], _SIZE[ord(_first) : ord(_last) + 1] = ord(_first), ord(_last) - ord(_first) + 1


def _classes(text: str) -> list[str]:
    kinds = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
    return [next((k for k in kinds if c in k), c) for c in text]


def _characters(text: str, key: bytes, tweak: str, step: int) -> str:
    """text with its digits and letters permuted together, each within its class."""
    if len(text) > LONG:
        return _many_characters(text, key, tweak, step)
    classes = _classes(text)
    value, size = 0, 1
    for c, k in zip(text, classes):
        value, size = value * len(k) + k.index(c), size * len(k)
    shape = "".join(k[0] for k in classes)
    value = permuted(value, size, key, f"{tweak}:{shape}".encode(), step)
    out = []
    for k in reversed(classes):
        value, digit = divmod(value, len(k))
        out.append(k[digit])
    return "".join(reversed(out))


def _many_characters(text: str, key: bytes, tweak: str, step: int) -> str:
    """_characters for long texts of letters and digits, in time that grows with the length.

    The network's halves are the characters of the text's halves, and rounds add modulo each character's class.
    """
    raw = np.frombuffer(text.encode("ascii"), np.uint8)
    low, size = _LOW[raw], _SIZE[raw]
    start = hashlib.blake2b(low.tobytes(), key=key, digest_size=32, person=tweak.encode()[:16]).digest()
    half = len(raw) // 2
    places = (slice(0, half), slice(half, None))

    def walked(x: np.ndarray, sign: int) -> np.ndarray:
        x = x.copy()
        for i in range(ROUNDS) if sign > 0 else reversed(range(ROUNDS)):
            to, by = places[i % 2], places[1 - i % 2]
            more = hashlib.shake_256(start + bytes([i]) + x[by].astype(np.uint8).tobytes()).digest(2 * len(x[to]))
            x[to] = (x[to] + sign * (np.frombuffer(more, np.uint16) % size[to])) % size[to]
        return x

    at = walked((raw - low).astype(np.int32), 1)
    at[0] = (at[0] + step) % size[0]
    return (walked(at, -1) + low).astype(np.uint8).tobytes().decode("ascii")


def _refill(template: str, characters: str) -> str:
    it = iter(characters)
    return "".join(next(it) if c.isalnum() else c for c in template)


def luhn(digits: str) -> int:
    """The check digit that belongs behind digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def _number(text: str) -> int:
    return int("".join(str(int(c, 36)) for c in text))


def _email(v: str, key: bytes, step: int) -> str:
    local, _, domain = v.partition("@")
    plain = "".join(c for c in local if c.isalnum())
    return f"{_refill(local, _characters(plain, key, 'email', step))}@{domain}" if plain else v


def _card(v: str, key: bytes, step: int) -> str:
    d = "".join(c for c in v if c.isdigit())
    off = (int(d[-1]) - luhn(d[:-1])) % 10
    new = d[0] + _characters(d[1:-1], key, "card", step)
    return _refill(v, new + str((luhn(new) + off) % 10))


def _iban(v: str, key: bytes, step: int) -> str | None:
    plain = v.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = _characters(plain[4:], key, "iban", step)
    check = 98 - _number(body + plain[:2] + "00") % 97
    return _refill(v, f"{plain[:2]}{check:02d}{body}")


def _ssn(v: str, key: bytes, step: int) -> str | None:
    a, b, c = map(int, v.split("-"))
    if a in (0, 666) or a >= 900 or b == 0 or c == 0:
        return None
    n = ((a - 1 - (a > 666)) * 99 + b - 1) * 9999 + c - 1
    n = permuted(n, 898 * 99 * 9999, key, b"ssn", step)
    n, c = divmod(n, 9999)
    a, b = divmod(n, 99)
    return f"{a + 1 + (a + 1 >= 666):03d}-{b + 1:02d}-{c + 1:04d}"


def _ip(v: str, key: bytes, step: int) -> str | None:
    parts = v.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    n = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 2**32, key, b"ip", step)
    return ".".join(map(str, n.to_bytes(4, "big")))


def _form(v: str) -> int:
    """2 for a national number or one of its country's only length, 1 for other international ones, 0 for no phone."""
    d = "".join(c for c in v if c.isdigit())
    if v[0] != "+":
        return 2 if NATIONAL.fullmatch(v) else 0
    return 2 if any(LENGTHS.get(d[:n]) == len(d) - n for n in (1, 2)) else int(8 <= len(d) <= 15)


def _inner(text: str, start: int, end: int, kinds: re.Pattern = INNER) -> int:
    """Where the first valid value begins that stands inside a match but not at its start; end without one."""
    pos, last = start + 1, min(len(text), end + AHEAD)  # what begins before the end is over by then
    while (m := kinds.search(text, pos, last)) and m.start() < end:
        if m.lastgroup == "card":
            if span := _card_span(text, *m.span()):
                return min(span[0], end)
        elif m.lastgroup == "phone" or WRITERS[m.lastgroup](m[0], _key(""), 1) is not None:
            return m.start()
        pos = m.start() + 1
    return end


def _phone_end(text: str, start: int, end: int) -> int | None:
    """Where the phone ends that a match begins with: before a value of another kind or a second phone, if it can."""
    ends = [e for e in range(start + 8, end + 1) if e == end or (text[e - 1].isdigit() and BORDER.match(text, e))]
    forms = [(f, e) for e in ends if (f := _form(text[start:e]))]
    if not forms:
        return None
    most = _inner(text, start, end)
    return max([x for x in forms if x[1] <= most] or forms)[1]


def _phone(v: str, key: bytes, step: int) -> str | None:
    d = "".join(c for c in v if c.isdigit())
    if not _form(v):
        return None
    kept = 0 if v[0] != "+" else 1 if d[0] in "17" else 2
    return _refill(v, d[:kept] + _characters(d[kept:], key, f"phone{d[:kept]}", step))


def _date(v: str, key: bytes, step: int) -> str | None:
    mark = next(c for c in v if not c.isdigit())
    parts = v.split(mark)
    numbers = [int(p) for p in parts]
    day_first = mark == "." or numbers[0] > 12
    y, m, d = numbers if mark == "-" else (numbers[2], *(numbers[1::-1] if day_first else numbers[:2]))
    try:
        n = datetime.date(y, m, d).toordinal() - FIRST_DAY
    except ValueError:
        return None
    size = LAST_DAY - FIRST_DAY + 1
    if not 0 <= n < size:
        return None
    if mark == "-":
        return datetime.date.fromordinal(FIRST_DAY + permuted(n, size, key, b"date", step)).isoformat()
    # a text counts as day-first if its first number is no month: walk on until the new date reads the same way
    padded = len(parts[0]) == 2 and len(parts[1]) == 2
    while True:
        n = permuted(n, size, key, b"date", step)
        new = datetime.date.fromordinal(FIRST_DAY + n)
        if mark == "." or not day_first or new.day > 12:
            break
    first, second = (new.day, new.month) if day_first else (new.month, new.day)
    return f"{first:02d}{mark}{second:02d}{mark}{new.year}" if padded else f"{first}{mark}{second}{mark}{new.year}"


WRITERS = {"email": _email, "iban": _iban, "ssn": _ssn, "ip": _ip, "card": _card, "phone": _phone, "date": _date}


@cache
def _key(key: str) -> bytes:
    return hashlib.blake2b(key.encode(), digest_size=32).digest()


def _value(text: str, m: re.Match) -> tuple[str, int, int] | None:
    """(kind, start, end) of the value that a match stands for."""
    kind, start, end = m.lastgroup, *m.span()
    card = _card_span(text, start, end) if kind == "card" else None
    if card and card[0] == start:
        return "card", *card
    if kind in ("card", "phone"):  # what is no card, or stands before one, may be a phone
        p = m if kind == "phone" else PHONE.match(text, start)
        if p and (end := _phone_end(text, start, p.end())):
            return "phone", start, end
        return card and ("card", *card)
    return kind, start, end


def _right(v: str) -> bool:
    d = "".join(c for c in v if c.isdigit())
    return luhn(d[:-1]) == int(d[-1])


def _card_span(text: str, start: int, end: int) -> tuple[int, int] | None:
    """The card in a match: by its grouping and check digit, then by its grouping; else all of the match, if nothing
    else is in it, no group goes on beside it and its check digit is right."""
    found = []
    for run in RUN.finditer(text, start, end):
        for forms, longer in ((GROUPED, False), (LONGER, True)):
            m = forms.match(text, run.start())
            if m and not text[m.end() : m.end() + 1].isalnum():
                right = _right(m[0])
                # a wrong check digit: one run before groups, and no card that another group goes on behind a hyphen
                alone = text[m.end() : m.end() + 1] != "-" or m.end() < end
                if right or (not longer and alone):
                    found.append((not right, not right and not m[0].isdigit(), m.start(), longer, m.end()))
    if found:
        most = _inner(text, start, max(f[4] for f in found), NO_CARD)
        if found := [f for f in found if f[4] <= most]:
            best = min(found)
            return best[2], best[4]
    beside = BESIDE.match(text, end) or (start > 1 and text[start - 1] in " -" and text[start - 2].isdigit())
    return None if beside or not _right(text[start:end]) or _inner(text, start, end) < end else (start, end)


def _written(text: str, m: re.Match, kind: str, start: int, end: int, key: bytes, step: int) -> str | None:
    """The pseudonym of a value; walked on until it is read at the same place as the value, so that it can be undone."""
    new = WRITERS[kind](text[start:end], key, step)
    if new is None or kind not in ("phone", "card"):
        return new
    low = max(0, m.start() - 2)
    before, behind = text[low:start], text[end : end + AHEAD]

    def read(value: str) -> tuple[str, int, int] | None:
        near = before + value + behind
        found = FIND.match(near, m.start() - low)
        return found and _value(near, found)

    same = read(text[start:end])
    while read(new) != same:
        new = WRITERS[kind](new, key, step)
    return new


def replaced(text: str, key: str, step: int = 1) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each value in the given text."""
    if not MAYBE.search(text):
        return text, []
    out, found, at, pos = [], [], 0, 0
    while m := FIND.search(text, pos):
        value = _value(text, m)
        new = value and _written(text, m, *value, _key(key), step)
        if new is None:  # not valid: look on behind its first run of characters
            pos = m.start() + 1
            while pos < m.end() and text[pos].isalnum():
                pos += 1
            continue
        out += [text[at : value[1]], new]
        found.append(value)
        at = pos = value[2]
    return "".join([*out, text[at:]]), found


RESULT = "text string, pii array<struct<kind: string, start: int, `end`: int>>"


def pseudonymised(df: DataFrame, key: str, step: int = 1, found: str = "pii") -> DataFrame:
    """df with pseudonyms in its column text, and pii (or another name): kind, start and end of each value in the given text.

    step -1 under the same key brings the values back.
    """
    small_batches(df.sparkSession)

    @F.pandas_udf(RESULT)
    def replace(texts: pd.Series) -> pd.DataFrame:
        both = [(None, []) if t is None else replaced(t, key, step) for t in texts]
        places = [[{"kind": k, "start": a, "end": b} for k, a, b in f] for _, f in both]
        return pd.DataFrame({"text": [t for t, _ in both], "pii": places})

    names = [c for c in df.columns if c != found]
    out = df.select(*names).withColumn("__new", replace("text"))
    return out.select(*[F.col("__new.text").alias(c) if c == "text" else F.col(c) for c in names], F.col("__new.pii").alias(found))


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text with pseudonyms, the number of finds by kind, and their places, for every document."""
    out = pseudonymised(documents(spark, sf_dir).select("doc_id", "text"), KEY)
    kinds = F.transform("pii", lambda x: x["kind"])
    n = [(F.size(kinds) - F.size(F.array_remove(kinds, k))).cast("long").alias(f"n_{k}") for k in KINDS]
    places = F.array_join(F.transform("pii", lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "text", *n, places.alias("spans"))


QUERIES = {"op8_pii": op8_pii}
ORACLE_SQL: dict = {}

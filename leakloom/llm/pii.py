"""Format-preserving Feistel pseudonyms for personal data.

Numbers and dates are recognised, validated, and replaced by the keyed permutation of their value within the set of
values of the same format and validity. The permutation depends on key, kind and format only, so equal values stay
equal across documents and different ones stay different.
"""

from __future__ import annotations

import datetime as dt
import hashlib
import math
import re
import unicodedata
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import free_name, give_back, small_batches

ROUNDS = 8
#: Short values that a worker remembers.
REMEMBERED = 50_000
#: Characters of a string that are permuted together.
BLOCK = 32


def feistel(x: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size): alternating Feistel over two parts, walked until it is in range."""
    if size < 2:
        return x
    a = 1 << (size.bit_length() + 1) // 2
    b = -(-size // a)
    width = (a.bit_length() + 7) // 8 + 8
    head = tweak.encode() + b"|" + size.to_bytes(width * 2, "big")

    def f(r: int, half: int) -> int:
        data, out, n = head + bytes([r]) + half.to_bytes(width, "big"), b"", 0
        while len(out) < width:
            out += hashlib.blake2b(data + n.to_bytes(4, "big"), key=key, digest_size=32).digest()
            n += 1
        return int.from_bytes(out[:width], "big")

    while True:
        left, right = divmod(x, b)
        for r in range(0, ROUNDS, 2):
            left = (left + f(r, right)) % a
            right = (right + f(r + 1, left)) % b
        x = left * b + right
        if x < size:
            return x


def walk(x: int, size: int, key: bytes, tweak: str, valid: Callable[[int], bool]) -> int:
    """The permutation of the valid values only: walked until valid."""
    while True:
        x = feistel(x, size, key, tweak)
        if valid(x):
            return x


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _digits_like(form: str, digits: str) -> str:
    it = iter(digits)
    return "".join(next(it) if c.isascii() and c.isdigit() else c for c in form)


@lru_cache(1 << 16)
def class_of(c: str) -> str:
    """The characters that may stand for a letter or digit: those of its general category in the same 128 code points (so of
    its script and case); all other characters stand for themselves."""
    kind = unicodedata.category(c)
    if kind[0] not in "LN":
        return c
    first = ord(c) & ~127
    # a character that normalisation would change stands for itself, so that stored and normalised texts agree
    plain = lambda x: unicodedata.category(x) == kind and unicodedata.normalize("NFKC", x) == x
    return "".join(filter(plain, map(chr, range(first, first + 128)))) if plain(c) else c


def _permute_block(s: str, key: bytes, tweak: str) -> str:
    classes = [class_of(c) for c in s]
    x, size = 0, 1
    for c, own in zip(s, classes, strict=True):
        x, size = x * len(own) + own.index(c), size * len(own)
    # the shape: each character's class, by its first member
    y, out = feistel(x, size, key, tweak + "|" + "".join(own[0] for own in classes)), []
    for own in reversed(classes):
        y, d = divmod(y, len(own))
        out.append(own[d])
    return "".join(reversed(out))


def permute_string(s: str, key: bytes, tweak: str) -> str:
    """Each letter and digit within its class; up to BLOCK characters are one permutation of the strings of this shape.
    Longer strings go block by block, each under a tweak of all that stands before it, so the time is linear."""
    if len(s) <= BLOCK:
        return _permute_block(s, key, f"{tweak}|{len(s)}")
    before, out = hashlib.blake2b(key=key, digest_size=16), []
    for at in range(0, len(s), BLOCK):
        part = s[at : at + BLOCK]
        out.append(_permute_block(part, key, f"{tweak}|{len(s)}|{at}|{before.hexdigest()}"))
        before.update(part.encode("utf-8", "surrogatepass"))
    return "".join(out)


def walk_string(s: str, key: bytes, tweak: str, valid: Callable[[str], bool]) -> str:
    """The permutation of the valid strings of a shape only: walked until valid."""
    while True:
        s = permute_string(s, key, tweak)
        if valid(s):
            return s


def card(s: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", s)
    n, valid = len(digits), luhn(digits)
    if valid:  # the last digit follows from the others
        y = f"{feistel(int(digits[:-1]), 10 ** (n - 1), key, f'card{n}'):0{n - 1}d}"
        return _digits_like(s, next(y + c for c in "0123456789" if luhn(y + c)))
    return _digits_like(s, f"{walk(int(digits), 10**n, key, f'number{n}', lambda v: not luhn(f'{v:0{n}d}')):0{n}d}")


def phone(s: str, key: bytes) -> str:
    digits = re.sub(r"\D", "", s)
    head, own = digits[:-10], digits[-10:]
    # area and exchange begin with 2 to 9
    nanp = lambda v: (t := f"{v:010d}")[0] > "1" and t[3] > "1"
    ok = nanp(int(own))
    new = walk(int(own), 10**10, key, f"phone{ok}", lambda v: nanp(v) == ok)
    return _digits_like(s, head + f"{new:010d}")


def social(s: str, key: bytes) -> str:
    def valid(v: int) -> bool:
        t = f"{v:09d}"
        return t[:3] not in ("000", "666") and t[0] != "9" and t[3:5] != "00" and t[5:] != "0000"

    v = int(re.sub(r"\D", "", s))
    ok = valid(v)
    return _digits_like(s, f"{walk(v, 10**9, key, f'social{ok}', lambda x: valid(x) == ok):09d}")


def number(s: str, key: bytes) -> str:
    """Nine digits in a row are a social security number's, ten a phone's; eleven or twelve are permuted among all such."""
    if len(s) < 11:
        return social(s, key) if len(s) == 9 else phone(s, key)
    return f"{feistel(int(s), 10 ** len(s), key, f'digits{len(s)}'):0{len(s)}d}"


def _quad(s: str) -> list[int] | None:
    """The four numbers of an address as it is written; None for numbers over 255 or with zeros before them."""
    parts = [int(p) for p in s.split(".")]
    return parts if max(parts) < 256 and ".".join(map(str, parts)) == s else None


def address(s: str, key: bytes) -> str:
    """An address among public or other ones; what is none among such strings of the same lengths."""
    parts = _quad(s)
    if parts is None:
        return walk_string(s, key, "quad", lambda t: _quad(t) is None)
    v = int.from_bytes(bytes(parts), "big")
    public = lambda x: 0 < x >> 24 < 224 and x >> 24 not in (10, 127)
    ok = public(v)
    return ".".join(map(str, walk(v, 1 << 32, key, f"ip{ok}", lambda x: public(x) == ok).to_bytes(4, "big")))


def email(s: str, key: bytes) -> str:
    name, _, domain = s.rpartition("@")
    labels, _, top = domain.rpartition(".")
    return permute_string(f"{name}@{labels}", key, "email") + "." + top


def _account(flat: str) -> bool:
    """Whether check digits are those of the account; 00, 01 and 99 never are, though they leave the same rest as 97, 98 and 02."""
    return flat[2:4] not in ("00", "01", "99") and int("".join(str(int(c, 36)) for c in flat[4:] + flat[:4])) % 97 == 1


def iban(s: str, key: bytes) -> str:
    """The account within its country and shape, with check digits that fit; those that don't fit among such strings."""
    flat = s.replace(" ", "")
    if _account(flat):
        body = permute_string(flat[4:], key, "iban" + flat[:2])
        new = next(t for d in range(2, 99) if _account(t := f"{flat[:2]}{d:02d}{body}"))
    else:
        new = flat[:2] + walk_string(flat[2:], key, "account" + flat[:2], lambda t: not _account(flat[:2] + t))
    it = iter(new)
    return "".join(c if c == " " else next(it) for c in s)


_FIRST, _LAST = dt.date(1800, 1, 1).toordinal(), dt.date(2099, 12, 31).toordinal()


def _day(order: str, parts: list[int]) -> int | None:
    v = dict(zip(order, parts, strict=True))
    try:
        day = dt.date(v["Y"], v["M"], v["D"]).toordinal() - _FIRST
    except ValueError:
        return None
    return day if 0 <= day <= _LAST - _FIRST else None


def date(s: str, key: bytes) -> str:
    """Calendar dates of 1800 to 2099 in Y-M-D, D.M.Y, M/D/Y or D/M/Y; the parts keep order, separator and width.

    A date is permuted among the days that are written in its shape and are read in its order there (23/04/1967 only among those with a
    day over 12, as others would be read the other way round), so no two dates get one pseudonym. What no order reads
    as a date (30 February) is permuted among what is none, with as many digits in each part."""
    sep = re.search(r"\D", s)[0]
    parts = s.split(sep)
    orders = ("YMD",) if len(parts[0]) == 4 else ("MDY", "DMY") if sep == "/" else ("DMY", "MDY")
    for nth, order in enumerate(orders):
        day = _day(order, list(map(int, parts)))
        if day is not None:

            def written(day: int, order: str = order) -> list[int]:
                d = dt.date.fromordinal(day + _FIRST)
                return [{"Y": d.year, "M": d.month, "D": d.day}[k] for k in order]

            def fits(day: int, earlier: tuple[str, ...] = orders[:nth]) -> bool:
                values = written(day)
                return all(v < 10 ** len(p) for v, p in zip(values, parts, strict=True)) and all(_day(o, values) is None for o in earlier)

            new = written(walk(day, _LAST - _FIRST + 1, key, "date", fits))
            return sep.join(f"{v:0{len(p)}d}" for v, p in zip(new, parts, strict=True))
    sizes = [300 if len(p) == 4 else 10 ** len(p) for p in parts]

    def split(x: int) -> list[int]:
        out = []
        for size in reversed(sizes):
            x, v = divmod(x, size)
            out.append(v + 1800 * (size == 300))
        return out[::-1]

    x = 0
    for p, size in zip(parts, sizes, strict=True):
        x = x * size + int(p) - 1800 * (size == 300)
    new = split(walk(x, math.prod(sizes), key, f"no date{orders}{sizes}", lambda v: all(_day(o, split(v)) is None for o in orders)))
    return sep.join(f"{v:0{len(p)}d}" for v, p in zip(new, parts, strict=True))


KINDS: dict[str, Callable[[str, bytes], str]] = {"email": email, "iban": iban, "date": date, "social": social, "address": address, "phone": phone, "card": card, "number": number}
PATTERN = re.compile(
    r"(?P<email>(?<![\w.%+-])[\w.%+-]+@\w[\w-]*(?:\.\w[\w-]*)*\.(?:[^\W\d_]{2,}|xn--[\w-]+)(?![\w-]))"
    r"|(?P<iban>(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9]))"
    r"|(?P<date>(?<![0-9./-])(?:(?:1[89]|20)[0-9]{2}([-/.])[0-9]{1,2}\4[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\5(?:1[89]|20)[0-9]{2})(?![0-9]|[./-][0-9]))"
    r"|(?P<social>(?<![0-9-])[0-9]{3}([- ])[0-9]{2}\7[0-9]{4}(?![0-9-]))"
    r"|(?P<address>(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9]))"
    r"|(?P<phone>(?<![0-9A-Za-z])(?:\+[0-9]{1,3}[ .-]?)?\(?[0-9]{3}\)?[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9A-Za-z])\+[0-9]{11,13}(?![0-9]))"
    r"|(?P<card>(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z]))"
    r"|(?P<number>(?<![0-9A-Za-z])(?<![0-9][.,])[0-9]{9,12}(?![0-9A-Za-z]|[.,][0-9]))"
)
_HINT = re.compile(r"[0-9]{2}|[0-9][./-]|@")


def pseudonymise_text(text: str, key: bytes, forms: Callable[[str, str], str] | None = None) -> tuple[str, dict[str, int]]:
    """The text with pseudonyms, and how many values of each kind it had (one may be its own pseudonym)."""
    counts: dict[str, int] = {}
    if not _HINT.search(text):
        return text, counts

    def sub(m: re.Match) -> str:
        kind = m.lastgroup if m.lastgroup in KINDS else next(k for k in KINDS if m[k])
        new = forms(kind, m[0]) if forms else KINDS[kind](m[0], key)
        counts[kind] = counts.get(kind, 0) + 1
        return new

    return PATTERN.sub(sub, text), counts


def pseudonymise(documents: DataFrame, key: bytes, column: str = "text") -> DataFrame:
    """All columns of documents, the text with pseudonyms, and n_pii: how many values it had.

    A null text stays null with n_pii 0; whole texts are scanned; repeated rows stay. A column named n_pii is replaced.
    Values that look like a kind but don't validate (a date that is none, a number that fails its check digit) are permuted
    among those that fail in the same format. An address's letters stay within script and case, of any script; its top domain stays."""

    small_batches(documents.sparkSession)

    @F.pandas_udf("struct<text: string, n_pii: long>")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        known = lru_cache(REMEMBERED)(lambda kind, s: KINDS[kind](s, key))
        forms = lambda kind, s: known(kind, s) if len(s) <= 64 else KINDS[kind](s, key)
        for texts in batches:
            got: Iterable = [(None, {}) if t is None else pseudonymise_text(t, key, forms) for t in texts]
            yield pd.DataFrame([(t, sum(c.values())) for t, c in got], columns=["text", "n_pii"])
            give_back()

    others = [c for c in documents.columns if c not in (column, "n_pii")]
    p = free_name(documents, "__p")
    out = documents.select(*(F.col(f"`{c}`") for c in others), run(F.col(f"`{column}`").cast("string")).alias(p))
    kept = [F.col(f"{p}.text").alias(column) if c == column else F.col(f"`{c}`") for c in documents.columns if c != "n_pii"]
    return out.select(*kept, F.col(f"{p}.n_pii").alias("n_pii"))

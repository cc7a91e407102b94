"""Format-preserving Feistel pseudonyms for personal data."""

from __future__ import annotations

import calendar
import datetime
import functools
import hashlib
import re
import secrets
import unicodedata
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ROUNDS = 8
#: Session setting that holds the secret key as hexadecimal digits.
KEY_SETTING = "spark.mirrorseq.pseudonymKey"
_YEARS = range(1900, 2100)
_FIRST, _LAST = datetime.date(_YEARS[0], 1, 1).toordinal(), datetime.date(_YEARS[-1], 12, 31).toordinal()
# Country calling codes of one and two digits; others have three.
CALLING_CODES = frozenset("1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
_DIGITS, _LOWER, _UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def permute(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size).

    A balanced Feistel network over the least even number of bits that holds
    ``size``; values that leave the range walk on through the network until
    they return, which keeps it a permutation.
    """
    if size < 2:
        return value
    half = ((size - 1).bit_length() + 1) // 2
    low = (1 << half) - 1
    width = (half + 7) // 8
    while True:
        left, right = value >> half, value & low
        for i in range(ROUNDS):
            digest = b""
            for block in range(width // 64 + 1):
                digest += hashlib.blake2b(f"{tweak}:{size}:{i}:{block}:".encode() + right.to_bytes(width, "big"), key=key).digest()
            left, right = right, left ^ (int.from_bytes(digest[:width], "big") & low)
        value = left << half | right
        if value < size:
            return value


def characters(text: str, key: bytes, tweak: str, alphabets: tuple[str, ...] = (_DIGITS, _LOWER, _UPPER)) -> str:
    """Each character stays in its alphabet and the others stay as they are;
    the characters are permuted together, as one number in mixed radix."""
    radix = [next((a for a in alphabets if c in a), "") for c in text]
    size = value = 0
    size = 1
    for c, a in zip(text, radix, strict=True):
        if a:
            value, size = value * len(a) + a.index(c), size * len(a)
    value = permute(value, size, key, f"{tweak}:{''.join(a[:1] for a in radix)}")
    out = list(text)
    for i in range(len(text) - 1, -1, -1):
        if radix[i]:
            value, at = divmod(value, len(radix[i]))
            out[i] = radix[i][at]
    return "".join(out)


def luhn(digits: str) -> int:
    """Sum whose last digit is 0 for a valid number."""
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits)))


def _mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


def _dealt(shape: str, digits: str) -> str:
    """``shape`` with its digits and letters replaced by ``digits`` in order."""
    rest = iter(digits)
    return "".join(next(rest) if c.isalnum() else c for c in shape)


def _card(found: str, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", found)
    if not 13 <= len(digits) <= 19 or luhn(digits) % 10 or len(set(digits)) == 1:
        return None
    body = characters(digits[:-1], key, "card")
    return _dealt(found, body + str(-luhn(body + "0") % 10))


def _iban(found: str, key: bytes) -> str | None:
    plain = found.replace(" ", "")
    if not 15 <= len(plain) <= 34 or _mod97(plain) != 1:
        return None
    body = characters(plain[4:], key, "iban" + plain[:2])
    return _dealt(found, f"{plain[:2]}{98 - _mod97(plain[:2] + '00' + body):02}{body}")


def _ip(found: str, key: bytes) -> str | None:
    parts = [int(x) for x in found.split(".")]
    if max(parts) > 255:
        return None
    n = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, n.to_bytes(4, "big")))


def _ssn(found: str, key: bytes) -> str | None:
    a, b, c = map(int, found.split("-"))
    if a in (0, 666) or a >= 900 or not b or not c:
        return None
    areas = [x for x in range(1, 900) if x != 666]
    n = permute((areas.index(a) * 99 + b - 1) * 9999 + c - 1, len(areas) * 99 * 9999, key, "ssn")
    n, c = divmod(n, 9999)
    a, b = divmod(n, 99)
    return f"{areas[a]:03}-{b + 1:02}-{c + 1:04}"


def _pairs(leap: bool, widths: tuple[int, int], month_first: bool | None) -> list[tuple[int, int]]:
    """The two numbers before a year, in one way of writing a date.

    month_first: whether only that order of month and day is possible; None
    for numbers that may be read both ways.  A number of one digit is below 10.
    """
    days = [31, 29 if leap else 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31]
    if month_first is None:
        found = [(x, y) for x in range(1, 13) for y in range(1, 13)]
    else:
        found = [(m, d) if month_first else (d, m) for m in range(1, 13) for d in range(13, days[m - 1] + 1)]
    return [(x, y) for x, y in found if (widths[0] == 2 or x < 10) and (widths[1] == 2 or y < 10)]


@functools.cache
def _domain(widths: tuple[int, int], month_first: bool | None) -> tuple[list[tuple[int, int, int]], dict[tuple[int, int, int], int]]:
    """All dates of one way of writing, and the place of each."""
    dates = [(x, y, year) for year in _YEARS for x, y in _pairs(calendar.isleap(year), widths, month_first)]
    return dates, {d: i for i, d in enumerate(dates)}


def _date(found: str, key: bytes) -> str | None:
    """Dates stay in their way of writing: year first, day first, month first,
    or readable both ways, with their widths and separators; each is a domain
    of its own, so different dates never meet."""
    numbers = re.split(r"[-./]", found)
    if len(numbers[0]) == 4:
        try:
            day = datetime.date(*map(int, numbers)).toordinal()
        except ValueError:
            return None
        if not _FIRST <= day <= _LAST:
            return None
        new = datetime.date.fromordinal(_FIRST + permute(day - _FIRST, _LAST - _FIRST + 1, key, "date"))
        return f"{new.year:04}{found[4]}{new.month:02}{found[4]}{new.day:02}"
    x, y, year = map(int, numbers)
    widths = (len(numbers[0]), len(numbers[1]))
    month_first = None if max(x, y) <= 12 else y > 12
    dates, places = _domain(widths, month_first)
    if (x, y, year) not in places:
        return None
    x, y, year = dates[permute(places[x, y, year], len(dates), key, f"date:{widths}:{month_first}")]
    separator = found[len(numbers[0])]
    return f"{x:0{widths[0]}}{separator}{y:0{widths[1]}}{separator}{year:04}"


def _phone(found: str, key: bytes) -> str | None:
    """The country code stays and the rest is permuted as plain digits, so a
    number keeps its pseudonym however it is spaced; (ddd) ddd-dddd has code 1."""
    digits = re.sub(r"\D", "", found)
    code = ""
    if found.startswith("+"):
        code = next((digits[:n] for n in (1, 2) if digits[:n] in CALLING_CODES), digits[:3])
    rest = digits[len(code) :]
    if not 6 <= len(rest) <= 14:
        return None
    return _dealt(found, code + characters(rest, key, f"phone:{code or '1'}"))


def _email(found: str, key: bytes) -> str | None:
    local, _, domain = found.rpartition("@")
    return f"{characters(local, key, 'email')}@{domain}"


def _secret(found: str, key: bytes) -> str | None:
    name = re.match(r"(?i)[a-z_]+\s*[=:]\s*[\"']?", found)
    head = name[0] if name else found[:4]
    rest = found[len(head) :]
    hexadecimal = re.fullmatch(r"[0-9a-f]+", rest)
    base32 = re.fullmatch(r"[A-Z2-7]+", rest)
    return head + characters(rest, key, "secret", ("0123456789abcdef",) if hexadecimal else (_UPPER + "234567",) if base32 else (_DIGITS, _LOWER, _UPPER))


#: Kind, pattern, pseudonym.  A pattern only proposes; the function validates.
KINDS: list[tuple[str, str, Callable[[str, bytes], str | None]]] = [
    ("email", r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+", _email),
    ("secret", r"(?i:token|secret|password|passwd|pwd|api_?key)[ \t]*[=:][ \t]*[\"']?[A-Za-z0-9_+/-]{8,}|(?<![A-Za-z0-9])AKIA[A-Z2-7]{16}(?![A-Za-z0-9])", _secret),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", _ip),
    ("date", r"(?<![\d.-])(?:\d{4}-\d{2}-\d{2}|\d{1,2}([./-])\d{1,2}\1\d{4})(?![\d-])", _date),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", _ssn),
    ("phone", r"\+\d[\d ().-]{6,20}\d(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}-\d{4}(?!\d)", _phone),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])", _iban),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])", _card),
]
_FINDER = re.compile("|".join(f"(?P<{kind}>{pattern.replace(chr(92) + '1', '(?P=mark)').replace('([./-])', '(?P<mark>[./-])')})" for kind, pattern, _ in KINDS))
#: No kind does without one of these, and none spans lines.
_HINT = re.compile(r"[\d@=:]|AKIA")
#: Decimal digits of other scripts.
_OTHER = re.compile(r"[^\D0-9]")
_FUNCTIONS = {kind: function for kind, _, function in KINDS}


def _ascii(text: str) -> str:
    """Digits of all scripts as 0 to 9, each in its place."""
    return _OTHER.sub(lambda m: str(unicodedata.decimal(m[0])), text)


def _in_script(new: str, found: str) -> str:
    """``new`` with its digits in the scripts that ``found`` has at their places
    (the first one's beyond its end or where there is none)."""
    zeros = [ord(c) - unicodedata.decimal(c) if c.isdecimal() else None for c in found]
    first = next(z for z in zeros if z is not None)
    place = lambda i: zeros[i] if len(new) == len(found) and zeros[i] is not None else first
    return "".join(chr(place(i) + int(c)) if c in _DIGITS else c for i, c in enumerate(new))


def pseudonymise(text: str | None, key: bytes) -> tuple[str | None, int]:
    """The whole text with its personal data replaced, and how many were.

    Digits of any script count as digits: values are found and permuted in
    ASCII digits and written back in the script that they had, so a number
    keeps its pseudonym across scripts.
    """
    if not text or not _HINT.search(text):
        return text, 0
    count = 0

    def replace(m: re.Match) -> str:
        nonlocal count
        kind = m.lastgroup if m.lastgroup != "mark" else "date"
        new = _FUNCTIONS[kind](m[0], key)
        count += new is not None
        return m[0] if new is None else new

    def in_line(line: str) -> str:
        if not _HINT.search(line):
            return line
        if not _OTHER.search(line):
            return _FINDER.sub(replace, line)
        plain, out, at = _ascii(line), [], 0
        for m in _FINDER.finditer(plain):
            new, found = replace(m), line[m.start() : m.end()]
            out += [line[at : m.start()], found if new == m[0] else _in_script(new, found) if _OTHER.search(found) else new]
            at = m.end()
        return "".join([*out, line[at:]])

    lines = [in_line(x) for x in text.split("\n")]
    return "\n".join(lines), count


def session_key(spark: SparkSession) -> bytes:
    """The key of the session's setting.

    Where it is unset a random key is set for this session: its pseudonyms
    stay linked to each other, but can't be undone or linked to other runs.
    """
    if not spark.conf.get(KEY_SETTING, None):
        spark.conf.set(KEY_SETTING, secrets.token_hex(32))
    return bytes.fromhex(spark.conf.get(KEY_SETTING))


def protect(df: DataFrame, key: bytes, text: str = "text", count: str | None = None) -> DataFrame:
    """``df`` with pseudonyms in ``text``; ``count`` names a column for their number.

    Numbers and dates are validated (Luhn sum, mod 97, octets, calendar) and
    permuted under the key within their format: the pseudonym of a card number
    is a valid card number, that of a date a date, and separators stay.  E-mail
    addresses keep their domain, credentials their name.  A permutation depends
    on the key, the kind and the value alone, so equal values stay linked across
    documents and different ones stay different.  Whoever has the key can undo
    the permutation: it must be kept secret, and 16 to 64 bytes long.

    Not looked for: dates as 1999/12/31, telephone numbers without + or
    brackets (415-555-0123), IPv6 addresses.

    Defined results: null stays null and empty stays empty, with count 0;
    other columns, repeated rows and an empty table stay as they are.  No
    shuffle; each text is handled on its own.
    """

    if not 16 <= len(key) <= 64:
        raise ValueError("the key must have 16 to 64 bytes")

    @F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("n", T.LongType())]))
    def replaced(parts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in parts:
            yield pd.DataFrame([pseudonymise(t, key) for t in texts], columns=["text", "n"])

    out = df.withColumn("__done", replaced(F.col(text)))
    out = out.withColumn(text, F.col("__done.text"))
    return (out.withColumn(count, F.col("__done.n")) if count else out).drop("__done")

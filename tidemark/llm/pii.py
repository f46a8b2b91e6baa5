"""Personal data: validated numbers, dates, addresses and secrets become format-preserving pseudonyms.

Each kind of value is a mixed-radix number: the positions that may change, each with its alphabet.  A keyed Feistel
network permutes those numbers, and walks on along its cycle until the result is a valid value again.  So a value has
one pseudonym of the same form under a key, different values have different ones, and values stay linked across
documents without any table of them.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from bisect import bisect_left, insort
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from tidemark.llm.common import small_batches

DIGITS, HEX = "0123456789", "0123456789abcdef"
LOWER, UPPER = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ROUNDS = 8


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of range(size), by cycle walking over the next even number of bits."""
    half = max(1, (size - 1).bit_length() + 1 >> 1)
    mask, width = (1 << half) - 1, half + 7 >> 3
    while True:
        left, right = value >> half, value & mask
        for r in range(ROUNDS):
            said = hashlib.blake2b(r.to_bytes(1, "big") + tweak.encode() + b"\0" + right.to_bytes(width, "big"), key=key, digest_size=min(64, width + 8)).digest()
            more = b"".join(hashlib.blake2b(said + i.to_bytes(2, "big"), key=key).digest() for i in range(width // 64 + 1)) if width > 56 else said
            left, right = right, left ^ int.from_bytes(more, "big") & mask
        value = left << half | right
        if value < size:
            return value


#: Positions that are permuted as one number; a longer value is permuted by blocks.
BLOCK = 64


def permuted(text: str, alphabets: list[str], key: bytes, tweak: str, valid: Callable[[str], bool] = lambda t: True) -> str:
    """The pseudonym of text, a character for each alphabet, among the texts that are valid.

    Of a text longer than BLOCK each block is permuted by itself, its tweak being a hash of the blocks before it, so
    that the whole is a permutation still and the work is linear in the length.
    """
    if len(text) > BLOCK:
        out, said = [], hashlib.blake2b(f"{tweak}:{len(text)}".encode(), key=key)
        for at in range(0, len(text), BLOCK):
            part = text[at : at + BLOCK]
            out.append(permuted(part, alphabets[at : at + BLOCK], key, f"{tweak}:{said.hexdigest()}"))
            said.update(part.encode())
        return "".join(out)
    size = 1
    for a in alphabets:
        size *= len(a)
    value = 0
    for c, a in zip(text, alphabets, strict=True):
        value = value * len(a) + a.index(c)
    while True:
        value = feistel(value, size, key, f"{tweak}:{size}")
        rest, out = value, []
        for a in reversed(alphabets):
            rest, at = divmod(rest, len(a))
            out.append(a[at])
        if valid(found := "".join(reversed(out))):
            return found


def by_class(text: str) -> list[str]:
    return [DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else c for c in text]


def refill(form: str, digits: str) -> str:
    """form with its digits replaced in order."""
    left = iter(digits)
    return "".join(next(left) if c in DIGITS else c for c in form)


def luhn(digits: str) -> bool:
    odd = sum(int(c) for c in digits[-1::-2])
    return (odd + sum(sum(divmod(2 * int(c), 10)) for c in digits[-2::-2])) % 10 == 0


def _card(found: re.Match, key: bytes) -> str | None:
    digits = re.sub(r"\D", "", found[0])
    if not 13 <= len(digits) <= 19 or not luhn(digits) or len(set(digits)) == 1:
        return None
    body = permuted(digits[:-1], [DIGITS] * (len(digits) - 1), key, "card", lambda t: (t[0] == "0") == (digits[0] == "0"))
    return refill(found[0], body + next(c for c in DIGITS if luhn(body + c)))


def _iban(found: re.Match, key: bytes) -> str | None:
    text = found[0].replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t[4:] + t[:4]))
    if not 15 <= len(text) <= 34 or number(text) % 97 != 1:
        return None
    body = permuted(text[4:], by_class(text[4:]), key, "iban" + text[:2])
    new = iter(text[:2] + f"{98 - number(text[:2] + '00' + body) % 97:02d}" + body)
    return "".join(" " if c == " " else next(new) for c in found[0])


def _phone(found: re.Match, key: bytes) -> str | None:
    country, rest = re.match(r"(\+\d{1,3}(?=\D))?(.*)", found[0], re.S).groups()
    digits = re.sub(r"\D", "", rest)
    if not 7 <= len(digits) <= 14:
        return None
    return (country or "") + refill(rest, permuted(digits, [DIGITS] * len(digits), key, "phone", lambda t: (t[0] in "01") == (digits[0] in "01")))


def _social(found: re.Match, key: bytes) -> str | None:
    valid = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
    digits = found[0].replace("-", "")
    return refill(found[0], permuted(digits, [DIGITS] * 9, key, "social", valid)) if valid(digits) else None


def _address(found: re.Match, key: bytes) -> str | None:
    parts = [int(p) for p in found[0].split(".")]
    if max(parts) > 255:
        return None
    return ".".join(map(str, feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ipv4").to_bytes(4, "big")))


def _mail(found: re.Match, key: bytes) -> str:
    local, at, domain = found[0].rpartition("@")
    return permuted(local, by_class(local), key, "mail") + at + domain


def _secret(found: re.Match, key: bytes) -> str:
    before, value = found[1], found[2]
    alphabets = [HEX] * len(value) if all(c in HEX for c in value) else by_class(value)
    if before == "AKIA":
        alphabets = [UPPER + DIGITS] * len(value)
    after = found[0][len(before) + len(value) :]
    return before + permuted(value, alphabets, key, "secret") + after


_FIRST, _DAYS = datetime.date(1900, 1, 1), (datetime.date(2100, 1, 1) - datetime.date(1900, 1, 1)).days
_MONTHS = [m.lower() for m in calendar.month_name[1:]]


def _date(found: re.Match, key: bytes) -> str | None:
    """A valid date of 1900 to 2099 becomes another one, written alike."""
    g = found.groupdict()
    try:
        if g["iso"]:
            y, m, d = map(int, re.split(r"[-/.]", g["iso"]))
        elif g["dmy"]:
            d, m, y = map(int, re.split(r"[-/.]", g["dmy"]))
            if m > 12:
                d, m = m, d
        else:
            d, m, y = int(g["day"]), _MONTHS.index(g["month"].lower()) + 1, int(g["year"])
        number = (datetime.date(y, m, d) - _FIRST).days
    except ValueError:
        return None
    if not 0 <= number < _DAYS:
        return None
    new = _FIRST + datetime.timedelta(feistel(number, _DAYS, key, "date"))
    if g["iso"]:
        sign = g["iso"][4]
        return f"{new.year}{sign}{new.month:02d}{sign}{new.day:02d}"
    if g["dmy"]:
        sign = re.search(r"[-/.]", g["dmy"])[0]
        first, second = (new.month, new.day) if int(re.split(r"[-/.]", g["dmy"])[1]) > 12 else (new.day, new.month)
        return f"{first:02d}{sign}{second:02d}{sign}{new.year}"
    return f"{new.day} {calendar.month_name[new.month]} {new.year}"


def _pattern(text: str) -> re.Pattern:
    return re.compile(text.replace(r"\d", "[0-9]"))  # ASCII digits only


#: Characters of an IBAN by country, as registered.
IBAN_SIZES = {
    "AD": 24, "AE": 23, "AL": 28, "AT": 20, "AZ": 28, "BA": 20, "BE": 16, "BG": 22, "BH": 22, "BI": 27, "BR": 29, "BY": 28, "CH": 21,
    "CR": 22, "CY": 28, "CZ": 24, "DE": 22, "DJ": 27, "DK": 18, "DO": 28, "EE": 20, "EG": 29, "ES": 24, "FI": 18, "FK": 18, "FO": 18,
    "FR": 27, "GB": 22, "GE": 22, "GI": 23, "GL": 18, "GR": 27, "GT": 28, "HN": 28, "HR": 21, "HU": 28, "IE": 22, "IL": 23, "IQ": 23,
    "IS": 26, "IT": 27, "JO": 30, "KW": 30, "KZ": 20, "LB": 28, "LC": 32, "LI": 21, "LT": 20, "LU": 20, "LV": 21, "LY": 25, "MC": 27,
    "MD": 24, "ME": 22, "MK": 19, "MN": 20, "MR": 27, "MT": 31, "MU": 30, "NI": 28, "NL": 18, "NO": 15, "OM": 23, "PK": 24, "PL": 28,
    "PS": 29, "PT": 25, "QA": 29, "RO": 24, "RS": 22, "RU": 33, "SA": 24, "SC": 31, "SD": 18, "SE": 24, "SI": 19, "SK": 24, "SM": 27,
    "SO": 23, "ST": 25, "SV": 28, "TL": 23, "TN": 24, "TR": 26, "UA": 29, "VA": 22, "VG": 24, "XK": 20, "YE": 30,
}
#: A card number with others that stand beside it: twice the digits of the longest, so that each start sees its longest span.
_CARD = r"\d(?:[ -]?\d){12,37}(?![\w-]|\.\d)"

WORDS = ("password", "passwd", "token", "secret", "api_key", "apikey")
#: kind, pattern, pseudonym (None: not a valid value, left alone); an earlier kind takes a place before a later one.
KINDS: list[tuple[str, re.Pattern, Callable]] = [
    ("secret", _pattern(r"\b(AKIA)([A-Z0-9]{16})\b"), _secret),
    ("secret", _pattern(r"""((?i:\b(?:password|passwd|token|secret|api_?key)\s*[=:]\s*["']?))([A-Za-z0-9]{8,64})\b"""), _secret),
    ("mail", _pattern(r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?)+"), _mail),
    ("iban", _pattern(r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"), _iban),
    ("card", _pattern(r"(?<![\w.-])" + _CARD), _card),
    ("social", _pattern(r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"), _social),
    ("date", _pattern(r"(?<![\w./-])(?:(?P<iso>(?:19|20)\d\d([-/.])\d\d\2\d\d)|(?P<dmy>\d\d([-/.])\d\d\4(?:19|20)\d\d)|(?P<day>\d{1,2}) (?P<month>(?i:" + "|".join(_MONTHS) + r")) (?P<year>(?:19|20)\d\d))(?![\w/-]|\.\d)"), _date),
    ("address", _pattern(r"(?<![\w.])\d{1,3}(?:\.\d{1,3}){3}(?![\w]|\.\d)"), _address),
    ("phone", _pattern(r"(?<![\w+])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,3}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}-\d{3}-\d{4})(?![\w-])"), _phone),
]
_DIGIT = re.compile("[0-9]")
_GROUP, _SPAN, _NEXT_CARD = re.compile("[A-Z0-9]+"), re.compile(".+", re.S), _pattern(_CARD)


def _values(kind: str, pattern: re.Pattern, make: Callable, text: str, key: bytes, free: Callable[[int, int], bool]):
    """Place and pseudonym of the values of a kind.

    A run of groups may hold a card number or an IBAN and something beside it.  So spans from its first group on are
    tried: of an IBAN the length of the country, then the whole; of a card the longest first, and those that a hyphen
    follows last.  If none is valid, the search goes on after the first group.
    """
    found = pattern.search(text)
    while found:
        (a, b), value = found.span(), None
        if kind not in ("card", "iban"):
            if free(a, b) and (value := make(found, key)) is not None:
                yield a, b, value
            found = pattern.search(text, b)
            continue
        ends = [g.end() for g in _GROUP.finditer(text, a, b)]
        if kind == "iban":
            tried = [*(e for e in ends if e - a - text.count(" ", a, e) == IBAN_SIZES.get(text[a : a + 2])), b]
        else:
            tried = sorted(ends, key=lambda e: (text[e : e + 1] == "-", -e))
        for e in tried:
            if free(a, e) and (value := make(_SPAN.fullmatch(text, a, e), key)) is not None:
                yield a, e, value
                found = pattern.search(text, e)
                break
        else:
            after = kind == "card" and text[ends[0] : ends[0] + 1] == "-" and _NEXT_CARD.match(text, ends[0] + 1)
            found = after or pattern.search(text, ends[0])


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and of each value its kind and its place in the new text (code points)."""
    digit, low = _DIGIT.search(text), text.lower()
    worded = any(w in low for w in WORDS)
    if not (digit or worded or "@" in text):
        return text, []
    taken: list[tuple[int, int, str, str]] = []  # in order of their places, none over another

    def free(a: int, b: int) -> bool:
        i = bisect_left(taken, (b,))
        return not i or taken[i - 1][1] <= a

    for kind, pattern, make in KINDS:
        if "@" in text if kind == "mail" else digit or worded:
            for a, b, new in _values(kind, pattern, make, text, key, free):
                insort(taken, (a, b, kind, new))
    out, spans, at, size = [], [], 0, 0
    for a, b, kind, new in taken:
        out += [text[at:a], new]
        size += a - at
        spans.append((kind, size, len(new)))
        size, at = size + len(new), b
    return "".join([*out, text[at:]]), spans


SPANS = "struct<text:string,spans:array<struct<kind:string,start:int,length:int>>>"


def redacted(documents: DataFrame, key: str, text_col: str = "text", into: str = "pii") -> DataFrame:
    """documents with a struct column: the text with pseudonyms, and its spans.  A null text stays null."""
    secret = hashlib.blake2b(key.encode(), digest_size=32).digest()

    @pandas_udf(SPANS)
    def apply(text: pd.Series) -> pd.DataFrame:
        found = [(None, None) if t is None else pseudonymise(t, secret) for t in text]
        return pd.DataFrame({"text": [t for t, _ in found], "spans": [None if s is None else [{"kind": k, "start": a, "length": n} for k, a, n in s] for _, s in found]})

    return small_batches(documents).withColumn(into, apply(F.col(text_col)))


def pii(documents: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, text (with pseudonyms), n_found, spans (kind, start, length in the new text) of every document.

    Numbers count only if they are valid: card numbers by Luhn's rule, IBANs by their check digits, social security
    numbers by their ranges, IPv4 addresses by octets up to 255, dates by the calendar.  Very long texts and values count
    whole, in time linear in their length.  A null text counts as empty.  Rows are
    independent of each other: repeated rows give repeated results, and no state grows with the corpus.  An empty
    table gives an empty result.  Other columns are not read.
    """
    rows = documents.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return redacted(rows, key).select("doc_id", "pii.text", F.size("pii.spans").cast("bigint").alias("n_found"), "pii.spans")

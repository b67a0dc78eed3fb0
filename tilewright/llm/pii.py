"""Format-preserving pseudonyms for personal numbers, dates, addresses and secrets.

A value is recognised by pattern, validated (Luhn, numbering plan, calendar, mod 97,
octet range), mapped to an index within all values of its format, moved by a keyed
Feistel permutation of that index range, and written back in the same format.  Equal
values therefore get equal pseudonyms in every document, and the key's holder can
invert them.  Values that fail validation stay as they are.
"""

from __future__ import annotations

import calendar
import datetime
import hashlib
import re
from collections.abc import Callable, Iterator
from functools import lru_cache
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tilewright.llm.common import table

ROUNDS = 10
#: Setting of the session that holds the query's key.
KEY_SETTING = "spark.tilewright.pii.key"
#: Used where no key is given: results are reproducible, not secret.
DEFAULT_KEY = b"tilewright: replace this key"

_DAY_0 = datetime.date(1900, 1, 1).toordinal()
_DAYS = datetime.date(2100, 1, 1).toordinal() - _DAY_0

_DIGITS = "0123456789"
_LOWER = "abcdefghijklmnopqrstuvwxyz"
_UPPER = _LOWER.upper()

#: IBAN lengths by country.
IBAN_LENGTH = {"AT": 20, "BE": 16, "CH": 21, "DE": 22, "DK": 18, "ES": 24, "FI": 18, "FR": 27, "GB": 22, "IE": 22, "IT": 27, "LU": 20, "NL": 18, "NO": 15, "PL": 28, "PT": 25, "SE": 24}


def permute(index: int, size: int, key: bytes, tweak: bytes, inverse: bool = False) -> int:
    """A keyed permutation of range(size): balanced Feistel on pairs, walking cycles back into range."""
    side = isqrt(size - 1) + 1 if size > 1 else 1
    width = (side.bit_length() + 7) // 8

    def mask(step: int, half: int) -> int:
        seed = step.to_bytes(1, "big") + half.to_bytes(width, "big") + tweak
        return int.from_bytes(hashlib.blake2b(seed, key=key[:64], digest_size=min(64, width + 8)).digest(), "big")

    while True:
        left, right = divmod(index, side)
        if inverse:
            for step in reversed(range(ROUNDS)):
                left, right = (right - mask(step, left)) % side, left
        else:
            for step in range(ROUNDS):
                left, right = right, (left + mask(step, right)) % side
        index = left * side + right
        if index < size:
            return index


def _alphabet(c: str) -> str:
    for letters in (_DIGITS, _LOWER, _UPPER):
        if c in letters:
            return letters
    return ""


def shuffle_text(value: str, key: bytes, kind: str, inverse: bool = False, ok: Callable[[str], bool] = lambda s: True) -> str:
    """Permute a string within its format: digits, lower and upper letters keep their class, others their place."""
    places = [(i, letters) for i, c in enumerate(value) if (letters := _alphabet(c))]
    size = 1
    for _, letters in places:
        size *= len(letters)
    if size == 1:
        return value
    shape = "".join(x[0] for _, x in places)
    tweak = f"{kind}:{shape}".encode()
    out = list(value)
    while True:
        index = 0
        for i, letters in places:
            index = index * len(letters) + letters.index(out[i])
        index = permute(index, size, key, tweak, inverse)
        for i, letters in reversed(places):
            index, at = divmod(index, len(letters))
            out[i] = letters[at]
        if ok(found := "".join(out)):  # a valid value's cycle returns to valid values
            return found


def luhn_digit(payload: str) -> str:
    total = 0
    for k, c in enumerate(reversed(payload)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return str(-total % 10)


def _fill(layout: str, digits: str) -> str:
    """The layout with its digits replaced in order."""
    take = iter(digits)
    return "".join(next(take) if c.isdecimal() else c for c in layout)


def card(value: str, key: bytes, inverse: bool = False) -> str | None:
    digits = re.sub(r"\D", "", value)
    if not 13 <= len(digits) <= 19 or digits[0] not in "23456" or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    moved = shuffle_text(digits[:-1], key, "card", inverse, lambda s: s[0] in "23456")
    return _fill(value, moved + luhn_digit(moved))


def phone(value: str, key: bytes, inverse: bool = False) -> str | None:
    digits = re.sub(r"\D", "", value)
    country = digits[:-10]
    valid = lambda s: s[0] in "23456789" and s[3] in "23456789"
    if country not in ("", "1") or len(digits) < 10 or not valid(digits[-10:]):
        return None
    return _fill(value, country + shuffle_text(digits[-10:], key, "phone", inverse, valid))


def social(value: str, key: bytes, inverse: bool = False) -> str | None:
    valid = lambda s: s[:3] not in ("000", "666") and s[0] != "9" and s[3:5] != "00" and s[5:] != "0000"
    digits = re.sub(r"\D", "", value)
    return _fill(value, shuffle_text(digits, key, "social", inverse, valid)) if valid(digits) else None


def address(value: str, key: bytes, inverse: bool = False) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
        return None
    index = int.from_bytes(bytes(map(int, parts)), "big")
    return ".".join(map(str, permute(index, 1 << 32, key, b"address", inverse).to_bytes(4, "big")))


def date(value: str, key: bytes, inverse: bool = False) -> str | None:
    """Year first, or day first with dots, or month first with slashes; 1900 to 2099."""
    a, b, c = map(int, re.split(r"\D", value))
    year, month, day = (a, b, c) if value[4] in "-/" else (c, b, a) if "." in value else (c, a, b)
    if not (1900 <= year <= 2099 and 1 <= month <= 12 and 1 <= day <= calendar.monthrange(year, month)[1]):
        return None
    moved = permute(datetime.date(year, month, day).toordinal() - _DAY_0, _DAYS, key, b"date", inverse)
    d = datetime.date.fromordinal(moved + _DAY_0)
    if value[4] in "-/":
        return f"{d.year:04}{value[4]}{d.month:02}{value[7]}{d.day:02}"
    return f"{d.day:02}.{d.month:02}.{d.year:04}" if "." in value else f"{d.month:02}/{d.day:02}/{d.year:04}"


def iban(value: str, key: bytes, inverse: bool = False) -> str | None:
    plain = value.replace(" ", "")
    number = lambda s: int("".join(str(int(c, 36)) for c in s))
    if IBAN_LENGTH.get(plain[:2]) != len(plain) or number(plain[4:] + plain[:4]) % 97 != 1:
        return None
    body = shuffle_text(plain[4:], key, "iban" + plain[:2], inverse)
    moved = iter(f"{plain[:2]}{98 - number(body + plain[:2] + '00') % 97:02}{body}")
    return "".join(c if c == " " else next(moved) for c in value)


def email(value: str, key: bytes, inverse: bool = False) -> str | None:
    local, _, host = value.rpartition("@")
    return f"{shuffle_text(local, key, 'email', inverse)}@{host}"


def secret(value: str, key: bytes, inverse: bool = False) -> str | None:
    return shuffle_text(value, key, "secret", inverse)


#: Kind, pattern, rewriting of its group "v" (or of the whole match).  Where two are valid at a place, the first listed wins.
KINDS: tuple[tuple[str, str, Callable[..., str | None]], ...] = (
    ("email", r"(?<![\w.+%-])[A-Za-z0-9][\w.+%-]*@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])", email),
    ("key_id", r"\b(?:AKIA|ASIA)(?P<v_key>[A-Z0-9]{16})\b", secret),
    ("secret", r"\b(?:password|passwd|pwd|secret|token|api_key|apikey)\s*[=:]\s*[\"']?(?P<v_secret>[A-Za-z0-9_\-/+]{8,})", secret),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("date", r"(?<![\d.\-/])(?:\d{4}-\d{2}-\d{2}|\d{4}/\d{2}/\d{2}|\d{2}\.\d{2}\.\d{4}|\d{2}/\d{2}/\d{4})(?![\d\-/]|\.\d)", date),
    ("address", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", address),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])", card),
    ("social", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
    ("phone", r"(?<![\w.-])(?:\+?1[ .-]?)?(?:\([2-9]\d{2}\)|[2-9]\d{2})[ .-]?[2-9]\d{2}[ .-]?\d{4}(?![\w-])", phone),
)
_REWRITE = {name: f for name, _, f in KINDS}
_NUMBERS = [(n, re.compile(p)) for n, p, _ in KINDS if n not in ("email", "key_id", "secret")]
_HOST = re.compile(r"(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}(?![\w-])")
_LOCAL = frozenset(_DIGITS + _LOWER + _UPPER + "_.+%-")
_KEYS = re.compile("|".join(f"(?P<{n}>{p})" for n, p, _ in KINDS[1:3]), re.IGNORECASE)
_KEY_WORDS = ("akia", "asia", "passw", "pwd", "secret", "token", "api_key", "apikey")
_DIGIT = re.compile(r"\d")
_DIGIT_RUN = re.compile(r"\d+")


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Spans around each @: the longest run of local-part characters before it, starting alphanumeric."""
    at = text.find("@")
    while at >= 0:
        start = at
        while start and text[start - 1] in _LOCAL:
            start -= 1
        while start < at and not text[start].isalnum():
            start += 1
        host = _HOST.match(text, at + 1)
        if host and start < at:
            yield start, host.end()
        at = text.find("@", at + 1)


def _number_at(text: str, start: int) -> tuple[int, int, str] | None:
    """The first kind whose pattern matches here and whose value is valid; a card may end before a later separator."""
    for kind, pattern in _NUMBERS:
        if not (m := pattern.match(text, start)):
            continue
        ends = [m.end()]
        if kind == "card":
            ends += [start + k for k in range(len(m[0]) - 1, 12, -1) if m[0][k] in " -"]
        for end in ends:
            if _cached(kind, text[start:end], DEFAULT_KEY, False) is not None:
                return start, end, kind
    return None


def matches(text: str) -> list[tuple[int, int, str]]:
    """Disjoint spans (start, end, kind) in order."""
    found: list[tuple[int, int, str]] = []
    if "@" in text:
        found += [(*span, "email") for span in _emails(text)]
    low = text.lower()
    if any(word in low for word in _KEY_WORDS):
        for m in _KEYS.finditer(text):
            kind = "key_id" if m["v_key"] else "secret"
            if kind == "secret" or m[0].isupper():
                found.append((*m.span("v_key" if kind == "key_id" else "v_secret"), kind))
    at, past = 0, 0
    while digit := _DIGIT.search(text, at):
        # a number may begin with +, ( or two letters before its first digit
        for start in range(max(past, digit.start() - 2), digit.start() + 1):
            if span := _number_at(text, start):
                found.append(span)
                at = past = span[1]
                break
        else:
            at = _DIGIT_RUN.match(text, digit.start()).end()
    out: list[tuple[int, int, str]] = []
    for span in sorted(found):
        if not out or span[0] >= out[-1][1]:
            out.append(span)
    return out


@lru_cache(maxsize=1 << 14)
def _cached(kind: str, value: str, key: bytes, inverse: bool) -> str | None:
    return _REWRITE[kind](value, key, inverse=inverse)


def pseudonymise(text: str, key: bytes = DEFAULT_KEY, inverse: bool = False) -> tuple[str, list[str]]:
    """The rewritten text and the kinds found, in order."""
    parts, kinds, at = [], [], 0
    for start, end, kind in matches(text):
        moved = _cached(kind, text[start:end], key, inverse)
        if moved is not None:
            parts += [text[at:start], moved]
            at = end
            kinds.append(kind)
    return "".join([*parts, text[at:]]), kinds


def pseudonymise_documents(docs: DataFrame, key: bytes = DEFAULT_KEY) -> DataFrame:
    """One row per row: doc_id, text (rewritten; null stays null), n_found, kinds (distinct, sorted).

    One pass without a shuffle.  Equal values get equal pseudonyms in all rows, and repeated
    rows equal results; an empty text stays empty and an empty table gives no rows.  Very
    long texts are handled whole; other columns, clashing names included, are dropped.
    """
    kind_of = dict(docs.dtypes)["doc_id"]

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, counts, kinds = [], [], []
            for text in batch.column(1).to_pylist():
                moved, found = (None, []) if text is None else pseudonymise(text, key)
                texts.append(moved)
                counts.append(len(found))
                kinds.append(sorted(set(found)))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(texts, pa.string()), pa.array(counts, pa.int32()), pa.array(kinds, pa.list_(pa.string()))],
                ["doc_id", "text", "n_found", "kinds"],
            )

    rows = docs.select("doc_id", F.col("text").cast("string"))
    return rows.mapInArrow(rewrite, f"doc_id {kind_of}, text string, n_found int, kinds array<string>")


def op1_feistel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document under the session's key (KEY_SETTING); without that setting, as in tests, under the default key."""
    key = spark.conf.get(KEY_SETTING, None)
    return pseudonymise_documents(table(spark, sf_dir, "documents"), key.encode() if key else DEFAULT_KEY)

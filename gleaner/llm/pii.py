"""PII: format-preserving pseudonyms from a keyed Feistel network.

A value is read as a number within its format (all card numbers of 16 digits, all days of two centuries, …) and
permuted there: a card number becomes another one whose check digit is right, a date another date written the same
way. The permutation depends on the key and the kind of value alone, so equal values stay equal in every document,
however a date or a telephone number is set, and whoever holds the key can undo it.
"""

from __future__ import annotations

import hashlib
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from datetime import date, timedelta
from math import isqrt

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 10
FIRST_DAY, LAST_DAY = date(1900, 1, 1), date(2099, 12, 31)
_LOWER, _UPPER, _DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"


def _round(key: bytes, kind: str, n: int, size: int, value: int) -> int:
    data = f"{kind}|{n}|{size}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=hashlib.sha256(key).digest(), digest_size=32).digest(), "big")


def permute(value: int, size: int, key: bytes, kind: str, back: bool = False) -> int:
    """A keyed permutation of 0 … size - 1: a Feistel network over two halves, walked until it is in range again."""
    if size < 2:
        return value
    a = isqrt(size - 1) + 1
    b = -(-size // a)
    while True:
        left, right = divmod(value, b)
        for n in reversed(range(ROUNDS)) if back else range(ROUNDS):
            if n % 2:
                step = _round(key, kind, n, size, left)
                right = (right - step if back else right + step) % b
            else:
                step = _round(key, kind, n, size, right)
                left = (left - step if back else left + step) % a
        value = left * b + right
        if value < size:
            return value


def _alphabets(text: str) -> list[str | None]:
    return [next((a for a in (_DIGITS, _LOWER, _UPPER) if c in a), None) for c in text]


def letters_and_digits(text: str, key: bytes, kind: str, back: bool = False, valid: Callable[[str], bool] = lambda _: True) -> str:
    """Every ASCII letter and digit permuted among its own class, the rest kept; walked on until `valid`."""
    classes = _alphabets(text)
    form = "".join("9" if a is _DIGITS else "a" if a is _LOWER else "A" if a is _UPPER else c for a, c in zip(classes, text, strict=True))
    size = 1
    for a in classes:
        size *= len(a) if a else 1
    while True:
        value = 0
        for a, c in zip(classes, text, strict=True):
            if a:
                value = value * len(a) + a.index(c)
        value = permute(value, size, key, f"{kind}|{form}", back)
        out = []
        for a, c in zip(reversed(classes), reversed(text), strict=True):
            if a:
                value, at = divmod(value, len(a))
                c = a[at]
            out.append(c)
        text = "".join(reversed(out))
        if valid(text):
            return text


def _luhn(digits: str) -> int:
    """The check digit that goes after `digits`."""
    total = sum(sum(divmod(2 * int(d), 10)) if k % 2 == 0 else int(d) for k, d in enumerate(reversed(digits)))
    return -total % 10


def _in_place(text: str, digits: str) -> str:
    """`text` with its digits replaced by `digits`, one by one."""
    new = iter(digits)
    return "".join(next(new) if c in _DIGITS else c for c in text)


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _DIGITS)


def card(text: str, key: bytes, back: bool = False) -> str | None:
    d = _digits(text)
    if _luhn(d[:-1]) != int(d[-1]) or len(set(d)) == 1:
        return None
    body = letters_and_digits(d[:-1], key, "card", back, lambda t: len(set(t + str(_luhn(t)))) > 1)
    return _in_place(text, body + str(_luhn(body)))


def _iban_check(country: str, account: str) -> str:
    number = int("".join(str(int(c, 36)) for c in account + country + "00"))
    return f"{98 - number % 97:02d}"


def iban(text: str, key: bytes, back: bool = False) -> str | None:
    plain = text.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(account) <= 30 or _iban_check(country, account) != check:
        return None
    account = letters_and_digits(account, key, f"iban|{country}", back)
    new = iter(country + _iban_check(country, account) + account)
    return "".join(c if c == " " else next(new) for c in text)


def _ssn_valid(text: str) -> bool:
    area, group, serial = text.split("-")
    return area not in ("000", "666") and area[0] != "9" and group != "00" and serial != "0000"


def ssn(text: str, key: bytes, back: bool = False) -> str | None:
    return letters_and_digits(text, key, "ssn", back, _ssn_valid) if _ssn_valid(text) else None


# The country numbers of one and of two digits; all others have three.
SHORT_COUNTRIES = frozenset(
    "1 7 20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
    "81 82 84 86 90 91 92 93 94 95 98".split()
)


def _country(digits: str) -> str:
    """The country number that `digits` begin with; none is the beginning of another."""
    return next((digits[:n] for n in (1, 2) if digits[:n] in SHORT_COUNTRIES), digits[:3])


def phone(text: str, key: bytes, back: bool = False) -> str | None:
    """The country's number is kept; the rest is permuted as digits, however they are set. A number without a country
    is one of country 1. The first digit there stays among 0 and 1 or among the others, so both forms read alike."""
    d = _digits(text)
    head = _country(d) if text[0] == "+" else ""
    d = d[len(head):]
    if not 7 <= len(d) <= 14 or (not head and d[0] in "01"):
        return None
    country, trunk = head or "1", d[0] in "01"
    new = letters_and_digits(d, key, f"phone|{country}", back, lambda t: country != "1" or (t[0] in "01") == trunk)
    return _in_place(text, head + new)


def ip(text: str, key: bytes, back: bool = False) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255 or any(len(p) > 1 and p[0] == "0" for p in text.split(".")):
        return None
    value = permute(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, value.to_bytes(4, "big")))


def _calendar() -> dict[bool, list[date]]:
    """All days in order, those that may be read as a month apart from the later ones of each month."""
    days = [FIRST_DAY + timedelta(n) for n in range((LAST_DAY - FIRST_DAY).days + 1)]
    return {late: [t for t in days if (t.day > 12) == late] for late in (False, True)}


_CALENDAR = _calendar()


def day(text: str, key: bytes, back: bool = False) -> str | None:
    """Year first or last; between slashes the month comes before the day where both readings can be.

    Days up to the 12th become such days and later ones later ones, so a pseudonym is read in the order in which the
    date was, and a day has one pseudonym in all forms.
    """
    sep = next(c for c in text if c not in _DIGITS)
    parts = text.split(sep)
    orders = ((0, 1, 2),) if len(parts[0]) == 4 else ((2, 0, 1), (2, 1, 0)) if sep == "/" else ((2, 1, 0),)
    for y, m, d in orders:
        try:
            found = date(int(parts[y]), int(parts[m]), int(parts[d]))
        except ValueError:
            continue
        if FIRST_DAY <= found <= LAST_DAY:
            late = found.day > 12
            days = _CALENDAR[late]
            new = days[permute(bisect_left(days, found), len(days), key, f"date|{late}", back)]
            put = {y: f"{new.year:04d}", m: f"{new.month:02d}", d: f"{new.day:02d}"}
            return sep.join(put[k] for k in range(3))
    return None


def email(text: str, key: bytes, back: bool = False) -> str | None:
    """Letters and digits before the @ and of the host's first part; the domain itself is kept."""
    name, _, host = text.rpartition("@")
    own, dot, domain = host.partition(".")
    deep = "." in domain
    new = letters_and_digits(f"{name}@{own}" if deep else name, key, "email|" + (domain if deep else host).lower(), back)
    return new + dot + domain if deep else f"{new}@{host}"


def secret(text: str, key: bytes, back: bool = False) -> str | None:
    return letters_and_digits(text, key, "secret", back)


# The forms in which personal data and secrets are written.
FORMS: tuple[tuple[str, str, Callable[..., str | None]], ...] = (
    ("email", r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]++@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+(?<!-)", email),
    ("aws_key", r"(?<=\bAKIA)[A-Z0-9]{16}\b", secret),
    ("secret", r"(?i:(?<=\bpassword=)|(?<=\bpasswd=)|(?<=\bsecret=)|(?<=\btoken=)|(?<=\bapi_key=)|(?<=\bapikey=))[A-Za-z0-9_+/-]{6,}", secret),
    ("quoted_secret", r"(?i:(?<=\btoken = \")|(?<=\bsecret = \")|(?<=\bpassword = \")|(?<=\bapi_key = \"))[A-Za-z0-9_+/-]{8,}(?=\")", secret),
    ("iban", r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b", iban),
    ("date", r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}/\d{2}/\d{4}|\d{2}\.\d{2}\.\d{4}|\d{2}-\d{2}-\d{4})(?![\d/-]|\.\d)", day),
    ("ssn", r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", ssn),
    ("card", r"(?<![\d-])\d(?:[ -]?\d){12,18}(?![\d-])", card),
    ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\d|\.\d)", ip),
    ("phone", r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)"
              r"|(?<![\w.-])(?:\(\d{3}\) ?|\d{3}[-.])\d{3}[-.]\d{4}(?![\d-])", phone),
)
_ANY = re.compile("|".join(f"(?P<{name}>{form})" for name, form, _ in FORMS), re.ASCII)
_PSEUDONYM = {name: make for name, _, make in FORMS}
#: What a text with any of the forms holds at least; other texts do not travel to Python.
_HINT = r"[0-9@]|AKIA|(?i:password|passwd|secret|token|api_?key)"


#: What may end a value within a match that ran on into the text behind it.
_RUNS_ON = {"iban": " ", "card": " -", "phone": " .-"}
_ALONE = {name: re.compile(form, re.ASCII) for name, form, _ in FORMS}
_ORDER = [name for name, _, _ in FORMS]


_TWICE = [sum(divmod(2 * d, 10)) for d in range(10)]


def _card_ends(text: str, start: int, end: int) -> list[int]:
    """Ends of the numbers of 13 digits or more from `start` on whose check digit is right, longest first. Both check
    sums (this digit doubled or not) are carried along, so a run is read once."""
    ends, n, as_last, as_next = [], 0, 0, 0
    for k in range(start, end):
        if text[k] in _DIGITS:
            c = int(text[k])
            n, as_last, as_next = n + 1, as_next + c, as_last + _TWICE[c]
            if n > 12 and as_last % 10 == 0 and (k + 1 == end or text[k + 1] in _RUNS_ON["card"]):
                ends.append(k + 1)
    return ends[::-1]


def _ends(kind: str, form: re.Pattern, text: str, start: int, end: int) -> list[int]:
    """Where a value that begins at `start` may end, longest first."""
    if kind == "card":
        return _card_ends(text, start, end)
    marks = _RUNS_ON.get(kind, "")
    return [end, *(k for k in range(end - 1, start, -1) if text[k] in marks and form.fullmatch(text, start, k))]


def _valid(m: re.Match, key: bytes, back: bool) -> tuple[str, int, str | None]:
    """Kind, end and pseudonym of the valid value that begins where `m` does.

    A match that fails its check is shortened to the separators in it, longest first; then the later kinds are tried.
    """
    text, start = m.string, m.start()
    for kind in _ORDER[_ORDER.index(m.lastgroup):]:
        form, make = _ALONE[kind], _PSEUDONYM[kind]
        if not (found := form.match(text, start)):
            continue
        for end in _ends(kind, form, text, start, found.end()):
            new = make(text[start:end], key, back)
            if new is not None:
                return kind, end, new
    return m.lastgroup, m.end(), None


def pseudonymise(text: str, key: bytes, back: bool = False) -> tuple[str, list[tuple[str, int, int, str]]]:
    """The text with every valid value replaced, and the places: (kind, start, end in the text, new value)."""
    found: list[tuple[str, int, int, str]] = []
    out, done, at = [], 0, 0
    while m := _ANY.search(text, at):
        kind, end, new = _valid(m, key, back)
        if new is None:
            at = m.start() + 1
            continue
        found.append((kind, m.start(), end, new))
        out += [text[done:m.start()], new]
        done = at = end
    return "".join(out) + text[done:], found


def redact(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """`docs` with personal data in `text` replaced by pseudonyms, and pii: an array of (kind, start, end, value),
    code points of the old text and the new value. `key` is the caller's secret: whoever has it can undo them.

    Whole texts are read. A null text stays null with no places; values that fail their check (Luhn, mod 97, the
    calendar) are no personal data and stay. A column named pii is replaced; rows are judged one by one.
    """
    docs = docs.drop("pii") if text != "pii" else docs
    pii = "array<struct<kind:string,start:int,end:int,value:string>>"

    def work(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        place = pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("value", pa.string())])
        for column in columns:
            out, places = [], []
            for t in column.to_pylist():
                new, found = (None, []) if t is None else pseudonymise(t, key)
                out.append(new)
                places.append([dict(zip(("kind", "start", "end", "value"), f, strict=True)) for f in found])
            yield pa.StructArray.from_arrays([pa.array(out, pa.string()), pa.array(places, pa.list_(place))], names=["text", "pii"])

    replaced = F.arrow_udf(work, f"struct<text:string,pii:{pii}>")
    hinted = F.coalesce(F.col(text).rlike(_HINT), F.lit(False))
    rows = docs.withColumn("_new", replaced(F.when(hinted, F.col(text))))
    return rows.select(
        *[F.when(hinted, F.col("_new.text")).otherwise(F.col(text)).alias(c) if c == text else F.col(f"`{c}`") for c in docs.columns],
        F.coalesce("_new.pii", F.lit([]).cast(pii)).alias("pii"),
    )


"""Format-preserving pseudonyms for personal values, by a keyed Feistel permutation.

A value is found by its pattern and checked (Luhn, calendar, number plan, ...). Its
characters are numbers in mixed radix, one digit per position; the Feistel rounds
permute all strings of that form, so the result has the form of the value, and equal
values have equal pseudonyms in all documents. Results that fail the check are permuted
again, which stays a permutation of the values that pass.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from railweave.llm.common import scan

ROUNDS = 10
DIGITS, SMALL, LARGE = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY, DAYS = date(1900, 1, 1), 73_049  # up to 2099-12-31


def feistel(value: int, left: int, right: int, key: bytes, tweak: str) -> int:
    """Permute 0 .. left * right - 1 under a key."""
    a, b = divmod(value, right)
    for k in range(ROUNDS):
        part = (b, left) if k % 2 == 0 else (a, right)
        drawn = int.from_bytes(hashlib.blake2b(f"{tweak}|{left}|{right}|{k}|{part[0]}".encode(), key=key, digest_size=32).digest()) % part[1]
        if k % 2 == 0:
            a = (a + drawn) % left
        else:
            b = (b + drawn) % right
    return a * right + b


def permute(symbols: list[int], radices: list[int], key: bytes, tweak: str, valid: Callable[[list[int]], bool] | None = None) -> list[int]:
    """Permute the strings over these radices, among the valid ones."""
    half = (len(radices) + 1) // 2
    left, right, value = 1, 1, 0
    for k, radix in enumerate(radices):
        left, right = (left * radix, right) if k < half else (left, right * radix)
        value = value * radix + symbols[k]
    while True:
        value = feistel(value, left, right, key, tweak)
        out, rest = [], value
        for radix in reversed(radices):
            rest, symbol = divmod(rest, radix)
            out.append(symbol)
        out.reverse()
        if valid is None or valid(out):
            return out


def luhn_digit(payload: list[int]) -> int:
    total = sum(d if k % 2 else (2 * d - 9 if d > 4 else 2 * d) for k, d in enumerate(reversed(payload)))
    return -total % 10


def _in_place(text: str, chars: list[str], where: Callable[[str], bool]) -> str:
    """The text with the characters that ``where`` picks replaced in order."""
    new = iter(chars)
    return "".join(next(new) if where(c) else c for c in text)


def _digits(text: str) -> list[int]:
    return [int(c) for c in text if c in DIGITS]


def card(text: str, key: bytes) -> str | None:
    """12 to 19 digits with a Luhn check digit; the first digit stays."""
    d = _digits(text)
    if luhn_digit(d[:-1]) != d[-1] or len(set(d)) == 1:
        return None
    body = [d[0], *permute(d[1:-1], [10] * (len(d) - 2), key, f"card{d[0]}")]
    return _in_place(text, [str(x) for x in [*body, luhn_digit(body)]], DIGITS.__contains__)


def phone(text: str, key: bytes) -> str | None:
    """Ten digits of the North American plan; a leading 1 and all marks stay."""
    d = _digits(text)
    lead, d = d[:-10], d[-10:]

    def valid(x: list[int]) -> bool:
        return x[0] > 1 and x[3] > 1

    if not valid(d):
        return None
    return _in_place(text, [str(x) for x in [*lead, *permute(d, [10] * 10, key, "phone", valid)]], DIGITS.__contains__)


def social(text: str, key: bytes) -> str | None:
    """Nine digits, three, two and four, of an area, group and serial that are given out."""
    def valid(x: list[int]) -> bool:
        area = x[0] * 100 + x[1] * 10 + x[2]
        return 0 < area < 900 and area != 666 and any(x[3:5]) and any(x[5:])

    d = _digits(text)
    return _in_place(text, [str(x) for x in permute(d, [10] * 9, key, "social", valid)], DIGITS.__contains__) if valid(d) else None


def address(text: str, key: bytes) -> str | None:
    """Four numbers below 256, the first from 1 to 223."""
    octets = [int(x) for x in text.split(".")]

    def valid(x: list[int]) -> bool:
        return 0 < x[0] < 224

    if not valid(octets) or max(octets) > 255:
        return None
    return ".".join(map(str, permute(octets, [256] * 4, key, "address", valid)))


def day(text: str, key: bytes) -> str | None:
    """A date of the calendar, year first or last; day before month, unless only the other order is a date."""
    a, mark, b, _, c = re.split(r"([-/.])", text)
    orders = (("%Y", "%m", "%d"),) if len(a) == 4 else (("%d", "%m", "%Y"), ("%m", "%d", "%Y"))
    for order in orders:
        part = dict(zip(order, (int(a), int(b), int(c)), strict=True))
        try:
            number = (date(part["%Y"], part["%m"], part["%d"]) - FIRST_DAY).days
        except ValueError:
            continue
        if not 0 <= number < DAYS:
            return None
        # 271 * 270 is the least such product above DAYS
        new = FIRST_DAY + timedelta(days=_walk(number, key))
        full = {"%Y": f"{new.year:04d}", "%m": f"{new.month:02d}", "%d": f"{new.day:02d}"}
        return mark.join(full[x] for x in order)
    return None


def _walk(number: int, key: bytes) -> int:
    while True:
        number = feistel(number, 271, 270, key, "day")
        if number < DAYS:
            return number


def _alphabet(c: str) -> str | None:
    return next((x for x in (DIGITS, SMALL, LARGE) if c in x), None)


def spelled(text: str, key: bytes, tweak: str) -> str:
    """Digits, small and large letters change within their kind; other characters stay."""
    kinds = [(c, a) for c in text if (a := _alphabet(c))]
    if not kinds:
        return text
    out = permute([a.index(c) for c, a in kinds], [len(a) for _, a in kinds], key, tweak)
    return _in_place(text, [a[x] for x, (_, a) in zip(out, kinds, strict=True)], lambda c: _alphabet(c) is not None)


def account(text: str, key: bytes) -> str | None:
    """An international account number with check digits modulo 97; the country stays."""
    plain = re.sub(r"\s", "", text)

    def check(country: str, body: str) -> int:
        return 98 - int("".join(str(int(c, 36)) for c in f"{body}{country}00")) % 97

    if check(plain[:2], plain[4:]) != int(plain[2:4]):
        return None
    body = spelled(plain[4:], key, f"account{plain[:2]}")
    return _in_place(text, list(f"{plain[:2]}{check(plain[:2], body):02d}{body}"), lambda c: not c.isspace())


def mail(text: str, key: bytes) -> str | None:
    """The part before the @ changes, the domain stays."""
    name, domain = text.rsplit("@", 1)
    return f"{spelled(name.lower(), key, f'mail{domain.lower()}')}@{domain}"


def token(text: str, key: bytes) -> str | None:
    """Access keys, and hexadecimal secrets and passwords; a hexadecimal one stays so."""
    if text.startswith("AKIA"):
        return f"AKIA{spelled(text[4:], key, 'token')}"
    digits = "0123456789abcdef"
    return "".join(digits[x] for x in permute([digits.index(c) for c in text.lower()], [16] * len(text), key, "hex"))


#: Usual groups of card numbers; a single group of 13 to 19 digits is usual too.
FORMS = ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 6, 5), (4, 6, 4))
#: Length of the account numbers of each country.
LENGTHS = {x[:2]: int(x[2:]) for x in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28 IE22 IL23 IQ23 IS26 IT27 "
    "JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24 SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20").split()}


def card_spans(text: str, m: re.Match) -> list[tuple[int, int]]:
    """Where in a run of digits a card may be, whole groups only: usual forms first, then the whole run, then other parts."""
    groups = [x.span() for x in re.compile(r"\d+").finditer(text, *m.span())]
    usual, other = [], []
    for i in range(len(groups)):
        n = 0
        for j in range(i, len(groups)):
            n += groups[j][1] - groups[j][0]
            if n > 19:
                break
            span = groups[i][0], groups[j][1]
            form = tuple(b - a for a, b in groups[i:j + 1])
            marks = {text[b] for _, b in groups[i:j]}
            if n > 12 and (len(form) == 1 or (form in FORMS and len(marks) == 1)):
                usual.append((-n, span))
            elif n > 11 and span == m.span() or n > 12 and text[span[0]] in "23456":
                other.append((span != m.span(), -n, span))
    return [x[-1] for x in sorted(usual) + sorted(other)]


def account_spans(text: str, m: re.Match) -> list[tuple[int, int]]:
    """Where an account may end that begins here: at its country's length, at the end of all groups, and without a country at each group's end."""
    whole = _GROUPS.match(text, m.start())
    country = LENGTHS.get(text[m.start():m.start() + 2])
    ends, n, at = [], 0, m.start()
    while at < len(text) and n < 34:
        at += text[at] == " "
        if at == len(text) or _alphabet(text[at]) not in (DIGITS, LARGE):
            break
        at, n = at + 1, n + 1
        edge = at == len(text) or not (text[at].isalnum() or text[at] == "_")
        if edge and (n == country if country else n > 11):
            ends.append(at)
    ends = ends[::-1]
    if whole and whole.end() not in ends:
        ends.append(whole.end())
    return [(m.start(), x) for x in ends]


KINDS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "mail": (r"(?<![A-Za-z0-9])[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}", mail),
    "token": (r"\bAKIA[0-9A-Z]{16}\b|\b(?=[0-9a-f]*[0-9])(?=[0-9a-f]*[a-f])[0-9a-f]{32,128}\b|(?<=password=)[0-9a-f]{8,128}\b", token),
    "account": (r"\b[A-Z]{2}\d{2}(?= ?[A-Z0-9])", account),
    "day": (r"(?<![\d./-])(?:\d{4}([-/.])\d{1,2}\1\d{1,2}|\d{1,2}([-/.])\d{1,2}\2\d{4})(?![/-]?\d)", day),
    "address": (r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d)", address),
    "card": (r"(?<!\d)(?<!\d[ -])\d(?:[ -]?\d){11,}", card),
    "phone": (r"(?<![\d.])(?:\+?1[ .-]?)?(?:\([2-9]\d\d\) ?|[2-9]\d\d[ .-])[2-9]\d\d[ .-]\d{4}(?!\d)|(?<![\w.+-])(?:\+?1[ .-]?)?[2-9]\d\d[2-9]\d{6}(?![\w-]|\.\d)", phone),
    "social": (r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])", social),
}
#: Places inside a match that are tried in turn; other kinds take the whole match.
SPANS: dict[str, Callable[[str, re.Match], list[tuple[int, int]]]] = {"card": card_spans, "account": account_spans}
_GROUPS = re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?\b")
_ANY = re.compile("[0-9@]")
_PATTERNS = [(kind, re.compile(pattern), change) for kind, (pattern, change) in KINDS.items()]


def pseudonymise(text: str, key: bytes) -> tuple[str, list[tuple[str, int, int]]]:
    """(text with pseudonyms, their kind and place in the new text). Where patterns overlap, the first kind takes the value."""
    if not _ANY.search(text):
        return text, []
    found: list[tuple[int, int, str, str]] = []
    for kind, pattern, change in _PATTERNS:
        for m in pattern.finditer(text):
            for start, end in SPANS[kind](text, m) if kind in SPANS else [m.span()]:
                if not any(a < end and start < b for a, b, _, _ in found) and (new := change(text[start:end], key)) is not None:
                    found.append((start, end, kind, new))
    out, places, at, length = [], [], 0, 0
    for start, end, kind, new in sorted(found):
        out += [text[at:start], new]
        length += start - at
        places.append((kind, length, length + len(new)))
        length, at = length + len(new), end
    return "".join([*out, text[at:]]), places


def pseudonymised(docs: DataFrame, key: bytes, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per row: doc_id, n_values, values (kind, start, end in the new text), text.

    The found values themselves are not returned. A null text stays null, without
    values. Other columns are left out.
    """
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = [(None, []) if x is None else pseudonymise(x, key) for x in batch.column("text").to_pylist()]
        values = [[{"kind": k, "start": a, "end": b} for k, a, b in places] for _, places in done]
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([len(x) for x in values], pa.int64()), pa.array(values, kind), pa.array([x for x, _ in done], pa.string())],
                                          ["doc_id", "n_values", "values", "text"])

    return scan(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), run,
                "doc_id long, n_values long, values array<struct<kind: string, start: int, end: int>>, text string")

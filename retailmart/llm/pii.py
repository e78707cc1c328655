"""Format-preserving pseudonyms for personal data, by keyed Feistel permutations.

A value that passes its format's validation is read as a number below the size of the format
and permuted there by a Feistel network, walking on while the result is outside. Check digits
are worked out anew. The same value and key give the same pseudonym everywhere, so equal values
stay linked across documents, and no table of values is kept. What is permuted is the value
without its writing: marks and spaces in cards, IBANs and phone numbers, upper case in IBANs and
e-mail addresses, and a time of day behind a date come back as they were.
"""

from __future__ import annotations

import datetime as dt
import hmac
import math
import re
from collections import Counter
from collections.abc import Callable, Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame

from retailmart.llm.workers import lean, parts

ROUNDS = 8
BLOCK = 64
PART_BYTES = 1 << 22  # of text that a task rewrites at a time
KINDS = ("secret", "email", "iban", "ip", "date", "ssn", "phone", "card")


def feistel(value: int, size: int, key: bytes, tweak: str) -> int:
    """A permutation of 0 to size - 1."""
    if size < 2:
        return value
    left_size = math.isqrt(size - 1) + 1
    right_size = -(-size // left_size)
    while True:
        left, right = divmod(value, right_size)
        a, b = left_size, right_size
        for k in range(ROUNDS):
            mac = hmac.digest(key, f"{tweak}|{size}|{k}|{right}".encode(), "sha256")
            left = (left + int.from_bytes(mac, "big")) % a
            left, right, a, b = right, left, b, a
        value = left * right_size + right
        if value < size:
            return value


_CLASSES = ("0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
_CLASSES += ("".join(map(chr, (*range(0xE0, 0xF7), *range(0xF8, 0x100)))), "".join(map(chr, (*range(0xC0, 0xD7), *range(0xD8, 0xDF)))))
_PLACE = {c: (group, i) for group in _CLASSES for i, c in enumerate(group)}


def permute_text(text: str, key: bytes, tweak: str) -> str:
    """Permute the letters and digits of a text, each within its class; others stay. A text longer
    than BLOCK goes block by block: a digest has 256 bits, and each half of a block fewer."""
    if len(text) > BLOCK:
        return "".join(permute_text(text[k : k + BLOCK], key, f"{tweak}|{k}") for k in range(0, len(text), BLOCK))
    value, size = 0, 1
    for c in text:
        if c in _PLACE:
            group, i = _PLACE[c]
            value, size = value * len(group) + i, size * len(group)
    shape = "".join(next(str(k) for k, g in enumerate(_CLASSES) if c in g) if c in _PLACE else c for c in text)
    value = feistel(value, size, key, f"{tweak}|{shape}")
    out = []
    for c in reversed(text):
        if c in _PLACE:
            group, _ = _PLACE[c]
            value, i = divmod(value, len(group))
            c = group[i]
        out.append(c)
    return "".join(reversed(out))


def _digits(text: str) -> str:
    return "".join(c for c in text if c in _CLASSES[0])


def _refill(text: str, digits: str) -> str:
    left = iter(digits)
    return "".join(next(left) if c in _CLASSES[0] else c for c in text)


def luhn_digit(digits: str) -> str:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (2 if k % 2 == 0 else 1)
        total += d - 9 if d > 9 else d
    return str(-total % 10)


#: Sizes of the groups that card numbers are written in, the usual first.
_CARD_GROUPS = ((4, 4, 4, 4), (4, 6, 5), (4, 6, 4), (4, 4, 5), *((n,) for n in (16, 15, 14, 13, 19, 18, 17)))
_CARD_GROUPS += ((8, 8), (6, 13), (4, 4, 4, 4, 3), (4, 4, 4, 4, 2), (4, 4, 4, 4, 1), (4, 4, 4, 3), (4, 4, 4, 2))


def _card_spans(run: str, usual: bool) -> Iterator[tuple[int, int]]:
    """Spans that may be cards in a run of groups of digits: those in usual groups, or else the
    whole run, then any other groups of which all but the last have three digits or more."""
    groups = [(m.start(), m.end()) for m in re.finditer("[0-9]+", run)]
    sizes = [b - a for a, b in groups]
    if usual:
        for shape in _CARD_GROUPS:
            for i in range(len(groups) - len(shape) + 1):
                if tuple(sizes[i : i + len(shape)]) == shape:
                    yield groups[i][0], groups[i + len(shape) - 1][1]
        return
    if sum(sizes) <= 19:
        yield 0, len(run)
    for i in range(len(groups)):
        ends, total = [], 0
        for j in range(i, len(groups)):
            total += sizes[j]
            if total > 19:
                break
            if total >= 13:
                ends.append(groups[j][1])
            if sizes[j] < 3:
                break
        yield from ((groups[i][0], end) for end in reversed(ends))


def _cards(text: str, key: bytes, usual: bool) -> Iterator[tuple[int, int, str]]:
    if usual:
        for match in _CARD_DOTTED.finditer(text):
            if (fresh := _card(match.group(), key)) is not None:
                yield match.start(), match.end(), fresh
    for match in _CARD_RUN.finditer(text):
        run, first = match.group(), match.start()
        if text[first - 1 : first] == "+" and len(_digits(run)) <= 15:  # a phone number
            continue
        taken: list[tuple[int, int]] = []
        for a, b in _card_spans(run, usual):
            if all(b <= c or d <= a for c, d in taken) and (fresh := _card(run[a:b], key)) is not None:
                taken.append((a, b))
                yield first + a, first + b, fresh


def _card(text: str, key: bytes) -> str | None:
    digits = _digits(text)
    if not 13 <= len(digits) <= 19 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    body = permute_text(digits[:-1], key, "card")
    return _refill(text, body + luhn_digit(body))


def iban_check(country: str, body: str) -> str:
    number = int("".join(str(int(c, 36)) for c in f"{body}{country}00"))
    return f"{98 - number % 97:02d}"


#: Characters of an IBAN by country.
_IBAN_LENGTHS = {
    c: n
    for n, countries in {
        15: "NO", 16: "BE", 18: "DK FI FK FO GL NL SD", 19: "MK SI", 20: "AT BA EE KZ LT LU MN XK",
        21: "CH HR LI LV", 22: "BG BH CR DE GB GE IE ME RS VA", 23: "AE GI IL IQ OM SO TL",
        24: "AD CZ ES MD PK RO SA SE SK TN VG", 25: "LY PT ST", 26: "IS TR", 27: "BI DJ FR GR IT MC MR SM",
        28: "AL AZ BY CY DO GT HU LB NI PL SV", 29: "BR EG PS QA UA", 30: "JO KW MU YE", 31: "MT SC", 32: "LC", 33: "RU",
    }.items()
    for c in countries.split()
}


def _ibans(text: str, key: bytes) -> Iterator[tuple[int, int, str]]:
    """Of each start the length of its country first, then all ends of words, the longest first."""
    at = 0
    while match := _IBAN_RUN.search(text, at):
        run, at = match.group(), match.start() + 1
        ends = [k for k in range(15, len(run) + 1) if run[k - 1] != " " and not re.match(r"\w", text[match.start() + k : match.start() + k + 1])]
        own = _IBAN_LENGTHS.get(run[:2].upper())
        ends.sort(key=lambda k: (len(run[:k].replace(" ", "")) != own, -k))
        for end in ends:
            if (fresh := _iban(run[:end], key)) is not None:
                yield match.start(), match.start() + end, fresh
                at = match.start() + end
                break


def _iban(text: str, key: bytes) -> str | None:
    plain = text.replace(" ", "").upper()
    country, check, body = plain[:2], plain[2:4], plain[4:]
    if not 11 <= len(body) <= 30 or iban_check(country, body) != check:
        return None
    body = permute_text(body, key, f"iban|{country}")
    fresh = country + iban_check(country, body) + body
    left = iter(fresh.lower() if text == text.lower() else fresh)
    return "".join(c if c == " " else next(left) for c in text)


def _ssn(text: str, key: bytes) -> str | None:
    def valid(d: str) -> bool:
        return d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"

    digits = _digits(text)
    if not valid(digits):
        return None
    while not valid(digits := permute_text(digits, key, "ssn")):
        pass
    return _refill(text, digits)


def _phone(text: str, key: bytes) -> str | None:
    code = re.match(r"\+[0-9]{1,3}(?=[ .(-])", text)
    head = code.group() if code else ""
    rest = text[len(head) :]
    if not 7 <= len(_digits(rest)) <= 14:
        return None
    return head + _refill(rest, permute_text(_digits(rest), key, f"phone|{head}"))


def _ip(text: str, key: bytes) -> str | None:
    parts = [int(p) for p in text.split(".")]
    if max(parts) > 255:
        return None
    value = feistel(int.from_bytes(bytes(parts), "big"), 1 << 32, key, "ip")
    return ".".join(map(str, value.to_bytes(4, "big")))


_FIRST, _LAST = dt.date(1900, 1, 1).toordinal(), dt.date(2100, 1, 1).toordinal()


def _date(text: str, key: bytes) -> str | None:
    a, mark, b, _, c = re.split(r"([-/.])", text)
    parts = (int(a), int(b), int(c))
    for order in ("ymd",) if len(a) == 4 else ("dmy", "mdy"):
        try:
            ordinal = dt.date(*(parts[order.index(p)] for p in "ymd")).toordinal()
        except ValueError:
            continue
        if not _FIRST <= ordinal < _LAST:
            return None
        moved = dt.date.fromordinal(_FIRST + feistel(ordinal - _FIRST, _LAST - _FIRST, key, "date"))
        put = {"y": f"{moved.year:04d}", "m": f"{moved.month:02d}", "d": f"{moved.day:02d}"}
        return mark.join(put[p] for p in order)
    return None


def _email(text: str, key: bytes) -> str | None:
    local, _, domain = text.rpartition("@")
    host, dot, top = domain.rpartition(".")
    return f"{_permute_lower(local, key, 'local')}@{_permute_lower(host, key, 'host')}{dot}{top}"


def _permute_lower(text: str, key: bytes, tweak: str) -> str:
    """Permute a text whatever its case, and put its case back."""
    low = text.lower()
    if len(low) != len(text):
        return permute_text(text, key, tweak)
    fresh = permute_text(low, key, tweak)
    return "".join(f if c == lower else f.upper() for f, c, lower in zip(fresh, text, low, strict=True))


def _secret(text: str, key: bytes) -> str | None:
    head, value, tail = re.fullmatch(_SECRET_PARTS, text, re.I | re.S).groups()
    return head + permute_text(value, key, "secret") + tail


_SECRET_PARTS = r"""((?:api[_-]?key|token|secret|password|passwd)\s*[:=]\s*["']?)([^\s"',;]{6,})(["']?)"""
_PATTERNS: dict[str, tuple[str, Callable[[str, bytes], str | None]]] = {
    "secret": (r"\b" + re.sub(r"\((?!\?)", "(?:", _SECRET_PARTS), _secret),
    "email": (r"[\w.+%-]+@[\w-]+(?:\.[\w-]+)*\.[A-Za-z]{2,}", _email),
    "ip": (r"(?<![\w.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\.?\w)", _ip),
    "date": (r"(?<![\w./-])(?:[0-9]{4}([-/.])[0-9]{1,2}\1[0-9]{1,2}|[0-9]{1,2}([-/.])[0-9]{1,2}\2[0-9]{4})(?=T[0-9]{2}:?[0-9]{2}|(?![\w/-]|\.[0-9]))", _date),
    "ssn": (r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    "phone": (r"(?<![\w+.-])(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{2,4}\)[ .-]?|[0-9]{2,4}[ .-])[0-9]{3,4}[ .-][0-9]{3,4}(?![\w-]|\.[0-9])|(?<![\w+.-])\+[0-9]{8,14}(?!\w)", _phone),
}
_COMPILED = {kind: (re.compile(pattern, re.I if kind == "secret" else 0), own) for kind, (pattern, own) in _PATTERNS.items()}
_IBAN_RUN = re.compile(r"\b[A-Za-z]{2}[0-9]{2}(?: ?[A-Za-z0-9]){11,30}")
_CARD_DOTTED = re.compile(r"(?<![\w.-])(?:[0-9]{4}(?:\.[0-9]{4}){3}|[0-9]{4}\.[0-9]{6}\.[0-9]{5})(?![\w-]|\.[0-9])")
_CARD_RUN = re.compile(r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,}(?![\w-])")


def _matches(text: str, key: bytes, kind: str) -> Iterator[tuple[int, int, str]]:
    pattern, own = _COMPILED[kind]
    for match in pattern.finditer(text):
        if (fresh := own(match.group(), key)) is not None:
            yield match.start(), match.end(), fresh


#: (kind, finder of (start, end, pseudonym)). Cards in usual groups go before phones, which could
#: take their first groups; other runs of groups after, as two phones side by side are one.
_FINDERS: list[tuple[str, Callable[[str, bytes], Iterator[tuple[int, int, str]]]]] = [
    (kind, _ibans if kind == "iban" else partial(_matches, kind=kind)) for kind in ("secret", "email", "iban", "ip", "date", "ssn")
]
_FINDERS += [("card", partial(_cards, usual=True)), ("phone", partial(_matches, kind="phone")), ("card", partial(_cards, usual=False))]
_ANY = re.compile(r"[0-9@]|token|secret|passw|api.?key", re.I)


def pseudonymise(text: str, key: bytes) -> tuple[str, Counter]:
    """The text with every validated value replaced, and how many of each kind were."""
    counts: Counter = Counter()
    if not _ANY.search(text):
        return text, counts
    if "\x00" in text:  # the mark used below
        parts = [pseudonymise(part, key) for part in text.split("\x00")]
        return "\x00".join(p[0] for p in parts), sum((p[1] for p in parts), counts)
    found: list[tuple[int, int, str]] = []
    held = text  # found values are blanked out, so that no later kind reads them again
    for kind, find in _FINDERS:
        parts, at = [], 0
        for a, b, fresh in sorted(find(held, key)):
            counts[kind] += 1
            found.append((a, b, fresh))
            parts += [held[at:a], "\x00" * (b - a)]
            at = b
        held = "".join([*parts, held[at:]])
    parts, at = [], 0
    for a, b, fresh in sorted(found):
        parts += [text[at:a], fresh]
        at = b
    return "".join([*parts, text[at:]]), counts


@lean
def _rows(batches, key: bytes, place: int) -> Iterator[pa.RecordBatch]:
    for batch in parts(batches, place, PART_BYTES):
        texts, counts = [], []
        for text in batch.column(place).to_pylist():
            fresh, found = (text, Counter()) if text is None else pseudonymise(text, key)
            texts.append(fresh)
            counts.append(found)
        columns = batch.columns
        columns[place] = pa.array(texts, pa.string())
        names = [*batch.schema.names, *(f"n_{k}" for k in KINDS)]
        found = [pa.array([c[k] for c in counts], pa.int64()) for k in KINDS]
        yield pa.RecordBatch.from_arrays([*columns, *found], names)


def pseudonymise_documents(docs: DataFrame, key: bytes, text: str = "text") -> DataFrame:
    """docs with the text pseudonymised, and n_<kind> for each of KINDS.

    Columns named n_<kind> are replaced; all others stay as they are. A null text stays null
    with counts of 0, rows come back as often as they came, and an empty table gives none.
    Values that fail validation stay: a number without its check digit, a day that isn't one.
    """
    if not key:
        raise ValueError("a key is needed")
    docs = docs.drop(*[f"n_{k}" for k in KINDS])
    schema = ", ".join(
        [f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema] + [f"n_{k} bigint" for k in KINDS]
    )
    return docs.mapInArrow(partial(_rows, key=key, place=docs.columns.index(text)), schema)

"""Format-preserving pseudonyms by Feistel networks.

Values are found by pattern and validated: payment cards and IBANs by their check digits, dates by the calendar, addresses and numbers by their
ranges. A valid value is permuted within its format by a keyed Feistel network over mixed radices: each character keeps its class, check digits
are computed anew, dates stay dates of the same notation. The permutation depends on key, kind and value only, so equal values get equal
pseudonyms in every document, different ones different ones, and the key's owner can go back (``restore``). A card or IBAN is also found beside other numbers, where the longer
reading isn't valid; there its pseudonym is permuted on until that reading stays invalid, so it may differ from the one elsewhere.

Nulls: a null text stays null and has no values; an invalid value stays as it is. Repeated rows give equal results. An empty table
gives an empty result; extra columns are kept, but ``values`` and ``n_values`` are replaced.
"""

from __future__ import annotations

import datetime
import functools
import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table

#: For the registered query; a user passes their own.
DEMO_KEY = b"demonstration key, replace in use"
ROUNDS = 10
_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def _round(key: bytes, kind: str, step: int, value: int, size: int) -> int:
    data = f"{kind}|{step}|{size}|{value}".encode()
    return int.from_bytes(hashlib.blake2b(data, key=key[:64], digest_size=32).digest(), "big") % size


def feistel(x: int, a: int, b: int, key: bytes, kind: str, back: bool = False) -> int:
    """A permutation of 0 .. a * b - 1: the halves, of sizes a and b, are shifted in turn by a keyed function of the other."""
    left, right = divmod(x, b)
    for step in reversed(range(ROUNDS)) if back else range(ROUNDS):
        sign = -1 if back else 1
        if step % 2:
            right = (right + sign * _round(key, kind, step, left, b)) % b
        else:
            left = (left + sign * _round(key, kind, step, right, a)) % a
    return left * b + right


def permuted(x: int, n: int, key: bytes, kind: str, back: bool = False) -> int:
    """A permutation of 0 .. n - 1: the network over a slightly larger square, walked on until it is back inside."""
    a = math.isqrt(n - 1) + 1 if n > 1 else 1
    while True:
        x = feistel(x, a, -(-n // a), key, kind, back)
        if x < n:
            return x


def moved(x: int, n: int, key: bytes, kind: str, back: bool = False) -> int:
    """A permutation of 0 .. n - 1 that leaves none in place, for sets so small that a value would often stay: a shift of permuted numbers."""
    shift = 1 + _round(key, kind, ROUNDS, 0, n - 1)
    return permuted((permuted(x, n, key, kind) + (-shift if back else shift)) % n, n, key, kind, True)


def characters(value: str, alphabets: list[str | None], key: bytes, kind: str, back: bool = False) -> str:
    """``value`` with each character permuted within its alphabet (None: kept), all of them together."""
    at = [i for i, s in enumerate(alphabets) if s]
    kind = f"{kind}:{''.join(c if s is None else '_' for c, s in zip(value, alphabets, strict=True))}"
    half = len(at) // 2
    size = [math.prod(len(alphabets[i]) for i in part) for part in (at[:half], at[half:])]
    x = 0
    for i in at:
        x = x * len(alphabets[i]) + alphabets[i].index(value[i])
    x = moved(x, size[1], key, kind, back) if len(at) == 1 else feistel(x, size[0], size[1], key, kind, back)
    out = list(value)
    for i in reversed(at):
        x, c = divmod(x, len(alphabets[i]))
        out[i] = alphabets[i][c]
    return "".join(out)


def _classes(value: str, first: int = 0) -> list[str | None]:
    return [None if i < first else next((s for s in (_DIGITS, _LOWER, _UPPER) if c in s), None) for i, c in enumerate(value)]


def luhn(digits: str) -> int:
    """The check digit that follows ``digits``."""
    total = sum(d if i % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(map(int, reversed(digits))))
    return -total % 10


def _card(value: str, key: bytes, back: bool) -> str | None:
    digits = [i for i, c in enumerate(value) if c.isdigit()]
    plain = "".join(value[i] for i in digits)
    if not 13 <= len(plain) <= 19 or luhn(plain[:-1]) != int(plain[-1]):
        return None
    # The issuer's first digit stays, the check digit follows from the others.
    body = characters(plain[:-1], [None, *[_DIGITS] * (len(plain) - 2)], key, "card", back)
    out = list(value)
    for i, c in zip(digits, body + str(luhn(body)), strict=True):
        out[i] = c
    return "".join(out)


def _iban_check(country: str, account: str) -> int:
    return 98 - int("".join(str(int(c, 36)) for c in account + country + "00")) % 97


def _iban(value: str, key: bytes, back: bool) -> str | None:
    plain = value.replace(" ", "")
    country, check, account = plain[:2], plain[2:4], plain[4:]
    if not 15 <= len(plain) <= 34 or _iban_check(country, account) != int(check):
        return None
    account = characters(account, _classes(account), key, f"iban {country}", back)
    new = iter(f"{country}{_iban_check(country, account):02d}{account}")
    return "".join(c if c == " " else next(new) for c in value)


def _ip(value: str, key: bytes, back: bool) -> str | None:
    parts = value.split(".")
    if any(int(p) > 255 or str(int(p)) != p for p in parts):
        return None
    x = permuted(int.from_bytes(bytes(map(int, parts)), "big"), 1 << 32, key, "ip", back)
    return ".".join(map(str, x.to_bytes(4, "big")))


_FIRST, _LAST = datetime.date(1800, 1, 1).toordinal(), datetime.date(2199, 12, 31).toordinal()


def _date(value: str, key: bytes, back: bool) -> str | None:
    sep = next(c for c in value if not c.isdigit())
    parts = value.split(sep)
    order = "ymd" if len(parts[0]) == 4 else "dmy" if int(parts[0]) > 12 or sep == "." else "mdy"
    # Day first or month first can't be told apart below 13; each notation is permuted within itself.
    try:
        day = datetime.date(*(int(parts[order.index(k)]) for k in "ymd")).toordinal()
    except ValueError:
        return None
    if not _FIRST <= day <= _LAST:
        return None
    kind, inside = f"date {order}{sep}", order != "dmy" or sep == "."
    x = day - _FIRST
    while True:
        x = permuted(x, _LAST - _FIRST + 1, key, kind, back)
        d = datetime.date.fromordinal(x + _FIRST)
        if inside or d.day > 12:  # else it would read as month first
            break
    text = {"y": f"{d.year:04d}", "m": f"{d.month:02d}", "d": f"{d.day:02d}"}
    return sep.join(text[k] for k in order)


#: Country codes of one and two digits; all others have three. No code is the beginning of another.
_COUNTRY = re.compile(r"[17]|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]")


def _phone(value: str, key: bytes, back: bool) -> str | None:
    digits = [i for i, c in enumerate(value) if c.isdigit()]
    keep = 0
    if value.startswith("+"):
        run = re.match(r"[0-9]+", value[1:])[0]
        code = _COUNTRY.match(run)
        # The country code stays, as far as seven digits are left; a code that is cut short by a separator ends there.
        keep = min(len(code[0]) if code else 3, len(run), max(len(digits) - 7, 0))
    alphabets: list[str | None] = [None] * len(value)
    for i in digits[keep:]:
        alphabets[i] = _DIGITS
    return characters(value, alphabets, key, "phone", back)


def _ssn(value: str, key: bytes, back: bool) -> str | None:
    def valid(v: str) -> bool:
        return v[:3] not in ("000", "666") and v[0] != "9" and v[4:6] != "00" and v[7:] != "0000"

    if not valid(value):
        return None
    alphabets = [None if c == "-" else _DIGITS for c in value]
    while True:
        value = characters(value, alphabets, key, "ssn", back)
        if valid(value):
            return value


def _email(value: str, key: bytes, back: bool) -> str | None:
    name, _, host = value.rpartition("@")
    return f"{characters(name, _classes(name), key, 'email', back)}@{host}"


def _access_key(value: str, key: bytes, back: bool) -> str | None:
    return characters(value, [None if i < 4 else _DIGITS if c.isdigit() else _UPPER for i, c in enumerate(value)], key, "access key", back)


def _secret(value: str, key: bytes, back: bool) -> str | None:
    return characters(value, [_HEX] * len(value), key, "secret", back)


#: (kind, pattern, permutation), tried in this order at each place.
KINDS: list[tuple[str, str, Callable[[str, bytes, bool], str | None]]] = [
    ("email", r"\b[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63})+\b", _email),
    ("access_key", r"\bAKIA[A-Z0-9]{16}\b", _access_key),
    ("secret", r"(?<=password=)[0-9a-f]{8,64}\b|(?<=token = \")[0-9a-f]{16,64}\b", _secret),
    ("iban", r"\b[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]){11,30}\b", _iban),
    ("ip", r"(?<![\w.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![\w]|\.[0-9])", _ip),
    ("date", r"(?<![\w/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}[/.-][0-9]{2}[/.-][0-9]{4})(?![\w/-])", _date),
    ("ssn", r"(?<![\w-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![\w-])", _ssn),
    ("phone", r"(?<![\w+])(?:\+[0-9]{1,3}[ -]?)?\([0-9]{3}\) ?[0-9]{3}[ -][0-9]{4}(?!\w)|(?<![\w+])\+[0-9]{1,3}(?:[ -]?[0-9]{2,4}){3,4}(?!\w)|(?<![\w-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![\w-])", _phone),
    ("card", r"(?<![\w.-])[0-9](?:[ -]?[0-9]){12,18}(?![\w-])", _card),
]
_PATTERN = re.compile("|".join(f"(?P<{k}>{p})" for k, p, _ in KINDS))
_BY_KIND = {k: f for k, _, f in KINDS}
_ONE = {k: re.compile(p) for k, p, _ in KINDS}
#: A card at a later group of a number that isn't valid, where the groups may be joined by hyphens.
_INNER = re.compile(r"[0-9](?:[ -]?[0-9]){12,18}(?![\w-])")
_GROUP = re.compile(r"(?<![A-Za-z0-9])[A-Za-z0-9]")


def pseudonym(kind: str, value: str, key: bytes, back: bool = False) -> str | None:
    """The pseudonym of a value, or None if it isn't valid. ``back`` undoes it."""
    return _BY_KIND[kind](value, key, back)


def _readings(text: str, at: int, inside: int) -> Iterator[tuple[str, int]]:
    """(kind, end) of the values that may start at ``at``, in the order of KINDS, and numbers and IBANs longest first, cut between groups."""
    for kind, pattern in _ONE.items():
        m = pattern.match(text, at) or (kind == "card" and at < inside and _INNER.match(text, at))
        if m:
            yield kind, m.end()
            if kind in ("card", "iban"):
                yield from ((kind, e) for e in range(m.end() - 1, at, -1) if text[e] in " -")


def _first(text: str, at: int, new) -> tuple[str, int, int, str, int] | None:
    """(kind, start, end, pseudonym, context) of the first valid value from ``at``. What isn't valid is read again from each later group of it;
    ``context`` is where the first reading begins that was refused and reaches into the value, or -1."""
    inside, refused = at, []  # end of the refused card, (start, end) of what was refused
    while True:
        m = _PATTERN.search(text, at)
        start = at if at < inside else m.start() if m else -1
        if start < 0:
            return None
        reach = start
        for kind, end in _readings(text, start, inside):
            value = new(kind, text[start:end])
            if value is not None:
                return kind, start, end, value, min((s for s, e in refused if e > start), default=-1)
            refused.append((start, end))
            reach = max(reach, end)
            if kind == "card":
                inside = max(inside, end)
        g = _GROUP.search(text, start + 1, max(reach, inside))
        at = g.start() if g else max(reach, inside, start + 1)


def rewrite(text: str, key: bytes, back: bool = False, cached=None) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms, and (kind, start, end) of each in it."""

    def new(kind: str, value: str) -> str | None:
        return (cached or pseudonym)(kind, value, key, back)

    out, spans, at, n = [], [], 0, 0
    while found := _first(text, at, new):
        kind, start, end, value, context = found
        if context >= 0:
            # Other readings of these characters must stay refused, or the way back would take them: walk on until they are.
            lo, hi = max(0, context - 16), end + 128
            while (again := _first(text[lo:start] + value + text[end:hi], context - lo, new)) is None or again[:3] != (kind, start - lo, end - lo):
                value = new(kind, value)
        out += [text[at:start], value]
        n += start - at
        spans.append((kind, n, n + len(value)))
        n += len(value)
        at = end
    return ("".join([*out, text[at:]]), spans) if spans else (text, spans)


VALUE = T.ArrayType(T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def pseudonymise(docs: DataFrame, key: bytes, back: bool = False) -> DataFrame:
    """``docs`` with pseudonyms in ``text``, their places in ``values``, in characters, and ``n_values``."""
    docs = docs.drop("values", "n_values")
    shape = T.StructType([*docs.schema.fields, T.StructField("values", VALUE), T.StructField("n_values", T.LongType())])
    value = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cached = functools.lru_cache(100_000)(pseudonym)
        for b in batches:
            i = b.schema.get_field_index("text")
            texts, spans = [], []
            for t in b.column(i).to_pylist():
                new, found = (t, []) if t is None else rewrite(t, key, back, cached)
                texts.append(new)
                spans.append([{"kind": k, "start": s, "end": e} for k, s, e in found])
            columns = [pa.array(texts, pa.string()) if k == i else c for k, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, value), pa.array([len(s) for s in spans], pa.int64())], [*b.schema.names, "values", "n_values"])

    return docs.mapInArrow(run, shape)


def restore(docs: DataFrame, key: bytes) -> DataFrame:
    """Undoes ``pseudonymise``."""
    return pseudonymise(docs, key, back=True).drop("values", "n_values")


def _is(kind: str) -> Callable:
    return lambda v: v["kind"] == kind


def op5_feistel_pseudonyms(spark, sf_dir):
    out = pseudonymise(table(spark, sf_dir, "documents").select("doc_id", "text"), DEMO_KEY)
    kinds = [F.size(F.filter("values", _is(k))).cast("long").alias(f"n_{k}") for k, _, _ in KINDS]
    return out.select("doc_id", "n_values", *kinds, "values", "text")

"""Operator 1: format-preserving Feistel pseudonyms for personal numbers, dates and addresses.

A value is found by a pattern and kept only if it is valid (Luhn digit, calendar date, IBAN check, numbering
rules). It is then read as a number of a mixed-radix system, one digit for each letter or digit that may
change, permuted by a keyed Feistel network over the next even power of two, and walked along the
permutation's cycle until it is inside the system and valid again. So a pseudonym has the value's format,
separators and validity, different values have different pseudonyms, and equal values have equal ones in
all documents, whatever their separators. Dates are permuted among the days of 1900 to 2099, those up to the
12th of a month and the later ones apart, so that day and month keep their order and can be told apart as before.

Each kind has its own permutation. The key is a secret of the caller; without it, pseudonyms tell no more
than which values are equal.

Defined cases: null text stays null; texts without values are unchanged; where patterns overlap, the one
that starts first wins, of those the first kind listed; repeated rows each get a row; texts of any length
are scanned whole; an empty table gives no rows; other columns are passed through whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
DIGITS, LOWER, UPPER = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIRST_DAY = date(1900, 1, 1)
DAYS = (date(2100, 1, 1) - FIRST_DAY).days

# What isn't a further group of a phone number, though it follows after a space: an address, a date or a card number.
_OTHER = (
    r"(?! (?:[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])|[0-9]{4}-[0-9]{2}-[0-9]{2}(?![0-9])|[0-9]{2}(?:/[0-9]{2}/|\.[0-9]{2}\.)[0-9]{4}(?![0-9])"
    r"|[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9])|[0-9]{13,19}(?![0-9])|[0-9]{4}[ -][0-9]{4}[ -][0-9]{4}[ -][0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}))"
)
# A digit of an international number, before it perhaps a single separator, which begins a group of two digits at least.
_NEXT = rf"(?:(?:{_OTHER}[ ./-](?=[0-9]{{2}}))?[0-9])"
# 8 to 15 digits: a country code of c digits, perhaps an area code of b digits in brackets, and the rest in any groups.
_ABROAD = "|".join(
    [rf"[0-9]{{{c}}}[ .-]?\([0-9]{{{b}}}\)[ ./-]?[0-9]{_NEXT}{{{max(3, 7 - c - b)},{14 - c - b}}}" for c in (3, 2, 1) for b in (4, 3, 2, 1)]
    + [rf"[0-9]{{{c}}}[ ./-]?[0-9]{_NEXT}{{{7 - c},{14 - c}}}" for c in (3, 2, 1)]
)

# The kinds and their patterns, in order of preference. No value is part of a longer number or word.
PATTERNS = (
    ("email", r"(?<![A-Za-z0-9._%+-])[._%+-]*(?P<mail>[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,})"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    ("ipv4", r"(?<![0-9.])[0-9]{1,3}(?:\.[0-9]{1,3}){3}(?![0-9]|\.[0-9])"),
    ("date", r"(?<![0-9/.-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{2}/[0-9]{2}/[0-9]{4}|[0-9]{2}\.[0-9]{2}\.[0-9]{4})(?![0-9])"),
    ("ssn", r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9]|-[0-9])"),
    ("card", r"(?<![0-9A-Za-z])(?:[0-9]{13,19}|[0-9]{4}(?P<s>[ -])[0-9]{4}(?P=s)[0-9]{4}(?P=s)[0-9]{4}|[0-9]{4}[ -][0-9]{6}[ -][0-9]{5})(?![0-9A-Za-z])"),
    (
        "phone",
        rf"(?<![0-9A-Za-z])\+(?:1[ .-]?(?:\([0-9]{{3}}\)|[0-9]{{3}})[ .-]?[0-9]{{3}}[ .-]?[0-9]{{4}}|{_ABROAD})(?![0-9]|\.[0-9])"
        r"|(?<![0-9A-Za-z(])(?:\([0-9]{3}\) ?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}(?![0-9]|\.[0-9])",
    ),
)
KINDS = tuple(k for k, _ in PATTERNS)
_any = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
_may = re.compile(r"[0-9@]")


def _luhn(d: str) -> bool:
    twice = [int(c) * 2 for c in d[-2::-2]]
    return (sum(map(int, d[-1::-2])) + sum(x - 9 * (x > 9) for x in twice)) % 10 == 0


def _iban(v: str) -> bool:
    return int("".join(str(int(c, 36)) for c in v[4:] + v[:4])) % 97 == 1


def _day(v: str) -> int | None:
    """The day's number, or None if there is no such day; day and month may be in either order if only one makes a date."""
    if v[4] == "-":
        y, m, d = int(v[:4]), int(v[5:7]), int(v[8:])
    else:
        d, m, y = int(v[:2]), int(v[3:5]), int(v[6:])
        if m > 12:
            d, m = m, d
    try:
        n = (date(y, m, d) - FIRST_DAY).days
    except ValueError:
        return None
    return n if 0 <= n < DAYS else None


class Feistel:
    """Keyed permutations of the numbers below any bound."""

    def __init__(self, key: bytes):
        self.key = hashlib.sha256(key).digest()

    def _round(self, tweak: bytes, i: int, half: int, bits: int) -> int:
        n = (bits + 7) // 8
        got = hashlib.shake_256(b"%b%d:%d:%b:%d" % (self.key, i, bits, tweak, half)).digest(n)
        return int.from_bytes(got, "big") >> (8 * n - bits)

    def once(self, x: int, bits: int, tweak: bytes) -> int:
        """A permutation of the numbers of 2 * ``bits`` bits."""
        left, right = x >> bits, x & ((1 << bits) - 1)
        for i in range(ROUNDS):
            left, right = right, left ^ self._round(tweak, i, right, bits)
        return left << bits | right

    def permute(self, x: int, size: int, tweak: bytes, valid: Callable[[int], bool] = lambda _: True) -> int:
        """A permutation of the valid numbers below ``size``, of which x is one."""
        bits = max(1, ((size - 1).bit_length() + 1) // 2)
        while True:
            x = self.once(x, bits, tweak)
            if x < size and valid(x):
                return x


def _alphabet(c: str) -> str:
    return DIGITS if c in DIGITS else LOWER if c in LOWER else UPPER if c in UPPER else ""


class Pseudonyms:
    """The value-to-pseudonym mapping under one key."""

    def __init__(self, key: bytes):
        self.feistel, self.known = Feistel(key), {}

    def _digits(self, value: str, kind: str, fixed: int, valid: Callable[[str], bool]) -> str | None:
        """``value`` (letters and digits only) with all after the first ``fixed`` characters permuted; None if it isn't valid."""
        if not valid(value):
            return None
        head, body = value[:fixed], value[fixed:]
        sets = [_alphabet(c) for c in body]
        size = n = 0
        size, n = 1, 0
        for c, s in zip(body, sets, strict=True):
            size, n = size * len(s), n * len(s) + s.index(c)

        def text(x: int) -> str:
            out = []
            for s in reversed(sets):
                x, r = divmod(x, len(s))
                out.append(s[r])
            return head + "".join(reversed(out))

        shape = "".join(s[0] for s in sets)
        return text(self.feistel.permute(n, size, f"{kind}:{head}:{shape}".encode(), lambda x: valid(text(x))))

    def _plain(self, value: str, kind: str, fixed: int, valid: Callable[[str], bool]) -> str | None:
        """As _digits, with separators left in their places."""
        bare = [c for c in value if _alphabet(c)]
        got = self._digits("".join(bare), kind, fixed, valid)
        if got is None:
            return None
        put = iter(got)
        return "".join(next(put) if _alphabet(c) else c for c in value)

    def _make(self, kind: str, value: str) -> str | None:
        if kind == "email":
            local, domain = value.split("@")
            got = self._plain(local, f"email@{domain.lower()}", 0, lambda v: True)
            return f"{got}@{domain}"
        if kind == "iban":
            return self._plain(value, kind, 2, lambda v: 15 <= len(v) <= 34 and _iban(v))
        if kind == "ipv4":
            parts = [int(x) for x in value.split(".")]
            if max(parts) > 255:
                return None
            n = self.feistel.permute(int.from_bytes(bytes(parts), "big"), 1 << 32, b"ipv4")
            return ".".join(map(str, n.to_bytes(4, "big")))
        if kind == "date":
            if (n := _day(value)) is None:
                return None
            day = lambda x: FIRST_DAY + timedelta(x)
            late = day(n).day > 12
            d = day(self.feistel.permute(n, DAYS, b"date", lambda x: (day(x).day > 12) == late))
            if value[4] == "-":
                return f"{d:%Y-%m-%d}"
            first, second = ("%m", "%d") if int(value[3:5]) > 12 else ("%d", "%m")
            return f"{d:{first}}{value[2]}{d:{second}}{value[2]}{d:%Y}"
        if kind == "ssn":
            return self._plain(value, kind, 0, lambda v: v[:3] not in ("000", "666") and v[0] != "9" and v[3:5] != "00" and v[5:] != "0000")
        if kind == "card":
            return self._plain(value, kind, 0, lambda v: 13 <= len(v) <= 19 and _luhn(v))
        # A phone number: the country code stays; numbers of North America keep its rule for the leading digits.
        code = re.match(r"\+([0-9]{1,3})(?=[ ./(-])", value)
        fixed = len(code[1]) if code else 1 if value.startswith("+1") else 2 if value[0] == "+" else 0
        north = fixed == 0 or re.sub("[^0-9]", "", value)[:fixed] == "1"

        def valid(v: str) -> bool:
            return 8 <= len(v) <= 15 and (not north or len(v) - fixed != 10 or was_loose or (v[fixed] > "1" and v[fixed + 3] > "1"))

        bare = re.sub("[^0-9]", "", value)
        was_loose = north and len(bare) - fixed == 10 and not (bare[fixed] > "1" and bare[fixed + 3] > "1")
        return self._plain(value, "phone-loose" if was_loose else kind, fixed, valid)

    def __call__(self, kind: str, value: str) -> str | None:
        """The value's pseudonym, or None if it isn't a valid value of the kind."""
        got = self.known.get((kind, value), "")
        if got == "":
            if len(self.known) > 100_000:
                self.known.clear()
            got = self.known[kind, value] = self._make(kind, value)
        return got

    def replace(self, text: str | None) -> tuple[str | None, list[dict]]:
        """The text with pseudonyms, and for each one its kind, and start and end in the original text."""
        if not text or not _may.search(text):
            return text, []
        out, spans, done = [], [], 0
        at = 0
        while m := _any.search(text, at):
            kind = next(k for k in KINDS if m[k] is not None)
            start, end = m.span("mail" if kind == "email" else kind)  # signs before an address aren't part of it
            new = self(kind, text[start:end])
            at = m.start() + 1  # what isn't valid may hide a value
            if new is not None:
                out += [text[done:start], new]
                at = done = end
                spans.append({"kind": kind, "start": start, "end": end, "pseudonym": new})
        return "".join([*out, text[done:]]), spans


SPANS = "array<struct<kind:string,start:int,end:int,pseudonym:string>>"
_ARROW = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("pseudonym", pa.string())]))
_loaded: dict[bytes, Pseudonyms] = {}


def pseudonymise(docs: DataFrame, key: bytes, text_col: str = "text", spans_col: str | None = "pii_spans") -> DataFrame:
    """The table with personal values of ``text_col`` replaced, and as its last column ``spans_col`` (none if None):
    where and by what. Where the table has a column of that name, underscores are put to the new one's."""
    while spans_col and spans_col.lower() in (c.lower() for c in docs.columns):
        spans_col += "_"
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = _loaded.setdefault(key, Pseudonyms(key))
        for batch in batches:
            texts, spans = [], []
            for t in batch.column(at):
                new, where = names.replace(t.as_py())
                texts.append(new)
                spans.append(where)
            columns = [pa.array(texts, batch.schema.field(at).type) if i == at else c for i, c in enumerate(batch.columns)]
            labels = batch.schema.names
            if spans_col:
                columns, labels = [*columns, pa.array(spans, _ARROW)], [*labels, spans_col]
            yield pa.RecordBatch.from_arrays(columns, names=labels)

    return docs.mapInArrow(run, f"{kinds}, `{spans_col}` {SPANS}" if spans_col else kinds)


def digest(replaced: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The query's columns: the new text, its spans as kind:start:end, and the number of values by kind."""
    spans_col = replaced.columns[-1]
    of = lambda kind: F.size(F.filter(spans_col, lambda s: s["kind"] == kind)).cast("long")
    joined = F.concat_ws(",", F.transform(spans_col, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    return replaced.select(id_col, text_col, joined.alias("spans"), *[of(k).alias(f"n_{k}") for k in KINDS])

"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Found values are validated (Luhn sums, IBAN check digits, calendar dates, octets, number plans) and permuted within their own
format: each kind's values are numbered 0..N-1, a Feistel network over two halves permutes the numbers under a key, and walking the
cycle keeps the result below N. The same value gives the same pseudonym in every document, in whatever layout it is
written; different values of a format never meet; lengths, separators and letter case stay. Who holds the key can undo it.

Strings of more than WIDE free characters are not numbered: there the two halves are sequences of characters, each shifted within
its own alphabet by a stream as long as the half, so values of any length change as a whole, in time linear in their length.

Kinds: card (12 to 19 digits, Luhn-valid, the pseudonym too), iban, phone, ssn, ip, date, email (the local part), secret (a value of 16
or more characters assigned to a key, token, secret or password).

Numbers that stand next to each other are told apart: an unbroken run of 12 to 19 digits is a number of its own; of shorter runs the
longest row that is Luhn-valid and ends with a run is one. An IBAN ends at the last space where its check digits fit. (So in such
rows the undoing may, by chance, see other borders.)

Edge cases: a null text stays null, without finds; repeated rows get equal results; numbers that fail validation (dates like
2023-02-30, octets above 255, digits whose Luhn sum fails) stay as they are; other columns pass through, but one named like the spans
is replaced. Characters without an alphabet (punctuation, rare scripts) keep their place. A pseudonym may, with probability 1/N, equal its
value.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import table

#: The key of the queries and tests; production passes its own.
SAMPLE_KEY = b"sample key of the queries"
ROUNDS = 8

HINT = re.compile(r"[0-9@]")
SECRET_HINT = re.compile(r"token|secret|passw|key", re.I)
SECRET = re.compile(r"\b(?:[a-z0-9]+[_-])?(?:token|secret|api[ _-]?key|key|password|passwd)\b[\"']?\s*[=:]\s*[\"']?([a-z0-9_+/=-]{16,})", re.I)
NUMBER = re.compile(
    r"""
      (?P<ip>   (?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?!\.?\d))
    | (?P<date> (?<![\d./-])(?:\d{4}(?P<s1>[./-])\d\d(?P=s1)\d\d|\d\d(?P<s2>[./-])\d\d(?P=s2)\d{4})(?![./-]?\d))
    | (?P<ssn>  (?<![\d-])\d{3}-\d\d-\d{4}(?!-?\d))
    | (?P<phone>(?<![\w+])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?|\d{2,4}[ .-])\d{3}[ .-]\d{4}(?!\d)|(?<![\w+])\+\d{9,14}(?!\d))
    | (?P<iban> (?<![A-Za-z0-9])[A-Z]{2}\d\d(?:[ ]?[A-Z0-9]){11,30}(?![A-Za-z0-9]))
    | (?P<card> (?<!\d)\d(?:[ -]?\d){11})
    """,
    re.X,
)
DIGITS = re.compile(r"[ -]?(\d+)")
KINDS = ("ip", "date", "ssn", "phone", "iban", "card")
LOCAL = re.compile(r"[\w.%+-]")
DOMAIN = re.compile(r"[A-Za-z0-9](?:[A-Za-z0-9-]*\.)+[A-Za-z]{2,}")
#: Strings with more free characters than this are permuted by characters instead of by number.
WIDE = 32
#: Ranges of code points whose small letters, or letters without case, are permuted among themselves.
SCRIPTS = [(0x61, 0x7B), (0xDF, 0x180), (0x370, 0x400), (0x430, 0x460), (0x5D0, 0x5EB), (0x621, 0x64B), (0x3041, 0x3097), (0x30A1, 0x30FB), (0x4E00, 0xA000), (0xAC00, 0xD7A4)]
FIRST, LAST = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()


class Feistel:
    """A keyed permutation of 0..n-1."""

    def __init__(self, key: bytes, kind: str, n: int):
        self.n, self.a = n, max(1, math.isqrt(n - 1) + 1)
        self.b = -(-n // self.a)
        self.width = (self.a.bit_length() + 7) // 8
        self.hasher = hashlib.shake_256(hashlib.sha256(key).digest() + hashlib.sha256(kind.encode()).digest() + n.to_bytes(self.width * 2 + 1, "big"))

    def _mask(self, i: int, half: int) -> int:
        """As wide as a half and 16 bytes more, so that its remainder is even."""
        h = self.hasher.copy()
        h.update(bytes([i]) + half.to_bytes(self.width, "big"))
        return int.from_bytes(h.digest(self.width + 16), "big")

    def _once(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in range(ROUNDS):
            if i % 2:
                right = (right + self._mask(i, left)) % self.b
            else:
                left = (left + self._mask(i, right)) % self.a
        return left * self.b + right

    def _back(self, x: int) -> int:
        left, right = divmod(x, self.b)
        for i in reversed(range(ROUNDS)):
            if i % 2:
                right = (right - self._mask(i, left)) % self.b
            else:
                left = (left - self._mask(i, right)) % self.a
        return left * self.b + right

    def _walk(self, step: Callable[[int], int], x: int) -> int:
        x = step(x)
        while x >= self.n:
            x = step(x)
        return x

    def forward(self, x: int) -> int:
        return self._walk(self._once, x)

    def backward(self, x: int) -> int:
        return self._walk(self._back, x)


def shifted(key: bytes, kind: str, values: np.ndarray, sizes: np.ndarray, undo: bool) -> np.ndarray:
    """A keyed permutation of sequences: values[i] stays in 0..sizes[i]-1. A Feistel network over the two halves of the sequence."""
    start = hashlib.shake_256(hashlib.sha256(key).digest() + hashlib.sha256(kind.encode()).digest() + sizes.astype("<u4").tobytes())
    cut, out = len(values) // 2, values.astype(np.int64)
    halves = (slice(0, cut), slice(cut, len(values)))
    for i in range(ROUNDS)[:: -1 if undo else 1]:
        to, by = halves[i % 2], halves[1 - i % 2]
        h = start.copy()
        h.update(bytes([i]) + out[by].astype("<u4").tobytes())
        stream = np.frombuffer(h.digest(8 * len(out[to])), "<u8") % sizes[to].astype(np.uint64)
        out[to] = (out[to] + (-1 if undo else 1) * stream.astype(np.int64)) % sizes[to]
    return out


@lru_cache(maxsize=1)
def letters() -> dict[str, str]:
    """Character -> its alphabet: of letters that survive a change of case and back, or of those without case."""
    out = dict.fromkeys("0123456789", "0123456789")
    for low, high in SCRIPTS:
        found = [c for c in map(chr, range(low, high)) if c.isalpha() and c.lower() == c and len(c.upper()) == 1 and c.upper().lower() == c]
        for cased in (True, False):
            alphabet = "".join(c for c in found if (c.upper() != c) == cased)
            out |= dict.fromkeys(alphabet, alphabet)
    return out


def lowered(text: str) -> str:
    """Capitals as small letters, where that can be undone."""
    return "".join(c.lower() if len(c.lower()) == 1 and c.lower().upper() == c else c for c in text)


def luhn_digit(body: str) -> str:
    """The digit that makes body + digit pass."""
    total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(int(c) for c in reversed(body)))
    return str(-total % 10)


def luhn(digits: str) -> bool:
    return luhn_digit(digits[:-1]) == digits[-1]


def iban_rest(country_and_digits: str, bban: str) -> int:
    return int("".join(str(int(c, 36)) for c in bban + country_and_digits)) % 97


def relay(layout: str, chars: str, keep: Callable[[str], bool]) -> str:
    """Write chars over those of layout that are no separators."""
    it = iter(chars)
    return "".join(next(it) if keep(c) else c for c in layout)


def recased(layout: str, text: str) -> str:
    return "".join(c.upper() if old.isupper() and len(c.upper()) == 1 else c for old, c in zip(layout, text, strict=True))


class Pseudonyms:
    """The permutation of every kind under one key; ``undo`` gives its inverse."""

    def __init__(self, key: bytes, undo: bool = False):
        self.key, self.undo = key, undo
        self._network = lru_cache(maxsize=4096)(lambda kind, n: Feistel(key, kind, n))

    def permute(self, kind: str, n: int, x: int) -> int:
        f = self._network(kind, n)  # n is bounded: WIDE characters, or the digits of a number
        return f.backward(x) if self.undo else f.forward(x)

    def digits(self, kind: str, digits: str) -> str:
        return f"{self.permute(kind, 10 ** len(digits), int(digits)):0{len(digits)}d}" if digits else ""

    def mixed(self, kind: str, text: str, alphabet: Callable[[str], str]) -> str:
        """Permute in mixed radix: every character within its own alphabet ('' keeps it)."""
        sets = [alphabet(c) for c in text]
        free = [i for i, s in enumerate(sets) if s]
        if len(free) > WIDE:
            values, sizes = np.array([sets[i].index(text[i]) for i in free], np.int64), np.array([len(sets[i]) for i in free], np.int64)
            chars = list(text)
            for i, v in zip(free, shifted(self.key, kind, values, sizes, self.undo).tolist(), strict=True):
                chars[i] = sets[i][v]
            return "".join(chars)
        n, x = 1, 0
        for c, s in zip(text, sets, strict=True):
            if s:
                n, x = n * len(s), x * len(s) + s.index(c)
        if n == 1:
            return text
        y, out = self.permute(f"{kind}/{','.join(str(len(s)) for s in sets)}", n, x), []
        for c, s in zip(reversed(text), reversed(sets), strict=True):
            if s:
                y, r = divmod(y, len(s))
                c = s[r]
            out.append(c)
        return "".join(reversed(out))

    # Each kind returns the pseudonym, or None where validation fails.
    def card(self, v: str) -> tuple[str, str] | None:
        d = "".join(c for c in v if c.isdigit())
        if not luhn(d):
            return None
        body = self.digits("card", d[:-1])
        return "card", relay(v, body + luhn_digit(body), str.isdigit)

    def phone(self, v: str) -> tuple[str, str] | None:
        d = "".join(c for c in v if c.isdigit())
        if not 9 <= len(d) <= 15:
            return None
        code = len(re.match(r"\+(\d{1,3})(?=\D)|", v).group(1) or "")
        return "phone", relay(v, d[:code] + self.digits("phone", d[code:]), str.isdigit)

    def ssn(self, v: str) -> tuple[str, str] | None:
        good = lambda d: d[:3] not in ("000", "666") and d[0] != "9" and d[3:5] != "00" and d[5:] != "0000"
        d = v.replace("-", "")
        if not good(d):
            return None
        d = self.digits("ssn", d)
        while not good(d):
            d = self.digits("ssn", d)
        return "ssn", relay(v, d, str.isdigit)

    def ip(self, v: str) -> tuple[str, str] | None:
        parts = v.split(".")
        if any(int(p) > 255 or (len(p) > 1 and p[0] == "0") for p in parts):
            return None
        # Octets stay as long as they are written.
        ranges = [{1: (0, 10), 2: (10, 90), 3: (100, 156)}[len(p)] for p in parts]
        n, x = 1, 0
        for p, (low, size) in zip(parts, ranges, strict=True):
            n, x = n * size, x * size + int(p) - low
        y, out = self.permute(f"ip/{'.'.join(str(len(p)) for p in parts)}", n, x), []
        for low, size in reversed(ranges):
            y, r = divmod(y, size)
            out.append(str(low + r))
        return "ip", ".".join(reversed(out))

    def date(self, v: str) -> tuple[str, str] | None:
        a, b, c = re.split(r"[./-]", v)
        year_first = len(a) == 4
        orders = [("ymd", (a, b, c))] if year_first else [("dmy", (c, b, a)), ("mdy", (c, a, b))]
        for name, (y, m, d) in orders:
            try:
                day = datetime.date(int(y), int(m), int(d)).toordinal()
            except ValueError:
                continue
            if not FIRST <= day <= LAST:
                return None
            new = datetime.date.fromordinal(FIRST + self.permute("date", LAST - FIRST + 1, day - FIRST))
            # Day first unless only month first was possible; the pseudonym keeps to the same reading.
            while name == "mdy" and new.day <= 12:
                new = datetime.date.fromordinal(FIRST + self.permute("date", LAST - FIRST + 1, new.toordinal() - FIRST))
            parts = {"y": f"{new.year:04d}", "m": f"{new.month:02d}", "d": f"{new.day:02d}"}
            return "date", (v[4] if year_first else v[2]).join(parts[k] for k in name)
        return None

    def iban(self, v: str) -> tuple[str, str] | None:
        s = v.replace(" ", "")
        if not 15 <= len(s) <= 34 or iban_rest(s[:4], s[4:]) != 1:
            return None
        bban = self.mixed("iban", s[4:], lambda c: "0123456789" if c.isdigit() else "ABCDEFGHIJKLMNOPQRSTUVWXYZ")
        check = 98 - iban_rest(s[:2] + "00", bban)
        return "iban", relay(v, s[:2] + f"{check:02d}" + bban, lambda c: c != " ")

    def email(self, local: str) -> str:
        known = letters()
        return recased(local, self.mixed("email", lowered(local), lambda c: known.get(c, "")))

    def secret(self, v: str) -> str:
        low = v.lower()
        hexadecimal = re.fullmatch(r"[0-9a-f]+", low) is not None

        def alphabet(c: str) -> str:
            if hexadecimal:
                return "0123456789abcdef"
            return "abcdefghijklmnopqrstuvwxyz" if "a" <= c <= "z" else "0123456789" if "0" <= c <= "9" else ""

        if hexadecimal and low != v and v.upper() != v:  # mixed case carries information of its own
            return "".join(recased(a, b) for a, b in zip(v, self.mixed("secret", low, lambda c: "0123456789" if c.isdigit() else "abcdef"), strict=True))
        new = self.mixed("secret", low, alphabet)
        if hexadecimal:
            return new.upper() if v != low else new
        return recased(v, new)


def number_at(text: str, start: int) -> tuple[int, int]:
    """(start, end) of the card that begins with the row of digits, spaces and hyphens at start; empty if none does, and then end is
    where to go on."""
    runs, at, seen = [], start, 0
    while seen < 20 and (m := DIGITS.match(text, at)):  # further digits are part of no card that begins here
        runs.append(m.span(1))
        at, seen = m.end(), seen + m.end() - m.start(1)
    first = runs[0]
    if first[1] - first[0] >= 12:  # a number of its own
        return first if first[1] - first[0] <= 19 and luhn(text[slice(*first)]) else (first[1], first[1])
    best, digits = None, ""
    for a, b in runs:
        if b - a >= 12 or len(digits) + b - a > 19:
            break
        digits += text[a:b]
        if len(digits) >= 12 and luhn(digits):
            best = b
    return (first[0], best) if best else (first[1], first[1])


def finds(text: str, p: Pseudonyms) -> list[tuple[int, int, str, str]]:
    """(start, end, kind, pseudonym), in order and without overlaps; whole texts are scanned."""
    out: list[tuple[int, int, str, str]] = []
    if SECRET_HINT.search(text):
        out += [(m.start(1), m.end(1), "secret", p.secret(m[1])) for m in SECRET.finditer(text)]
    if HINT.search(text):
        at, floor = text.find("@"), 0
        while at >= 0:
            start = at
            while start > floor and LOCAL.match(text[start - 1]):
                start -= 1
            while start < at and text[start] in ".%+-":
                start += 1
            domain = DOMAIN.match(text, at + 1)
            if domain and start < at:
                out.append((start, at, "email", p.email(text[start:at])))
                floor = domain.end()
            else:
                floor = at + 1
            at = text.find("@", at + 1)
        at = 0
        while m := NUMBER.search(text, at):
            kind = next(k for k in KINDS if m[k] is not None)
            start, at = m.span()
            found = None
            if kind == "card":
                start, at = number_at(text, start)
                found = p.card(text[start:at]) if start < at else None
            elif kind == "iban":
                while at > start and not (found := p.iban(text[start:at])):
                    at = text.rfind(" ", start, at)
                if not found:  # go on behind the letters
                    at = start + 2
            else:
                found = getattr(p, kind)(m.group())
            if found:
                out.append((start, at, *found))
    out.sort(key=lambda x: (x[0], -x[1]))
    kept, floor = [], 0
    for x in out:
        if x[0] >= floor:
            kept.append(x)
            floor = x[1]
    return kept


def replaced(text: str, found: list[tuple[int, int, str, str]]) -> str:
    parts, at = [], 0
    for start, end, _, new in found:
        parts += [text[at:start], new]
        at = end
    return "".join([*parts, text[at:]])


SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("kind", pa.string())]))


def pseudonymise(docs: DataFrame, key: bytes, spans: str | None = None, undo: bool = False) -> DataFrame:
    """docs with pseudonyms in the text; with ``spans``, also an array of (start, end, kind) in code points under that name."""
    docs = docs.drop(spans) if spans else docs
    names = docs.columns
    where = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key, undo)
        for batch in batches:
            for i in range(0, batch.num_rows, 512):
                part = batch.slice(i, 512)
                column = part.column(where).to_pylist()
                found = [finds(t, p) if t else [] for t in column]
                new = [replaced(t, f) if f else t for t, f in zip(column, found, strict=True)]
                out = [*part.columns]
                out[where] = pa.array(new, pa.string())
                if spans:
                    out.append(pa.array([[{"start": a, "end": b, "kind": k} for a, b, k, _ in f] for f in found], SPANS))
                yield pa.RecordBatch.from_arrays(out, names=[f"c{j}" for j in range(len(out))])

    schema = docs.schema
    fields = [f"`c{j}` {f.dataType.simpleString()}" for j, f in enumerate(schema.fields)]
    if spans:
        fields.append(f"`c{len(names)}` array<struct<start:int,end:int,kind:string>>")
    return docs.toDF(*[f"c{j}" for j in range(len(names))]).mapInArrow(run, ", ".join(fields)).toDF(*names, *([spans] if spans else []))


def op4_pii_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, the pseudonymised text, n_finds and the finds (start, end, kind)."""
    from pyspark.sql import functions as F

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = pseudonymise(docs, SAMPLE_KEY, spans="finds")
    return out.select("doc_id", "text", F.size("finds").cast("long").alias("n_finds"), "finds")

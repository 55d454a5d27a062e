"""Format-preserving pseudonyms: validated numbers and dates go through a keyed Feistel network over their own format."""

import hashlib
import hmac
import re
from collections.abc import Iterator
from datetime import date, timedelta

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import boxed

ROUNDS = 10


class Feistel:
    """Keyed permutation of range(n): an unbalanced Feistel network over residues (a, b) with a * b >= n, walked until it is inside."""

    def __init__(self, key: bytes, tweak: str, n: int) -> None:
        self.n, self.a = n, max(1, int(n**0.5))
        while self.a * self.a < n:
            self.a += 1
        self.b = -(-n // self.a)
        self.key = hmac.new(key, f"{tweak}|{n}".encode(), hashlib.sha256).digest()

    def _f(self, i: int, x: int) -> int:
        return int.from_bytes(hashlib.blake2b(b"%d|%d" % (i, x), key=self.key, digest_size=16).digest(), "big")

    def encrypt(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in range(ROUNDS):
                if i % 2:
                    right = (right + self._f(i, left)) % self.b
                else:
                    left = (left + self._f(i, right)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x

    def decrypt(self, x: int) -> int:
        while True:
            left, right = divmod(x, self.b)
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    right = (right - self._f(i, left)) % self.b
                else:
                    left = (left - self._f(i, right)) % self.a
            x = left * self.b + right
            if x < self.n:
                return x


def luhn(digits: str) -> int:
    """Check digit for digits."""
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + (i % 2 == 0))
        total += d - 9 * (d > 9)
    return -total % 10


def _iban(country: str, rest: str) -> str:
    n = int("".join(str(int(c, 36)) for c in rest + country + "00"))
    return f"{98 - n % 97:02d}"


_DAY0 = date(1900, 1, 1)
_DAYS = (date(2100, 1, 1) - _DAY0).days

#: Kinds in the order in which they are tried, and what each looks like; validation follows in Pseudonyms.
KINDS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}(?![\w-])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![\d.,/-])(?:(?:19|20)\d\d([-/.])(?:0?[1-9]|1[0-2])\1(?:0?[1-9]|[12]\d|3[01])|(?:0?[1-9]|[12]\d|3[01])([-/.])(?:0?[1-9]|[12]\d|3[01])\2(?:19|20)\d\d)(?![\d/-]|[.,]\d)",
    "ip": r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)",
    "ssn": r"(?<![\d-])(?!000|666|9\d\d)\d{3}-(?!00)\d\d-(?!0000)\d{4}(?![\d-])",
    "card": r"(?<![\dA-Za-z+.,-])[2-6]\d{3}(?:[ -]?\d){9,15}(?![\dA-Za-z])",
    "phone": r"(?<![\w+.,-])(?:\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d(?:[ .-]?\d){5,11}|\(\d{3}\) ?\d{3}[ .-]\d{4}|\d{3}([ .-])\d{3}\3\d{4})(?![\w-])",
}
_PATTERN = re.compile("|".join(f"(?P<{k}>{v})" for k, v in KINDS.items()).replace(r"\1", "(?P=d1)").replace(r"\2", "(?P=d2)").replace(r"\3", "(?P=d3)").replace(r"\d\d([-/.])", r"\d\d(?P<d1>[-/.])", 1).replace(r"3[01])([-/.])", r"3[01])(?P<d2>[-/.])", 1).replace(r"\d{3}([ .-])", r"\d{3}(?P<d3>[ .-])", 1))
#: A text that this finds nothing in has no value of any kind.
_HINT = re.compile(r"[A-Za-z0-9]@[A-Za-z0-9]|\d[^\d\n]{0,3}\d[^\d\n]{0,3}\d[^\d\n]{0,3}\d")


class Pseudonyms:
    """Finds validated values and permutes them under a key, within their format.

    Equal values (whatever their separators) get equal pseudonyms of the same kind, and no value of a kind is shared by two.
    Cards keep length, first digit and a valid check digit; IBANs country, letters' places and valid check digits; phone
    numbers the country code; IPv4 addresses are permuted within 2**32; dates within 1900 to 2099, in their own notation (month first with a day
    that would be read as a month gets the year first, on the way back too: the day is told, not how it was written);
    SSNs within the valid numbers; e-mail local parts letter for letter and digit for digit, with the domain kept."""

    def __init__(self, key: bytes) -> None:
        self.key, self._cache = key, {}

    def cipher(self, tweak: str, n: int) -> Feistel:
        if (tweak, n) not in self._cache:
            if len(self._cache) > 10_000:
                self._cache.clear()
            self._cache[tweak, n] = Feistel(self.key, tweak, n)
        return self._cache[tweak, n]

    def digits(self, tweak: str, d: str, back: bool = False) -> str:
        c = self.cipher(tweak, 10 ** len(d))
        return str((c.decrypt if back else c.encrypt)(int(d))).zfill(len(d)) if d else d

    def value(self, kind: str, s: str, back: bool = False) -> str | None:
        """The pseudonym of s (or the value of a pseudonym), or None if s is not valid for its kind."""
        return getattr(self, "_" + kind)(s, back)

    def _fill(self, s: str, d: str) -> str:
        it = iter(d)
        return "".join(next(it) if c.isdecimal() else c for c in s)

    def _card(self, s: str, back: bool) -> str | None:
        d = re.sub(r"[ -]", "", s)
        if not 13 <= len(d) <= 19 or luhn(d[:-1]) != int(d[-1]):
            return None
        body = d[0] + self.digits(f"card{len(d)}{d[0]}", d[1:-1], back)
        return self._fill(s, body + str(luhn(body)))

    def _phone(self, s: str, back: bool) -> str | None:
        d = re.sub(r"\D", "", s)
        if not 7 <= len(d) <= 15:
            return None
        code = s[0] == "+" or (len(d) == 11 and d[0] == "1")
        keep = (1 if d[0] in "17" else 2 if d[:2] in _TWO else 3) if code else 0
        n = d[keep:]
        if len(n) == 10 and (d[:keep] in ("", "1")):  # exchange numbers start with 2 to 9
            if n[0] in "01" or n[3] in "01":  # no valid number: stays among those, and without a country code is none at all
                if not code:
                    return None
                n = self.digits("phone+1-", n, back)
                while n[0] not in "01" and n[3] not in "01":
                    n = self.digits("phone+1-", n, back)
                return self._fill(s, d[:keep] + n)
            x = ((int(n[0]) - 2) * 100 + int(n[1:3])) * 8_000_000 + (int(n[3]) - 2) * 1_000_000 + int(n[4:])
            c = self.cipher("phone+1", 6_400_000_000)
            x = c.decrypt(x) if back else c.encrypt(x)
            area, local = divmod(x, 8_000_000)
            return self._fill(s, f"{d[:keep]}{area + 200:03d}{local + 2_000_000:07d}")
        return self._fill(s, d[:keep] + self.digits(f"phone+{d[:keep]}", n, back))

    def _ip(self, s: str, back: bool) -> str | None:
        parts = s.split(".")
        if any(len(p) > 1 and p[0] == "0" for p in parts):
            return None
        x = int.from_bytes(bytes(map(int, parts)), "big")
        c = self.cipher("ip", 1 << 32)
        return ".".join(map(str, (c.decrypt if back else c.encrypt)(x).to_bytes(4, "big")))

    def _ssn(self, s: str, back: bool) -> str | None:
        a, g, n = map(int, s.split("-"))
        a -= 1 + (a > 666)
        c = self.cipher("ssn", 898 * 99 * 9999)
        x = (c.decrypt if back else c.encrypt)((a * 99 + g - 1) * 9999 + n - 1)
        x, n = divmod(x, 9999)
        a, g = divmod(x, 99)
        a += 1
        return f"{a + (a >= 666):03d}-{g + 1:02d}-{n + 1:04d}"

    def _date(self, s: str, back: bool) -> str | None:
        sep = re.search(r"[-/.]", s)[0]
        p = s.split(sep)
        first = len(p[0]) == 4
        y, m, d = (p if first else p[::-1])
        swap = not first and int(m) > 12
        if swap:
            m, d = d, m
        try:
            x = (date(int(y), int(m), int(d)) - _DAY0).days
        except ValueError:
            return None
        c = self.cipher("date", _DAYS)
        t = _DAY0 + timedelta((c.decrypt if back else c.encrypt)(x))
        if swap and t.day <= 12:  # month first would be read as day first: the year comes first instead
            first, p = True, [p[2], p[0], p[1]]
        wide = len(p[0] if first else p[2]), all(len(x) == 2 for x in (p[1:] if first else p[:2]))
        m, d = (f"{t.month:02d}", f"{t.day:02d}") if wide[1] else (str(t.month), str(t.day))
        out = [f"{t.year:04d}", m, d] if first else [m, d, f"{t.year:04d}"] if swap else [d, m, f"{t.year:04d}"]
        return sep.join(out)

    def _iban(self, s: str, back: bool) -> str | None:
        d = s.replace(" ", "")
        if not 15 <= len(d) <= 34 or _iban(d[:2], d[4:]) != d[2:4]:
            return None
        body = self._mixed("iban" + d[:2], d[4:], back)
        it = iter(d[:2] + _iban(d[:2], body) + body)
        return "".join(c if c == " " else next(it) for c in s)

    def _mixed(self, tweak: str, s: str, back: bool) -> str:
        """Permutes digits among digits, and letters among letters of their case, over the whole string at once."""
        radix = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in s]
        base = [48 if c.isdigit() else 97 if c.islower() else 65 if c.isalpha() else ord(c) for c in s]
        n, x = 1, 0
        for c, r, b in zip(s, radix, base, strict=True):
            n, x = n * r, x * r + ord(c) - b
        c = self.cipher(f"{tweak}|{''.join(map(chr, base))}", n)
        x = (c.decrypt if back else c.encrypt)(x)
        out = []
        for r, b in zip(reversed(radix), reversed(base), strict=True):
            x, v = divmod(x, r)
            out.append(chr(b + v))
        return "".join(reversed(out))

    def _email(self, s: str, back: bool) -> str | None:
        local, _, domain = s.rpartition("@")
        return f"{self._mixed('email', local, back)}@{domain}"

    def text(self, t: str, back: bool = False) -> tuple[str, list[tuple[str, str, str, int]]]:
        """The text with pseudonyms, and (kind, value, pseudonym, place in the old text) of each."""
        if not _HINT.search(t):
            return t, []
        found, out, last, at = [], [], 0, 0
        while m := _PATTERN.search(t, at):
            kind, s = m.lastgroup, m[0]
            for kind in KINDS:
                if m[kind] is not None:
                    break
            new = self.value(kind, s, back)
            if new is None:
                at = m.start() + 1
                while at < m.end() and t[at - 1].isalnum() and t[at].isalnum():
                    at += 1
                continue
            out += [t[last : m.start()], new]
            found.append((kind, s, new, m.start()))
            last = at = m.end()
        return "".join([*out, t[last:]]) if found else t, found


#: Calling codes of two digits; 1 and 7 have one, all others three.
_TWO = frozenset("20 27 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 81 82 84 86 90 91 92 93 94 95 98".split())
SPANS = "array<struct<kind:string,start:long,pseudonym:string>>"


def pseudonymise(docs: DataFrame, key: bytes, text: str = "text", spans: str | None = "pii") -> DataFrame:
    """docs with each validated value in `text` replaced, and (unless spans is None) their kinds, places and pseudonyms in `spans`.

    The places are code points of the old text. Null and empty texts stay as they are; all rows and columns stay; a column
    named as `spans` is replaced. Each row stands alone, so nothing is shuffled and lost tasks are simply run again."""
    rows = boxed(docs, (spans,) if spans else (), _text=F.col(text))
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("pseudonym", pa.string())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = Pseudonyms(key)
        for b in batches:
            new, found = [], []
            for v in b.column(1):
                t = v.as_py()
                out, seen = p.text(t) if t else (t, [])
                new.append(out)
                found.append([{"kind": k, "start": at, "pseudonym": s} for k, _, s, at in seen])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(new, pa.string()), pa.array(found, kind)], ["row", "new", "found"])

    shape = rows.select("row", F.lit(None).cast("string").alias("new"), F.lit(None).cast(SPANS).alias("found")).schema
    done = rows.mapInArrow(run, shape)
    named = [c for c in rows.schema["row"].dataType.names]
    cols = [F.col("new").alias(c) if c.lower() == text.lower() else F.col("row")[c].alias(c) for c in named]
    return done.select(*cols, *([F.col("found").alias(spans)] if spans else []))

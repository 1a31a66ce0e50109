"""Format-preserving pseudonyms for personal data by a keyed Feistel network.

Numbers that pass their validation (Luhn, mod 97, octets, number plans), dates that exist, e-mail
names and secrets are read as an integer within their format's domain, permuted by a keyed
Feistel network on that domain (cycle walking stays inside it), and written back in the same layout.
The permutation depends on the key and the kind alone, so equal values stay linked across documents,
different values stay different, and the key's holder can invert it. Layout (brackets, separators,
letter case) does not change a value: one phone number written in two ways keeps one pseudonym.

Texts without a digit, an @ or a word that announces a secret pass through untouched; nothing is shuffled.

Kept in clear by design: an e-mail's domain, a card's first digit, a foreign number's first two digits, an
IBAN's country, prefixes that name a kind of key. Not looked for: names, postal addresses, IPv6 addresses,
dates with months in words, numbers dialled with 00.
"""

from __future__ import annotations

import datetime
import hashlib
import math
import re
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, lean


ROUNDS = 8
#: Longer values are permuted in blocks of so many characters.
BLOCK = 256
#: For the registered queries. Give a secret of your own in production.
EXAMPLE_KEY = b"trivane example key"


class Feistel:
    """A keyed permutation of 0 .. size - 1 for any size, and its inverse."""

    def __init__(self, key: bytes, tweak: str, size: int):
        self.size = size
        self.a = math.isqrt(max(0, size - 1)) + 1
        self.b = -(-size // self.a)
        self.keys = [hashlib.blake2b(f"{tweak}/{size}/{i}".encode(), key=hashlib.sha256(key).digest(), digest_size=32).digest() for i in range(ROUNDS)]
        self.bytes = (size.bit_length() + 7) // 8 + 8

    def _f(self, i: int, x: int, modulus: int) -> int:
        data, out, k = x.to_bytes(self.bytes, "big"), b"", 0
        while len(out) < self.bytes:
            out += hashlib.blake2b(data + bytes([k]), key=self.keys[i], digest_size=64).digest()
            k += 1
        return int.from_bytes(out[: self.bytes], "big") % modulus

    def permute(self, x: int) -> int:
        while True:
            low, high = x % self.a, x // self.a
            for i in range(ROUNDS):
                if i % 2:
                    high = (high + self._f(i, low, self.b)) % self.b
                else:
                    low = (low + self._f(i, high, self.a)) % self.a
            x = high * self.a + low
            if x < self.size:
                return x

    def invert(self, x: int) -> int:
        while True:
            low, high = x % self.a, x // self.a
            for i in reversed(range(ROUNDS)):
                if i % 2:
                    high = (high - self._f(i, low, self.b)) % self.b
                else:
                    low = (low - self._f(i, high, self.a)) % self.a
            x = high * self.a + low
            if x < self.size:
                return x


def luhn_digit(payload: str) -> int:
    """The check digit that completes ``payload``."""
    total = 0
    for i, c in enumerate(reversed(payload)):
        v = int(c) * (2 if i % 2 == 0 else 1)
        total += v - 9 if v > 9 else v
    return -total % 10


def iban_valid(s: str) -> bool:
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


#: Characters of an IBAN by country: where groups of four end if more words follow.
IBAN_LENGTH = {c[:2]: int(c[2:]) for c in (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BI27 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DJ27 DK18 DO28 EE20 EG29 ES24 FI18 FK18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 "
    "HR21 HU28 IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MN20 MR27 MT31 MU30 NI28 NL18 NO15 OM23 PK24 PL28 PS29 PT25 "
    "QA29 RO24 RS22 RU33 SA24 SC31 SD18 SE24 SI19 SK24 SM27 SO23 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20 YE30").split()}


def iban_end(s: str) -> int:
    """Where the IBAN ends at whose start ``s`` is: groups of four may have taken in words after it."""
    words = s.split(" ")
    ends = [len(" ".join(words[:k])) for k in range(len(words), 0, -1)] if len(words) > 1 else [len(s)]
    known = IBAN_LENGTH.get(s[:2])
    for end in ends:
        plain = s[:end].replace(" ", "")
        if len(plain) == known if known and len(words) > 1 else len(plain) >= 15:
            if iban_valid(plain):
                return end
    return len(s)


def _refill(layout: str, digits: str) -> str:
    """``digits`` in the places of the digits of ``layout``."""
    rest = iter(digits)
    return "".join(next(rest) if c.isdigit() else c for c in layout)


def _hostable(n: int) -> bool:
    """Whether an IPv4 address is an ordinary public one."""
    a, b = n >> 24, n >> 16 & 255
    return 1 <= a <= 223 and a not in (10, 127) and (a, b) not in ((169, 254), (192, 168)) and not (a == 172 and 16 <= b <= 31)


FIRST_DAY, DAYS = datetime.date(1900, 1, 1).toordinal(), datetime.date(2100, 1, 1).toordinal() - datetime.date(1900, 1, 1).toordinal()

SECRET_WORD = r"(?i:password|passwd|pwd|token|secret|api[_-]?key|access[_-]?key)"
#: (kind, pattern) in order of precedence; the group named v, or the whole match, is replaced.
PATTERNS = [
    ("email", r"(?<![A-Za-z0-9._%+-])(?P<v>[A-Za-z0-9._%+-]++)@[A-Za-z0-9-]{1,63}(?:\.[A-Za-z0-9-]{1,63}){1,8}"),
    ("secret", SECRET_WORD + r"[\"']?[ \t]{0,4}[=:][ \t]{0,4}[\"']?(?P<v>[A-Za-z0-9_+/.-]{6,})"),
    ("access_key", r"(?<![A-Za-z0-9])AKIA(?P<v>[A-Z0-9]{16})(?![A-Za-z0-9])"),
    ("token", r"(?<![A-Za-z0-9_-])(?:gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|sk-|sk_live_|sk_test_)(?P<v>[A-Za-z0-9_-]{16,})"),
    ("iban", r"(?<![A-Za-z0-9])[A-Z]{2}\d{2}(?:[A-Z0-9]{11,30}|(?: [A-Z0-9]{4}){2,7}(?: [A-Z0-9]{1,3})?)(?![A-Za-z0-9])"),
    ("ip", r"(?<![\w.])(?:\d{1,3}\.){3}\d{1,3}(?!\w|\.\d)"),
    ("date", r"(?<![\w.-])\d{4}-\d{2}-\d{2}(?=[Tt]\d{2}|(?![\w-]))|(?<![\w./-])\d{4}/\d{1,2}/\d{1,2}(?=[Tt]\d{2}|(?![\w/]))|(?<![\w./])\d{1,2}\.\d{1,2}\.\d{4}(?!\w|\.\d)|(?<![\w./])\d{1,2}/\d{1,2}/\d{4}(?![\w/])"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("card", r"(?<![\w-])(?:\d{13,19}|\d{4}(?P<x>[ -])\d{4}(?P=x)\d{4}(?P=x)\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\w-])"),
    ("phone", r"(?<![\w+])(?:\+?1[ .-]?\(?[2-9]\d{2}\)?[ .-]?|\([2-9]\d{2}\)[ .-]?|[2-9]\d{2}[ .-])[2-9]\d{2}[ .-]?\d{4}(?!\w)"),
    ("phone_abroad", r"(?<![\w+])\+[2-9]\d{0,2}(?:[ .-]?\(?\d{1,5}\)?){2,6}(?!\w)"),
]


class Pseudonyms:
    """Pseudonyms under one key."""

    def __init__(self, key: bytes = EXAMPLE_KEY, patterns=None):
        self.key = key
        self.patterns = [(kind, re.compile(p)) for kind, p in (patterns or PATTERNS)]
        self.network = lru_cache(512)(lambda kind, size: Feistel(key, kind, size))

    def _digits(self, kind: str, digits: str) -> str:
        return str(self.network(kind, 10 ** len(digits)).permute(int(digits))).zfill(len(digits))

    def _classes(self, kind: str, s: str) -> str:
        """Digits and letters permuted as one number, each place staying in its class; case is kept.

        Blocks of a longer value are chained forwards, then backwards: every block depends on all of it.
        """
        hexed = kind == "secret" and len(s) >= 8 and re.fullmatch(r"[0-9a-f]*[a-f][0-9a-f]*", s) is not None
        if len(s) <= BLOCK:
            return self._block(kind, s, hexed)
        parts = [s[i : i + BLOCK] for i in range(0, len(s), BLOCK)]
        for way in (1, -1):
            before = ""
            for i in range(len(parts))[::way]:
                parts[i] = self._block(f"{kind} {len(s)} {way} {i} {before}", parts[i], hexed)
                before = parts[i].lower()
        return "".join(parts)

    def _block(self, kind: str, s: str, hexed: bool) -> str:
        if hexed:
            return format(self.network(f"{kind} hex", 16 ** len(s)).permute(int(s, 16)), "x").zfill(len(s))
        x, size = 0, 1
        sizes = [10 if c.isdigit() else 26 if c.isalpha() else 1 for c in s]
        for c, n in zip(s.lower(), sizes, strict=True):
            x, size = x * n + (int(c) if n == 10 else ord(c) - 97 if n == 26 else 0), size * n
        layout = "".join("9" if n == 10 else "a" if n == 26 else c for c, n in zip(s, sizes, strict=True))
        x, out = self.network(f"{kind} {layout}", size).permute(x), []
        for c, n in zip(reversed(s), reversed(sizes), strict=True):
            x, y = divmod(x, n)
            y = str(y) if n == 10 else chr(97 + y) if n == 26 else c
            out.append(y.upper() if c.isupper() else y)
        return "".join(reversed(out))

    def value(self, kind: str, s: str) -> str | None:
        """The pseudonym of a matched value, or None if it is no valid one."""
        digits = re.sub(r"\D", "", s)
        if kind in ("email", "secret", "access_key", "token"):
            return self._classes(kind, s) if any(c.isalnum() for c in s) else None
        if kind == "card":
            if luhn_digit(digits[:-1]) != int(digits[-1]) or not digits.strip("0"):
                return None
            new = digits[0] + self._digits(f"card {digits[0]}", digits[1:-1])
            return _refill(s, new + str(luhn_digit(new)))
        if kind == "iban":
            plain = s.replace(" ", "")
            if not iban_valid(plain):
                return None
            body = self._classes(f"iban {s[:2]}", plain[4:])
            check = 98 - int("".join(str(int(c, 36)) for c in body + s[:2] + "00")) % 97
            new = iter(f"{s[:2]}{check:02d}{body}")
            return "".join(c if c == " " else next(new) for c in s)
        if kind == "ip":
            parts = s.split(".")
            if any(int(p) > 255 or len(p) > 1 and p[0] == "0" for p in parts):
                return None
            n = int.from_bytes(bytes(map(int, parts)), "big")
            if not _hostable(n):
                return None
            n = self.network("ip", 1 << 32).permute(n)
            while not _hostable(n):
                n = self.network("ip", 1 << 32).permute(n)
            return ".".join(map(str, n.to_bytes(4, "big")))
        if kind == "ssn":
            area, group, serial = int(digits[:3]), int(digits[3:5]), int(digits[5:])
            if area in (0, 666) or area >= 900 or not group or not serial:
                return None
            areas = [*range(1, 666), *range(667, 900)]
            x = self.network("ssn", len(areas) * 99 * 9999).permute((areas.index(area) * 99 + group - 1) * 9999 + serial - 1)
            x, serial = divmod(x, 9999)
            area, group = divmod(x, 99)
            return f"{areas[area]:03d}-{group + 1:02d}-{serial + 1:04d}"
        if kind == "phone":
            n = digits[-10:]
            x = self.network("phone", 800 * 800 * 10_000).permute(((int(n[:3]) - 200) * 800 + int(n[3:6]) - 200) * 10_000 + int(n[6:]))
            x, line = divmod(x, 10_000)
            area, exchange = divmod(x, 800)
            return _refill(s, f"{digits[:-10]}{area + 200}{exchange + 200}{line:04d}")
        if kind == "phone_abroad":
            return _refill(s, digits[:2] + self._digits(f"phone {digits[:2]}", digits[2:])) if 8 <= len(digits) <= 15 else None
        if kind == "date":
            sep = "-" if "-" in s else "." if "." in s else "/"
            p = [int(x) for x in s.split(sep)]
            first = s.index(sep) == 4  # the year
            turned = sep == "." or sep == "/" and not first and p[0] > 12  # day before month
            y, m, d = p if first else (p[2], p[1], p[0]) if turned else (p[2], p[0], p[1])
            try:
                x = datetime.date(y, m, d).toordinal() - FIRST_DAY
            except ValueError:
                return None
            if not 0 <= x < DAYS:
                return None
            # Days above 12 stay above 12, so that a slash date is read back in the order it was written in.
            t = datetime.date.fromordinal(self.network("date", DAYS).permute(x) + FIRST_DAY)
            while (t.day > 12) != (d > 12):
                t = datetime.date.fromordinal(self.network("date", DAYS).permute(t.toordinal() - FIRST_DAY) + FIRST_DAY)
            if sep == "-":
                return t.isoformat()
            one, two = (t.day, t.month) if turned else (t.month, t.day)
            pair = f"{one:02d}{sep}{two:02d}" if len(s) == 10 else f"{one}{sep}{two}"
            return f"{t.year}{sep}{pair}" if first else f"{pair}{sep}{t.year}"
        raise ValueError(kind)

    def rewrite(self, text: str) -> tuple[str, list[tuple[str, int, int]]]:
        """The text with pseudonyms, and (kind, start, end) in the old text of what was replaced."""
        found: list[tuple[int, int, str, str]] = []  # disjoint, in order
        digit = any(c in text for c in "0123456789")
        for kind, pattern in self.patterns:
            if kind == "email" and "@" not in text or kind not in ("email", "secret", "access_key", "token") and not digit:
                continue
            for m in pattern.finditer(text):
                a, b = m.span("v") if "v" in pattern.groupindex else m.span()
                b = a + iban_end(text[a:b]) if kind == "iban" else b
                k = bisect_left(found, (b,))
                if (not k or found[k - 1][1] <= a) and (new := self.value(kind, text[a:b])) is not None:
                    found.insert(k, (a, b, kind, new))
        if not found:
            return text, []
        out, at = [], 0
        for a, b, _, new in found:
            out += [text[at:a], new]
            at = b
        return "".join(out) + text[at:], [(kind, a, b) for a, b, kind, _ in found]


def pseudonymise(docs: DataFrame, key: bytes = EXAMPLE_KEY, make: Callable[[bytes], Pseudonyms] = Pseudonyms) -> DataFrame:
    """``docs`` with texts rewritten, and n_pii, pii_kinds (distinct, sorted, comma-joined; '' if none).

    A null text stays null, an empty one empty; a text without personal data does not change. Equal rows
    stay equal. Columns of ``docs`` named n_pii or pii_kinds are replaced; an empty table stays empty.
    """
    bound_batches(docs.sparkSession)
    keep = docs.drop("n_pii", "pii_kinds")
    schema = keep.withColumn("n_pii", F.lit(0)).withColumn("pii_kinds", F.lit("")).schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        p = make(key)
        for b in batches:
            k = b.schema.get_field_index("text")
            col = b.column(k)
            touch = pc.fill_null(pc.match_substring_regex(col, r"[0-9@]|[Pp][Aa][Ss][Ss][Ww]|[Pp][Ww][Dd]|[Tt][Oo][Kk][Ee][Nn]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Kk][Ee][Yy]|AKIA|gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|sk[-_]"), False).to_pylist()
            n, kinds, new = [0] * b.num_rows, [""] * b.num_rows, []
            for i in [i for i, t in enumerate(touch) if t]:
                text, spans = p.rewrite(col[i].as_py())
                n[i], kinds[i] = len(spans), ",".join(sorted({s[0] for s in spans}))
                new.append(text)
            col = pc.replace_with_mask(col, pa.array(touch), pa.array(new, col.type)) if new else col
            cols = [col if i == k else c for i, c in enumerate(b.columns)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(n, pa.int32()), pa.array(kinds, pa.string())], names=[*b.schema.names, "n_pii", "pii_kinds"])

    return keep.mapInArrow(lean(run), schema)


def op9_pii(spark, sf_dir):
    return pseudonymise(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))

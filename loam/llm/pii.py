"""Format-preserving pseudonyms for personal data.

E-mail addresses, phone, payment-card, bank-account and social-security numbers, IPv4
addresses and calendar dates are found by pattern and validated (check digits, ranges,
calendar).  The valid values of a format are numbered from 0 to N - 1, and a keyed
Feistel network permutes these numbers (walking on while it leaves the range), so a
pseudonym is valid in the same format, equal values have equal pseudonyms in every
document, different values different ones, and who holds the key can turn them back.

Formats keep their separators, letter case, lengths and (phone, bank account) country
codes; check digits are worked out anew; a date keeps its style, and one day has one
pseudonym in all styles.  Texts are handled whole and one by one, without a shuffle.
"""

from __future__ import annotations

import datetime
import hashlib
import re
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import unused

ROUNDS = 10
#: Days that dates are permuted within.
FIRST_DAY, LAST_DAY = datetime.date(1900, 1, 1).toordinal(), datetime.date(2099, 12, 31).toordinal()

KINDS = ("email", "card", "phone", "ssn", "ip", "iban", "date")
MAYBE = re.compile(r"[0-9@]")
OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
PATTERNS = {
    "email": re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}@(?:[A-Za-z0-9](?:[A-Za-z0-9-]{0,61}"
                        r"[A-Za-z0-9])?\.)+[A-Za-z]{2,24}(?![A-Za-z0-9-])"),
    "iban": re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"),
    "card": re.compile(r"(?<![0-9.])(?:[0-9]{13,19}|[0-9]{4}([ -])[0-9]{4}\1[0-9]{4}\1[0-9]{1,7}|"
                       r"[0-9]{4}([ -])[0-9]{6}\2[0-9]{5})(?![0-9])"),
    "phone": re.compile(r"(?<![0-9+])(?:(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-][0-9]{4}"
                        r"|\+(?!1[ .-])[1-9][0-9]{0,2}[ .-](?:\(?[0-9]{1,4}\)?[ .-]?){1,4}[0-9]{2,4}|\+[1-9][0-9]{7,14})(?![0-9])"),
    "ssn": re.compile(r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])"),
    "ip": re.compile(rf"(?<![0-9.])(?:{OCTET}\.){{3}}{OCTET}(?![0-9]|\.[0-9])"),
    "date": re.compile(r"(?<![0-9])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{1,2}([/.])[0-9]{1,2}\1[0-9]{4})(?![0-9])"),
}


def luhn_digit(body: list[int]) -> int:
    """Check digit that follows the digits of ``body``."""
    doubled = [2 * d for d in body[::-2]]
    return -(sum(d - 9 if d > 9 else d for d in doubled) + sum(body[-2::-2])) % 10


def mod97(iban: str) -> int:
    return int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97


class Feistel:
    """Keyed permutations of ranges of integers."""

    def __init__(self, key: bytes, rounds: int = ROUNDS):
        self.key, self.rounds = hashlib.blake2b(key, digest_size=32).digest(), rounds

    def _round(self, tweak: bytes, k: int, half: int, bits: int) -> int:
        data = tweak + bytes([k]) + half.to_bytes((bits + 7) // 8, "big")
        out = hashlib.blake2b(data, key=self.key, digest_size=min(64, (bits + 7) // 8 + 8)).digest()
        while len(out) * 8 < bits:  # wider than one digest
            out += hashlib.blake2b(out + data, key=self.key, digest_size=64).digest()
        return int.from_bytes(out, "big") & ((1 << bits) - 1)

    def permute(self, value: int, n: int, tweak: bytes, back: bool = False) -> int:
        """The image (or pre-image) of value among 0 .. n - 1."""
        if n < 2:
            return value
        bits = ((n - 1).bit_length() + 1) // 2
        tweak = tweak + n.to_bytes((n.bit_length() + 7) // 8, "big")
        order = range(self.rounds - 1, -1, -1) if back else range(self.rounds)
        while True:
            left, right = value >> bits, value & ((1 << bits) - 1)
            for k in order:
                if back:
                    left, right = right ^ self._round(tweak, k, left, bits), left
                else:
                    left, right = right, left ^ self._round(tweak, k, right, bits)
            value = left << bits | right
            if value < n:
                return value


# --- values of each format and their numbers ------------------------------------------------------------------------

@dataclass
class Numbered:
    """A value's number among ``n``, and how to write another number in the value's format."""
    number: int
    n: int
    tweak: bytes
    write: object


def _mixed(chars: str) -> tuple[int, int]:
    """Number of a string among those with a letter for each letter and a digit for each digit."""
    number, n = 0, 1
    for c in chars:
        base, digit = (10, ord(c) - 48) if c.isdigit() else (26, ord(c.lower()) - 97) if c.isalpha() else (1, 0)
        number, n = number * base + digit, n * base
    return number, n


def _unmixed(number: int, like: str) -> str:
    out = []
    for c in reversed(like):
        if c.isdigit():
            number, d = divmod(number, 10)
            out.append(chr(48 + d))
        elif c.isalpha():
            number, d = divmod(number, 26)
            out.append(chr((65 if c.isupper() else 97) + d))
        else:
            out.append(c)
    return "".join(reversed(out))


def _refill(shape: str, digits: str) -> str:
    """Digits of ``shape`` replaced in turn."""
    it = iter(digits)
    return "".join(next(it) if c.isdigit() else c for c in shape)


def _email(s: str) -> Numbered | None:
    body, _, top = s.rpartition(".")
    if ".." in s or body.partition("@")[0].endswith("."):
        return None
    number, n = _mixed(body)
    shape = re.sub(r"[0-9]", "0", re.sub(r"[a-z]", "a", body.lower()))
    return Numbered(number, n, b"email" + shape.encode(), lambda k: f"{_unmixed(k, body)}.{top}")


def _card(s: str) -> Numbered | None:
    digits = [int(c) for c in s if c.isdigit()]
    if not 13 <= len(digits) <= 19 or len(set(digits)) == 1 or luhn_digit(digits[:-1]) != digits[-1]:
        return None
    k = len(digits) - 1

    def write(number: int) -> str:
        body = f"{number:0{k}d}"
        return _refill(s, body + str(luhn_digit([int(c) for c in body])))
    return Numbered(int("".join(map(str, digits[:-1]))), 10 ** k, b"card", write)


# Country codes of one and two digits; all others have three.
COUNTRY_CODES = {"1", "7", *("20 27 28 30 31 32 33 34 36 39 40 41 43 44 45 46 47 48 49 51 52 53 54 55 56 57 58 60 61 62 63 64 65 66 "
                             "81 82 83 84 86 89 90 91 92 93 94 95 98").split()}


def _country(digits: str) -> int:
    """How many digits the country code has."""
    return next((n for n in (1, 2) if digits[:n] in COUNTRY_CODES), 3)


def _phone(s: str) -> Numbered | None:
    digits = re.sub(r"[^0-9]", "", s)
    if s.startswith("+") and not s.startswith("+1"):
        if not 8 <= len(digits) <= 15:
            return None
        lead = len(re.match(r"\+([0-9]+)", s)[1])
        lead = _country(digits) if lead == len(digits) else lead  # written without separators
        rest = digits[lead:]
        return Numbered(int(rest), 10 ** len(rest), b"phone" + digits[:lead].encode(),
                        lambda k: _refill(s, digits[:lead] + f"{k:0{len(rest)}d}"))
    lead, own = digits[:-10], digits[-10:]
    if len(own) != 10 or lead not in ("", "1") or own[0] < "2" or own[3] < "2":
        return None
    area, exchange, line = int(own[:3]) - 200, int(own[3:6]) - 200, int(own[6:])

    def write(k: int) -> str:
        k, last = divmod(k, 10_000)
        a, e = divmod(k, 800)
        return _refill(s, f"{lead}{a + 200}{e + 200}{last:04d}")
    return Numbered((area * 800 + exchange) * 10_000 + line, 800 * 800 * 10_000, b"nanp", write)


def _ssn(s: str) -> Numbered | None:
    area, group, serial = map(int, s.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None

    def write(k: int) -> str:
        k, last = divmod(k, 9999)
        a, g = divmod(k, 99)
        return f"{a + 1 + (a >= 665):03d}-{g + 1:02d}-{last + 1:04d}"
    return Numbered(((area - 1 - (area > 666)) * 99 + group - 1) * 9999 + serial - 1, 898 * 99 * 9999, b"ssn", write)


def _ip(s: str) -> Numbered | None:
    a, b, c, d = map(int, s.split("."))
    return Numbered(a << 24 | b << 16 | c << 8 | d, 1 << 32, b"ip",
                    lambda k: f"{k >> 24}.{k >> 16 & 255}.{k >> 8 & 255}.{k & 255}")


def _iban(s: str) -> Numbered | None:
    flat = s.replace(" ", "")
    if not 15 <= len(flat) <= 34 or mod97(flat) != 1:
        return None
    number, n = _mixed(flat[4:])
    shape = "".join("0" if c.isdigit() else "A" for c in flat[4:])

    def write(k: int) -> str:
        body = _unmixed(k, flat[4:])
        check = 98 - mod97(flat[:2] + "00" + body)
        it = iter(f"{flat[:2]}{check:02d}{body}")
        return "".join(c if c == " " else next(it) for c in s)
    return Numbered(number, n, b"iban" + (flat[:2] + shape).encode(), write)


def _date(s: str) -> Numbered | None:
    parts = re.split(r"[-/.]", s)
    if len(parts[0]) == 4:
        order = "ymd"
    elif "." in s or int(parts[0]) > 12:
        order = "dmy"
    else:  # with slashes the month comes first where it can
        order = "mdy" if int(parts[1]) <= 31 else "dmy"
    at = {c: int(p) for c, p in zip(order, parts)}
    try:
        day = datetime.date(at["y"], at["m"], at["d"]).toordinal()
    except ValueError:
        return None
    if not FIRST_DAY <= day <= LAST_DAY:
        return None
    sep = "-" if "-" in s else "/" if "/" in s else "."
    wide = all(len(p) != 1 for p in parts)

    def write(k: int) -> str:
        d = datetime.date.fromordinal(FIRST_DAY + k)
        two = "{:02d}" if wide else "{:d}"
        new = {"y": f"{d.year:04d}", "m": two.format(d.month), "d": two.format(d.day)}
        style = order
        if sep == "/" and order == "dmy" and d.day <= 12:
            style = "mdy"  # so that it reads back as the same day
        return sep.join(new[c] for c in style)
    return Numbered(day - FIRST_DAY, LAST_DAY - FIRST_DAY + 1, b"date", write)


READERS = {"email": _email, "card": _card, "phone": _phone, "ssn": _ssn, "ip": _ip, "iban": _iban, "date": _date}


def find(text: str) -> list[tuple[int, int, str, Numbered]]:
    """Valid values from left to right, none overlapping (of two the earlier, then the longer)."""
    if not MAYBE.search(text):
        return []
    found = []
    for kind, pattern in PATTERNS.items():
        if kind == "email" and "@" not in text:
            continue
        for m in pattern.finditer(text):
            if value := READERS[kind](m[0]):
                found.append((m.start(), m.end(), kind, value))
    found.sort(key=lambda f: (f[0], -f[1], KINDS.index(f[2])))
    out, end = [], 0
    for f in found:
        if f[0] >= end:
            out.append(f)
            end = f[1]
    return out


def replace(text: str, feistel: Feistel, back: bool = False) -> tuple[str, list[tuple[str, int, int]]]:
    """The text with pseudonyms (or the values behind them), and (kind, start, end) in the given text."""
    parts, spans, at = [], [], 0
    for start, end, kind, v in find(text):
        parts += [text[at:start], v.write(feistel.permute(v.number, v.n, v.tweak, back))]
        spans.append((kind, start, end))
        at = end
    return ("".join(parts) + text[at:] if parts else text), spans


def pseudonymise(docs: DataFrame, secret: bytes, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with ``text`` replaced and ``pii_spans`` (kind, start, end in the old text), in place of a column so named.

    NULL text stays NULL and has no spans; every row is handled by itself, so equal rows
    stay equal.  With ``back`` and the same key, pseudonyms turn into values again.
    """
    schema = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))

    def replaced(texts: pa.Array) -> pa.Array:
        feistel = Feistel(secret)
        new, spans = [], []
        for t in texts:
            t = t.as_py()
            changed, found = replace(t, feistel, back) if t is not None else (None, [])
            new.append(changed)
            spans.append([{"kind": k, "start": a, "end": b} for k, a, b in found])
        return pa.StructArray.from_arrays([pa.array(new, pa.string()), pa.array(spans, schema)], ["text", "spans"])

    out = F.arrow_udf(replaced, "text string, spans array<struct<kind:string,start:int,end:int>>")(F.col(text))
    own = [c for c in docs.columns if c != "pii_spans"]
    name, = unused(docs, "r_")
    return docs.select(*own, out.alias(name)).select(
        *[F.col(f"{name}.text").alias(c) if c == text else F.col(c) for c in own], F.col(f"{name}.spans").alias("pii_spans"))

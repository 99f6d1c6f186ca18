"""Dates written as text: a grammar of formats, told apart by the shape of the text.

A format is a date pattern with or without a time pattern.  The shape of a text has 9 for each of
its digits and A for each letter; every format can only read the texts of certain shapes, made from its pattern by rule.
Whether a column may hold dates at all is one regular expression per value; only formats that
fit all of its shapes are tried on the values.
"""

from __future__ import annotations

import re
from functools import lru_cache
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# ISO stands for the engine's own timestamp text, with all of its parts, fractions and zones.
ISO = "iso"
ISO_WEEK = "iso-week"  # 2024-W05-3
# Patterns tried in this order: a column has the first format that reads all its values, so a
# day-month ambiguity goes to the month unless some value can only start with a day.
DATE_PATTERNS = ("M/d/yyyy", "d/M/yyyy", "d.M.yyyy", "yyyy/M/d", "yyyy.M.d", "M-d-yyyy", "d-M-yyyy", "d MMM yyyy", "MMM d, yyyy",
                 "MMM d yyyy", "d-MMM-yyyy", "d/MMM/yyyy", "d MMMM yyyy", "MMMM d, yyyy", "MMMM d yyyy", "d. MMMM yyyy", "yyyyMMdd",
                 "yyyy-DDD", "M/d/yy", "d/M/yy", "d.M.yy", "d-MMM-yy")
TIME_PATTERNS = ("", " H:mm", " H:mm:ss", " H:mm:ss.SSS", " h:mm a", " h:mm:ss a", "'T'HHmmss", "'T'HH:mm:ss", ":HH:mm:ss Z",
                 " H:mm:ss Z", " H:mm:ssXXX", "'T'HHmmssX", "'T'HH:mm:ssXXX")
DATE_FORMATS = (ISO, ISO_WEEK, *(d + t for d, t in product(DATE_PATTERNS, TIME_PATTERNS)))
#: Longer text is no date; it is not parsed.
LONGEST = 40
#: Years of two digits run to this one.
LAST_SHORT_YEAR = 2068

# Weekday names before a date say nothing new.
_WEEKDAY = r"^(?i)(mon|tues?|wed(nes)?|thu(rs)?|fri|sat(ur)?|sun)(day)?,? +(?=[0-9A-Z])"
_WEEKDAYS = ("mon", "tue", "wed", "thu", "fri", "sat", "sun")

# How a run of a pattern letter may be written.
_RUNS = {"yyyy": ["9999"], "yy": ["99"], "M": ["9", "99"], "d": ["9", "99"], "H": ["9", "99"], "h": ["9", "99"], "MM": ["99"], "dd": ["99"],
         "HH": ["99"], "mm": ["99"], "ss": ["99"], "SSS": ["999"], "DDD": ["999"], "MMM": ["AAA"],
         "MMMM": ["A" * n for n in range(3, 10)], "a": ["AA"], "Z": ["+9999", "-9999"], "X": ["A", "+99", "-99", "+9999", "-9999"],
         "XXX": ["A", "+99:99", "-99:99"]}


def _shapes(pattern: str) -> list[str]:
    parts, i = [], 0
    while i < len(pattern):
        c = pattern[i]
        if c == "'":
            end = pattern.index("'", i + 1)
            parts.append(["A" * (end - i - 1)])
            i = end + 1
        elif c.isalpha():
            j = i
            while j < len(pattern) and pattern[j] == c:
                j += 1
            parts.append(_RUNS[pattern[i:j]])
            i = j
        else:
            parts.append([c])
            i += 1
    return ["".join(p) for p in product(*parts)]


_ISO_CLOCK = [f"{h}:{m}" + s for h, m, s in product(["9", "99"], ["9", "99"], ["", *(
    f":{x}{f}" for x in ("9", "99") for f in ["", *("." + "9" * n for n in range(1, 10))])])]
_ISO_ZONES = ["", "A", " AAA", "+99:99", "-99:99", "+9999", "-9999", "+99", "-99", " +99:99", " -99:99"]


def _iso_shapes() -> list[str]:
    days = ["-".join(p) for p in product(["9999"], ["9", "99"], ["9", "99"])]
    return ["9999-9", "9999-99", *days, *(d + s + c + z for d, s, c, z in product(days, " A", _ISO_CLOCK, _ISO_ZONES))]


def _regex(shapes: list[str]) -> str:
    """A pattern of the texts of such shapes (and of some more that mix them)."""
    runs = lambda s: re.sub("9+|A+|[^9A]", lambda m: {"9": f"[0-9]{{{len(m[0])}}}", "A": f"[A-Za-z]{{{len(m[0])}}}"}.get(
        m[0][0], f"[{m[0]}]"), s)
    return "|".join(dict.fromkeys(map(runs, shapes)))


#: Any text that some format may read: a date pattern and a time pattern, or ISO text.
DATE_TEXT = ("^(?:(?:" + "|".join(f"(?:{_regex(_shapes(d))})" for d in DATE_PATTERNS) + ")(?:"
             + "|".join(f"(?:{_regex(_shapes(t))})" for t in TIME_PATTERNS if t) + ")?"
             + r"|[0-9]{4}-[0-9]{1,2}(?:-[0-9]{1,2}(?:[ A-Za-z][0-9]{1,2}:[0-9]{1,2}(?::[0-9]{1,2}(?:[.][0-9]{1,9})?)?"
             + r"(?:[A-Za-z]| [A-Za-z]{3}| ?[+-][0-9]{2}:[0-9]{2}|[+-][0-9]{4}|[+-][0-9]{2})?)?)?"
             + r"|[0-9]{4}-[A-Za-z][0-9]{2}(?:-[0-9])?)$")


@lru_cache(maxsize=None)
def shapes() -> dict[str, tuple[str, ...]]:
    """Every shape that some format reads, with those formats in their order."""
    out: dict[str, list[str]] = {}
    for fmt in DATE_FORMATS:
        known = _iso_shapes() if fmt == ISO else ["9999-A99-9", "9999-A99"] if fmt == ISO_WEEK else _shapes(fmt)
        for s in known:
            out.setdefault(s, []).append(fmt)
    return {s: tuple(f) for s, f in out.items() if len(s) <= LONGEST}


def _plain(c: Column) -> Column:
    """The text without blanks at its ends and without a weekday; NULL if it is too long to be a date."""
    text = F.trim(F.when(F.char_length(c) <= LONGEST, c))
    return F.when(F.lower(F.substring(text, 1, 3)).isin(*_WEEKDAYS), F.regexp_replace(text, _WEEKDAY, "")).otherwise(text)


def with_shapes(df: DataFrame, text: str) -> DataFrame:
    """``df`` with ``shape`` of a text that may be a date (NULL for any other) and ``bare``: nothing was cut off the text."""
    plain = df.withColumn("plain_", _plain(F.col(text)))  # a column, so that it is worked out once
    shape = F.translate("plain_", "012345678BCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", "9" * 9 + "A" * 51)
    return plain.withColumn("shape", F.when(F.col("plain_").rlike(DATE_TEXT), shape)) \
        .withColumn("bare", F.col("plain_") == F.col(text)).drop("plain_")


def formats_of(seen: list[str]) -> list[str]:
    """The formats that read texts of all these shapes, in the order in which they are tried."""
    known = shapes()
    fits = set(DATE_FORMATS)
    for s in seen:
        fits &= set(known.get(s, ()))
    return [f for f in DATE_FORMATS if f in fits]


def parse_date(c: Column, fmt: str) -> Column:
    """The text as a timestamp, NULL where it isn't one in this format."""
    text = _plain(c)
    if fmt == ISO:
        return F.try_to_timestamp(text)
    if fmt == ISO_WEEK:
        part = lambda i: F.regexp_extract(text, r"^([0-9]{4})-W([0-9]{2})(?:-([1-7]))?$", i)
        fourth = F.to_date(F.concat(part(1), F.lit("-01-04")))  # always in the first week
        week, day = part(2).try_cast("int"), F.coalesce(part(3).try_cast("int"), F.lit(1))
        # the last week has the 28th of December
        last = F.weekofyear(F.to_date(F.concat(part(1), F.lit("-12-28"))))
        monday = F.date_sub(fourth, F.weekday(fourth))
        return F.when(text.rlike(r"^[0-9]{4}-W[0-9]{2}(-[1-7])?$") & week.between(F.lit(1), last),
                      F.date_add(monday, (week - 1) * 7 + day - 1).cast("timestamp"))
    at = F.try_to_timestamp(text, F.lit(fmt))
    if "yy" in fmt and "yyyy" not in fmt:
        at = F.when(F.year(at) > LAST_SHORT_YEAR, at - F.expr("INTERVAL '100' YEAR")).otherwise(at)
    return at


def count_dates(c: Column, fmt: str) -> Column:
    """How many values of a text column the format reads."""
    return F.count_if(parse_date(c, fmt).isNotNull())

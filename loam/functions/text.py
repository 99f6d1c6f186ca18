"""Text cleaning expressions (F1-F5) and column-name rules (B1)."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# (?U) makes \s Unicode-aware so U+00A0 and other Unicode blanks count as
# whitespace, as Python's re does for str.
_WS_RUN = "(?U)\\s+"
_NON_WORD = "(?U)[^\\w\\s]"
# Fixed value: characters replaced by "_" in a safe identifier.
UNSAFE_NAME_CHARS = r'[\\/*?:"<>|()\s]'


def collapse_whitespace(c: Column) -> Column:
    """whitespace runs become one space, then trim."""
    return F.trim(F.regexp_replace(c, _WS_RUN, " "))


def standardize_text(c: Column) -> Column:
    """to string, lower case, strip, drop every char that is not a word char or blank."""
    s = F.regexp_replace(c.cast("string"), "^(?U)\\s+|(?U)\\s+$", "")
    return F.regexp_replace(F.lower(s), _NON_WORD, "")


def latin1_only(c: Column) -> Column:
    """drop characters outside Latin-1."""
    return F.regexp_replace(c, "[^\\x{00}-\\x{FF}]", "")


def ascii_runs_to_space(c: Column) -> Column:
    """replace each run of non-ASCII characters by a single space."""
    return F.regexp_replace(c, "[^\\x{00}-\\x{7F}]+", " ")


def safe_identifier_expr(c: Column) -> Column:
    """F5 as a column expression."""
    return F.regexp_replace(c, UNSAFE_NAME_CHARS, "_")


def safe_identifier(name: str) -> str:
    """F5 on a driver-side name (column and file names)."""
    return re.sub(UNSAFE_NAME_CHARS, "_", name)


def standard_name(name: str) -> str:
    """B1: lower case, blanks and hyphens to underscores."""
    return name.lower().replace(" ", "_").replace("-", "_")


def standardize_names(names: list[str]) -> list[str]:
    """B1 over a header; a name that collides with an earlier one gets ``_2``, ``_3``..."""
    seen: dict[str, int] = {}
    out = []
    for name in names:
        base = standard_name(name)
        candidate = base
        k = 1
        while candidate in seen:
            k += 1
            candidate = f"{base}_{k}"
        seen[candidate] = 1
        out.append(candidate)
    return out

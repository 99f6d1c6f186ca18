"""Numeric-looking text: predicate (C2) and coercion (C4)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that define "numeric-looking text": an optional quote, one of the
# currency symbols $ € £ ¥ ₹ ₽, an optional minus, digits with or without
# comma groups of three, an optional decimal part, then an optional percent
# sign or closing quote.  Full match.  We also require at least one digit.
CURRENCY_SYMBOLS = "$€£¥₹₽"
NUMERIC_TEXT_PATTERN = (
    "^['\"]?[$€£¥₹₽]?-?([0-9]{1,3}(,[0-9]{3})*|[0-9]+)?(\\.[0-9]+)?(%|['\"]?)?\\z"
)
HAS_DIGIT_PATTERN = "[0-9]"
# Characters kept by the coercion: digits, the dot and the minus sign.
NON_NUMERIC_CHARS = "[^0-9.\\-]"


def looks_numeric(c: Column) -> Column:
    """True when the string is numeric-looking text (NULL stays NULL)."""
    return c.rlike(NUMERIC_TEXT_PATTERN) & c.rlike(HAS_DIGIT_PATTERN)


def coerce_numeric(c: Column) -> Column:
    """Strip everything but digits, ``.`` and ``-`` then parse; failures become NULL.

    ``$1,234.50`` gives 1234.5, ``5%`` gives 5, ``1-2`` gives NULL.  ``try_cast``
    keeps ANSI mode from raising on text such as ``1.2.3`` or ``-``.
    """
    return F.regexp_replace(c.cast("string"), NON_NUMERIC_CHARS, "").try_cast("double")

"""Fixed-point text of a double, rounded from its exact binary value.

Java's ``%.2f`` rounds the shortest decimal representation half-up, so a
value stored as 256068.02499999999... prints as ``256068.03``; C, Python and
most SQL engines round the exact value and print ``256068.02``.  Here ``x*100``
is formed exactly as ``s + t`` (Veltkamp split of ``x``, products by 100 are
exact, TwoSum of the two parts) and rounded to the nearest integer, ties to
even, then printed as ``<units>.<two digits>``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLIT = 134217729.0  # 2^27 + 1
LARGE = 1e13


def with_fixed2(df, columns: dict[str, str]):
    """Two-digit text of columns, ``printf('%.2f', x)`` for finite doubles: ``{output: input column}``.
    Below 9e18 every digit is exact; above, the digits of the shortest decimal are printed.  The intermediate terms are
    separate projections, so repeated terms stay attribute references instead of
    being inlined into one very large generated expression."""
    out = df
    for o, c in columns.items():
        p = f"_{o}_"
        out = out.withColumns({p + "a": F.abs(F.col(c).cast("double")),
                               p + "neg": F.col(c).cast("double").cast("string").startswith("-")})
        out = out.withColumn(p + "c", F.col(p + "a") * F.lit(_SPLIT))
        out = out.withColumn(p + "hi", F.col(p + "c") - (F.col(p + "c") - F.col(p + "a")))
        out = out.withColumns({p + "p1": F.col(p + "hi") * F.lit(100.0),
                               p + "p2": (F.col(p + "a") - F.col(p + "hi")) * F.lit(100.0)})
        out = out.withColumn(p + "s", F.col(p + "p1") + F.col(p + "p2"))
        out = out.withColumn(p + "bb", F.col(p + "s") - F.col(p + "p1"))
        out = out.withColumns({
            p + "t": (F.col(p + "p1") - (F.col(p + "s") - F.col(p + "bb"))) + (F.col(p + "p2") - F.col(p + "bb")),
            p + "f": F.floor(F.least(F.col(p + "s"), F.lit(100 * LARGE)))})
        out = out.withColumn(p + "r", F.col(p + "s") - F.col(p + "f"))
        up = (F.col(p + "r") > 0.5) | ((F.col(p + "r") == 0.5) & ((F.col(p + "t") > 0) | (
            (F.col(p + "t") == 0) & (F.pmod(F.col(p + "f"), F.lit(2)) == 1))))
        out = out.withColumn(p + "k", F.when(up, F.col(p + "f") + 1).otherwise(F.col(p + "f")).cast("long"))
        # from LARGE on, x * 100 is not exact any more, but the fraction times 100 is
        whole = F.floor(F.col(p + "a").cast("double"))
        cents = F.rint((F.col(p + "a") - F.floor(F.col(p + "a"))) * 100)
        big_units = F.when(F.col(p + "a") < 9e18, (whole + F.when(cents >= 100, 1).otherwise(0)).cast("string")) \
            .otherwise(F.col(p + "a").try_cast("decimal(38,0)").cast("string"))
        large = F.concat(F.coalesce(big_units, F.col(p + "a").cast("string")), F.lit("."),
                         F.lpad(F.pmod(cents, F.lit(100.0)).cast("long").cast("string"), 2, "0"))
        small = F.concat(F.floor(F.col(p + "k") / 100).cast("long").cast("string"), F.lit("."),
                         F.lpad(F.pmod(F.col(p + "k"), F.lit(100)).cast("string"), 2, "0"))
        text = F.concat(F.when(F.col(p + "neg"), F.lit("-")).otherwise(F.lit("")),
                        F.when(F.col(p + "a") < LARGE, small).otherwise(large))
        out = out.withColumn(o, F.when(F.col(c).isNull(), F.lit(None)).otherwise(text))
        out = out.drop(*[x for x in out.columns if x.startswith(p)])
    return out

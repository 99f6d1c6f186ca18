"""Global places and running sums over sorted rows, and apportionment by highest quotients.

Nothing here gathers a group in one task: rows are dealt to ranges of their sort key, and only
one row per range meets the others to add up the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import saved

#: monotonically_increasing_id() has the partition above this bit and the row below it.
_ROW_BITS = 33


def running(df: DataFrame, order: list[Column | str], tag: str, value: str | None = None) -> DataFrame:
    """``df`` with ``place``: the number of rows before each in the given order (dense, from 0).

    With ``value`` also ``before``, the sum of that column over the rows before.  ``df`` is
    read twice (to sample the ranges and to deal them), so pass a written table.  Rows
    that the order cannot tell apart take neighbouring places.  Columns of ``df`` must
    not end in ``_``.
    """
    ranged = saved(df.repartitionByRange(*order).sortWithinPartitions(*order)
                   .withColumn("at_", F.monotonically_increasing_id()), tag).withColumn("part_", F.shiftright("at_", _ROW_BITS))
    # one row per range
    totals = ranged.groupBy("part_").agg(F.count("*").alias("rows_"), F.sum(value or F.lit(0)).alias("sum_"))
    earlier = Window.orderBy("part_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select("part_", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"{c}off_") for c in ("rows_", "sum_")])
    out = ranged.withColumn("place", F.col("at_").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)))
    if value:
        inside = Window.partitionBy("part_").orderBy("at_").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    out = out.join(F.broadcast(offsets), "part_")
    return out.select(*df.columns, (F.col("place") + F.col("rows_off_")).alias("place"),
                      *([(F.col("before") + F.col("sum_off_")).alias("before")] if value else []))


def apportion(rows: DataFrame, tag: str) -> DataFrame:
    """``rows`` (g, k, votes, cap, seats, total, many) with ``won``: seats by Sainte-Laguë's divisors.

    In each group g, ``seats`` go one by one to the row with the highest votes / (2 won + 1)
    (ties: the smallest k) that has fewer than ``cap``.  ``total`` and ``many`` are the sum of
    votes and the number of rows of the group; seats of a group that exceed its caps stay
    unused.  ``rows`` must be a written table.

    Handing out seats one by one would be a loop over all of them.  Quotients above the one
    that ``seats - many/2`` seats would lead to always win and those below that of
    ``seats + many/2`` never do, so only the few between, about two a row, are sorted.
    """
    span = 1.0
    votes, half = F.col("votes").cast("double"), F.col("many") / 2
    while True:
        def upto(seats: Column) -> Column:
            return F.floor(F.try_divide(votes * seats, F.col("total").cast("double")) + 0.5)
        # what caps take from some rows goes to others, so the span grows until all seats are found
        near = rows.withColumn("base", F.least("cap", F.coalesce(upto(F.greatest(F.col("seats") - span * half, F.lit(0.0))), F.lit(0)))) \
            .withColumn("top", F.when(votes > 0, F.least("cap", upto(F.col("seats") + span * half) + 1)).otherwise(F.lit(0)))
        near = near.withColumn("top", F.greatest("top", "base"))
        groups = saved(near.groupBy("g").agg(F.sum("base").alias("sure"), F.sum("top").alias("reach"), F.max("seats").alias("of"),
                                             F.sum(F.when(votes > 0, F.col("cap")).otherwise(0)).alias("room")), f"{tag}-groups")
        if groups.where("sure > of or reach < least(of, room)").isEmpty():
            break
        span *= 2
    candidates = saved(near.where("top > base").select("g", "k", F.explode(F.expr("sequence(base, top - 1)")).alias("seat"), "votes")
                       .select("g", "k", (votes / (2 * F.col("seat") + 1)).alias("quotient")), f"{tag}-quotients")
    ranked = running(candidates, ["g", F.desc("quotient"), "k"], f"{tag}-ranked")
    first = saved(ranked.groupBy("g").agg(F.min("place").alias("first")).join(groups, "g").select("g", "first", (F.col("of") - F.col("sure")).alias("left")),
                  f"{tag}-first")
    more = ranked.join(first, "g").where("place - first < left").groupBy("g", "k").agg(F.count("*").alias("more"))
    return near.join(more, ["g", "k"], "left").select(*rows.columns, (F.col("base") + F.coalesce("more", F.lit(0))).cast("long").alias("won"))

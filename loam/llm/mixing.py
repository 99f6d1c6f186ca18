"""Mixing sources to target weights by Sainte-Laguë apportionment (DataFrame functions only).

Each source's documents, in the order of their keys, are one row of words, cut into blocks of
equally many words.  Blocks are handed out by highest quotients: first to the sources, whose
votes are their target words, then within a source to its shards of consecutive blocks.
A shard takes all of its blocks equally often, and one time more those that a seeded
hash puts first.  A document's share is the sum over the blocks that it lies in.

Scale: texts are read once, for their word counts.  A hot source is split into ranges of documents and
shards of ``SHARD_BLOCKS`` blocks; every sort beyond a shard is a range sort.  What reaches
the driver are sums over all sources.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loam.llm.common import saved
from loam.llm.ranks import apportion, running

WORD = r"[^\x20\x09-\x0D]+"
#: Weights of the sources in the order of their names, repeating.
WEIGHTS = (1, 2, 3)
#: No text is taken more often than this.
MOST = 3
BLOCK_WORDS = 64
SHARD_BLOCKS = 1024


def _level(sources: DataFrame) -> tuple[int, int]:
    """(num, den): a source of weight w has the target min(cap, w num / den); all targets add up to all sizes.

    What capped sources leave is shared by weight among the others until none is above its cap;
    each turn is one sum over the sources.
    """
    level = None
    above = F.lit(False)
    while True:
        got = sources.agg(F.sum("source_size").alias("all"), F.sum(F.when(above, F.col("cap"))).alias("full"),
                          F.sum(F.when(~above, F.col("weight"))).alias("free")).first()
        now = ((got["all"] or 0) - (got["full"] or 0), got["free"] or 0)
        if now == level or not now[1]:
            return level or now
        level = now
        above = F.col("cap").cast("decimal(38,0)") * F.lit(now[1]) < F.col("weight").cast("decimal(38,0)") * F.lit(now[0])


def targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """(source, g, source_size, start, weight, cap, target) of (source, size) rows; NULL is a source, the last one.

    ``start`` counts the words of the sources before.
    """
    sums = saved(sized.groupBy("source").agg(F.sum("size").alias("source_size")), "source-sizes")
    sources = running(sums, [F.asc_nulls_last("source")], "sources", "source_size").withColumnsRenamed({"place": "g", "before": "start"})
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (F.col("g") % len(weights) + 1).cast("int")).cast("long")
    sources = saved(sources.withColumn("weight", weight).withColumn("cap", most * F.col("source_size")), "weighed")
    num, den = _level(sources)
    share = F.try_divide((F.col("weight").cast("decimal(38,0)") * F.lit(num)).cast("double"), F.lit(float(den)))
    above = F.col("cap").cast("decimal(38,0)") * F.lit(den) < F.col("weight").cast("decimal(38,0)") * F.lit(num)
    return saved(sources.withColumn("target", F.when(above, F.col("cap").cast("double")).otherwise(F.coalesce(share, F.lit(0.0)))), "targets")


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST, block_words: int = BLOCK_WORDS,
        shard_blocks: int = SHARD_BLOCKS, seed: int = 12, text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """One row per document: key, size, source_size, target, taken.

    ``taken`` words of the document go into the mix (a text taken twice counts twice), never more
    than ``most`` times its size.  The words of a source come within ``most + 1`` blocks of its target.
    NULL text has no words and is taken 0 times; NULL is a source of its own, after all
    others.  Rows with equal key and source are documents of their own; equal rows may
    swap what they are given.  An empty table gives an empty result; other columns are ignored.
    Reruns agree, whatever the partitioning.
    """
    sized = saved(docs.select(F.col(key).alias("doc"), F.col(source).alias("source"),
                              F.regexp_count(F.coalesce(F.col(text), F.lit("")), F.lit(WORD)).cast("long").alias("size")), "sizes")
    sources = targets(sized, weights, most)
    blocks = F.ceil(F.col("source_size") / block_words)
    got = sources.agg(F.sum("source_size").alias("words"), F.count("*").alias("many")).first()
    seats = (got["words"] or 0) // block_words
    quotas = apportion(saved(sources.select(
        F.lit(0).alias("g"), F.col("g").alias("k"), F.col("target").alias("votes"), (most * blocks).cast("long").alias("cap"),
        F.lit(seats).alias("seats"), F.lit(float(got["words"] or 0)).alias("total"), F.lit(got["many"]).alias("many"),
        blocks.alias("blocks")), "source-votes"), "source").select(F.col("k").alias("g"), "won", "blocks")
    # shards of a source, in two steps so that a row never holds a very long sequence
    shards = F.ceil(F.col("blocks") / shard_blocks)
    shard_votes = quotas.where("blocks > 0").withColumn("many", shards) \
        .withColumn("far", F.explode(F.expr("sequence(0L, (many - 1) div 4096)"))).repartition("g", "far") \
        .withColumn("k", F.explode(F.expr("sequence(far * 4096, least(many - 1, far * 4096 + 4095))"))) \
        .withColumn("b", F.least(F.lit(shard_blocks), F.col("blocks") - F.col("k") * shard_blocks).cast("long")) \
        .select("g", "k", F.col("b").alias("votes"), (most * F.col("b")).alias("cap"), F.col("won").alias("seats"),
                F.col("blocks").alias("total"), "many")
    shard_quotas = apportion(saved(shard_votes, "shard-votes"), "shard").select(
        "g", F.col("k").alias("shard"), F.col("won").alias("quota"), F.col("votes").alias("b"))
    # where each document lies in its source's row of words
    named = saved(sized.join(sources.select(F.col("source").alias("of"), "g"), F.col("source").eqNullSafe(F.col("of")))
                  .select("doc", "g", "size"), "named")
    starts = sources.select(F.col("g").alias("h"), "start", "source_size", "target")
    placed = saved(running(named, ["g", "doc", "size"], "placed", "size").join(starts, F.col("g") == F.col("h"))
                   .select("place", "doc", "g", "size", "source_size", "target", (F.col("before") - F.col("start")).alias("lo")), "spans")
    first, last = F.col("lo"), F.col("lo") + F.col("size")
    width = F.lit(block_words)
    pieces = placed.where("size > 0").withColumn("block", F.explode(F.expr(
        f"sequence(lo div {int(block_words)}, (lo + size - 1) div {int(block_words)})"))) \
        .select("place", "g", "block", F.expr(f"block div {int(shard_blocks)}").alias("shard"),
                (F.least(last, (F.col("block") + 1) * width) - F.greatest(first, F.col("block") * width)).alias("words"))
    chosen = Window.partitionBy("g", "shard").orderBy(F.md5(F.concat_ws(":", F.lit(seed), "g", "block").cast("binary")), "block")
    times = F.expr("quota div b") + (F.dense_rank().over(chosen) <= F.col("quota") % F.col("b")).cast("long")
    given = pieces.join(shard_quotas, ["g", "shard"]).select("place", (F.col("words") * times).alias("words")) \
        .groupBy("place").agg(F.sum("words").alias("taken"))
    return placed.join(given, "place", "left").select(
        F.col("doc").alias(key), "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))

"""Exact deduplication by deterministic block naming (DataFrame functions only).

Every text is cut into blocks of a fixed number of bytes.  Distinct blocks are
sorted, and a block's name is its place in that order.  Adjacent names are then
paired and the distinct pairs sorted and named, and so on, until one name is left
for each document.  Two texts are equal exactly when they have equally many blocks
and the same last name: no step compares digests alone.

Scale: block texts are shuffled once, as distinct (hash, block) pairs that map
tasks pre-aggregate; from then on rows are a few integers.  Blocks are sorted by their
64-bit hash; the distinct pairs show whether any hash belongs to two blocks, and then
the bytes themselves are sorted instead (``_named_by_bytes``).  A block or identity
that a third of all rows share is aggregated in the map tasks and meets the documents
in a join whose partitions Spark splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loam.llm.common import keep_rows, saved

BLOCK_BYTES = 4096


def _block_hash(block: Column) -> Column:
    return F.xxhash64(block)


def _blocks(raw: Column, size: int) -> Column:
    """Array of the blocks of a binary column; an empty text is one empty block."""
    last = F.greatest(F.floor((F.length(raw) - 1) / size), F.lit(0)).cast("int")
    return F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(raw, i * size + 1, F.lit(size)))


def _sorted_names(distinct: DataFrame, keys: list[str], tag: str) -> DataFrame:
    """Rows of ``distinct`` with ``name``: an integer that grows with the keys.

    Range partitions are sorted and numbered (partition in the high bits), then
    written, so that the names stay what they are.
    """
    ordered = distinct.repartitionByRange(*[F.col(k) for k in keys]).sortWithinPartitions(*keys)
    return saved(ordered.withColumn("name", F.monotonically_increasing_id()), tag)


def _named_by_bytes(base: DataFrame, size: int) -> tuple[DataFrame, DataFrame]:
    """(row, key, text_sha256, n_blocks) and first-level names that come from the bytes themselves.

    Used when two distinct blocks share a 64-bit hash; shuffles the blocks twice.
    """
    numbered = saved(base.withColumn("row", F.monotonically_increasing_id()), "numbered")
    pieces = numbered.select("row", F.posexplode(_blocks(F.col("raw"), size)).alias("idx", "block"))
    names = _sorted_names(pieces.select("block").distinct(), ["block"], "names")
    thin = numbered.withColumn("n_blocks", F.size(_blocks(F.col("raw"), size)))
    level = pieces.join(names, "block").join(thin.select("row", "n_blocks"), "row")
    return thin.withColumn("text_sha256", F.sha2("raw", 256)).drop("raw"), level.select("row", "n_blocks", "idx", "name")


def identities(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES,
               hash_fn=_block_hash) -> DataFrame:
    """One row per input row: row, key, text_sha256, n_blocks, name.

    (n_blocks, name) is the collision-free identity of the text.  ``row`` numbers the
    input rows (unique also where keys repeat or are NULL).  NULL text is empty.
    """
    raw = F.coalesce(F.col(text), F.lit("")).cast("binary")
    base = docs.select(F.col(key).alias(key), raw.alias("raw"))
    # one scan gives each row's number, digest and block hashes; no text is kept
    thin = saved(base.select(F.monotonically_increasing_id().alias("row"), key, F.sha2("raw", 256).alias("text_sha256"),
                             F.transform(_blocks(F.col("raw"), block_bytes), hash_fn).alias("hs"))
                 .withColumn("n_blocks", F.size("hs")), "texts")
    pieces = base.select(F.explode(_blocks(F.col("raw"), block_bytes)).alias("block"))
    # the only shuffle of text: distinct blocks, combined in the map tasks first
    distinct = saved(pieces.select(hash_fn(F.col("block")).alias("h"), "block").distinct().select("h"), "blocks")
    if distinct.groupBy("h").count().where("count > 1").isEmpty():
        names = _sorted_names(distinct.select("h"), ["h"], "names")
        level = thin.select("row", "n_blocks", F.posexplode("hs").alias("idx", "h")).join(names, "h")
    else:
        thin, level = _named_by_bytes(base, block_bytes)
    level = saved(level.select("row", "n_blocks", "idx", "name"), "level")
    done = []
    most = thin.agg(F.max("n_blocks")).first()[0] or 1
    width = 1
    while True:
        done.append(level.where((F.col("n_blocks") > width // 2) & (F.col("n_blocks") <= width))
                    .select("row", "name"))
        if width >= most:
            break
        rest = level.where(F.col("n_blocks") > width)
        pairs = rest.groupBy("row", "n_blocks", F.floor(F.col("idx") / 2).cast("int").alias("at")).agg(
            F.max(F.when(F.col("idx") % 2 == 0, F.col("name"))).alias("left"),
            F.coalesce(F.max(F.when(F.col("idx") % 2 == 1, F.col("name"))), F.lit(-1)).alias("right"))
        pairs = saved(pairs.withColumnRenamed("at", "idx"), "pairs")
        names = _sorted_names(pairs.select("left", "right").distinct(), ["left", "right"], "names")
        level = saved(pairs.join(names, ["left", "right"]).select("row", "n_blocks", "idx", "name"), "level")
        width *= 2
    named = done[0]
    for d in done[1:]:
        named = named.unionByName(d)
    return thin.select("row", key, "text_sha256", "n_blocks").join(named, "row")


def exact_dedup(docs: DataFrame, text: str = "text", key: str = "doc_id", block_bytes: int = BLOCK_BYTES,
                hash_fn=_block_hash) -> DataFrame:
    """One row per document: key, keep_id, group_size, kept, text_sha256, row.

    Of equal texts the row with the largest key stays (a NULL key is smallest; among
    rows with one key the one read last).  NULL text equals the empty text.  An empty
    table gives an empty result; other columns are ignored.
    """
    ids = saved(identities(docs, text, key, block_bytes, hash_fn), "identities")
    # written by itself, so that the join below shuffles the documents anew and a hot identity can be split
    groups = saved(ids.groupBy("n_blocks", "name").agg(
        F.max(F.struct(F.col(key).alias("k"), F.col("row").alias("r"))).alias("top"),
        F.count("*").alias("group_size")), "groups")
    return ids.join(groups, ["n_blocks", "name"]).select(
        key, F.col("top.k").alias("keep_id"), "group_size", (F.col("row") == F.col("top.r")).alias("kept"),
        "text_sha256", "row")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """The documents that stay, with all their columns; of repeated equal rows one stays."""
    result = saved(exact_dedup(docs, text, key), "kept")
    same = result.groupBy(key, "text_sha256").agg(F.count("*").alias("n_same"), F.max("kept").alias("stays"))
    return keep_rows(docs, same.where("stays"), text, key)

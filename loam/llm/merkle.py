"""Merkle manifest of a table, its trees stored in van Emde Boas order.

Every row is a leaf; the leaves of a source, in the order of their keys, form a tree of runs of
sixteen, and the sources' roots form another tree above them.  Trees are cut into aligned
subtrees (blocks) of ``TIER`` levels.  A block keeps all of its digests in one array,
laid out by splitting it at half its height: the upper half first, then each lower
subtree, every part laid out in the same way.  A node's place is arithmetic on its
level and index (``address``), without pointers; whatever the size of a cache or page,
a walk from leaf to root touches few of them.  Roots of blocks are the leaves of the next
tier, whose blocks are made the same way, until one block holds the whole tree.

Proofs go down again: a block hands the digests beside each of its leaves to the block
below, together with what it was handed itself.

Scale: one scan hashes the texts; from then on rows are keys and digests.  Leaves are numbered by range
sort, so a source with a third of all rows is spread over many ranges and many blocks; a group
that meets in one worker is a block of 4096 leaves.  Only the one root reaches the driver.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loam.llm.common import ascii_lower, saved
from loam.llm.ranks import running

ARITY = 16
#: Levels of edges in a block: 16^3 leaves.
TIER = 3
BLOCK = ARITY ** TIER
DIGEST = 32


def size(edges: int) -> int:
    """Nodes of a full subtree with so many levels of edges."""
    return (ARITY ** (edges + 1) - 1) // (ARITY - 1)


def address(edges: int, up: int, index):
    """Place of a node in the layout of a full subtree: ``up`` levels above the leaves, ``index`` from the left.

    Works on an integer or an array of them.
    """
    if edges == 0:
        return index * 0
    upper = (edges + 1) // 2  # levels of nodes in the upper half
    depth = edges - up
    if depth < upper:
        return address(upper - 1, upper - 1 - depth, index)
    lower = edges - upper     # levels of edges of a lower subtree
    across = ARITY ** (depth - upper)
    return size(upper - 1) + index // across * size(lower) + address(lower, up, index % across)


@lru_cache(maxsize=None)
def _addresses(edges: int, up: int) -> np.ndarray:
    return address(edges, up, np.arange(ARITY ** (edges - up)))


def height(n: int) -> int:
    """Levels of edges above n leaves."""
    levels, width = 0, 1
    while width < n:
        levels, width = levels + 1, width * ARITY
    return levels


def digest(parts: list[str]) -> str:
    return hashlib.sha256("".join(parts).encode("ascii")).hexdigest()


def build(leaves: list[str], edges: int) -> tuple[bytes, str]:
    """The stored block over up to 16^edges leaf digests (hex), and its root."""
    store = np.zeros((size(edges), DIGEST), np.uint8)
    level = leaves
    for up in range(edges + 1):
        if up:
            level = [digest(level[i:i + ARITY]) for i in range(0, len(level), ARITY)]
        store[_addresses(edges, up)[:len(level)]] = np.frombuffer(bytes.fromhex("".join(level)), np.uint8).reshape(-1, DIGEST)
    return store.tobytes(), level[0]


def siblings(store: bytes, edges: int, used: int, index: int) -> Iterator[tuple[int, list[str]]]:
    """Level by level upwards: the place of the node in its run, and the digests of the run's others."""
    for up in range(edges):
        at, last = index % ARITY, min(index - index % ARITY + ARITY, used)
        places = _addresses(edges, up)[index - at:last]
        yield at, [store[p * DIGEST:(p + 1) * DIGEST].hex() for i, p in enumerate(places.tolist()) if i != at]
        index, used = index // ARITY, -(-used // ARITY)


def _steps(path: bytes) -> list[tuple[int, list[str]]]:
    """A proof from its bytes: per level the place in the run, the number of others, their digests."""
    out, at = [], 0
    while at < len(path):
        place, many = path[at], path[at + 1]
        at += 2
        out.append((place, [path[at + i * DIGEST: at + (i + 1) * DIGEST].hex() for i in range(many)]))
        at += many * DIGEST
    return out


def _bytes(steps) -> bytes:
    return b"".join(bytes([place, len(others)]) + bytes.fromhex("".join(others)) for place, others in steps)


def fold(leaf: str, steps) -> str:
    """The root that a leaf and its proof lead to."""
    for place, others in steps:
        leaf = digest([*others[:place], leaf, *others[place:]])
    return leaf


def _field(col: Column) -> Column:
    value = col.cast("string")
    return F.coalesce(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value), F.lit("-"))


def leaf_digest(*cols: Column) -> Column:
    """Hash of a row's fields: ``-`` for NULL, else UTF-8 byte count, ``:``, value."""
    return F.sha2(F.concat(*[_field(c) for c in cols]).cast("binary"), 256)


_BLOCKS = "tree long, block long, n long, edges int, used int, store binary, root string"


def _build_block(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
    table = table.sort_by("idx")
    n = table["n"][0].as_py()
    edges = min(TIER, height(n))
    store, root = build(table["digest"].to_pylist(), edges)
    return pa.table({"tree": [key[0].as_py()], "block": [key[1].as_py()], "n": [n], "edges": pa.array([edges], pa.int32()),
                     "used": pa.array([table.num_rows], pa.int32()), "store": pa.array([store], pa.binary()), "root": [root]})


def tiers(nodes: DataFrame, tag: str) -> list[DataFrame]:
    """The blocks of all trees, tier by tier, from (tree, idx, n, digest): n leaves numbered from 0.

    A tree ends at the first tier where n (its nodes on that tier) fits one block.
    """
    out = []
    while True:
        blocks = saved(nodes.select("tree", "idx", "n", "digest").groupBy("tree", F.expr(f"idx div {BLOCK}").alias("block"))
                       .applyInArrow(_build_block, _BLOCKS), f"{tag}-tier{len(out)}")
        out.append(blocks)
        taller = blocks.where(F.col("n") > BLOCK)
        if taller.isEmpty():
            return out
        nodes = taller.select("tree", F.col("block").alias("idx"), F.ceil(F.col("n") / BLOCK).alias("n"), F.col("root").alias("digest"))


def _paths_of_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for b in batch.to_pylist():
            above = b["path"] or b""
            paths = [_bytes(siblings(b["store"], b["edges"], b["used"], i)) + above for i in range(b["used"])]
            yield pa.RecordBatch.from_arrays(
                [pa.array([b["tree"]] * len(paths), pa.int64()), pa.array([b["block"] * BLOCK + i for i in range(len(paths))], pa.int64()),
                 pa.array(paths, pa.binary()), pa.array([b["subroot"]] * len(paths))], ["tree", "idx", "path", "subroot"])


def with_paths(built: list[DataFrame], above: DataFrame | None, tag: str) -> DataFrame:
    """Blocks of the lowest tier with ``path`` (proof of the block's root up to the end) and ``subroot`` (root of its tree).

    ``above`` (tree, path) goes on top of what the tree itself gives.
    """
    down = None
    for blocks in reversed(built):
        last = blocks.where(F.col("n") <= BLOCK).withColumn("subroot", F.col("root"))
        last = last.withColumn("path", F.lit(b"")) if above is None else last.join(above, "tree")
        cur = last.select(*blocks.columns, "path", "subroot")
        if down is not None:
            cur = cur.unionByName(blocks.where(F.col("n") > BLOCK).join(down.withColumnRenamed("idx", "block"), ["tree", "block"])
                                  .select(*cur.columns))
        cur = saved(cur, f"{tag}-paths")
        down = cur.mapInArrow(_paths_of_block, "tree long, idx long, path binary, subroot string")
    return cur


def _proofs(schema: T.StructType, root: str):
    def of_block(rows: pa.Table, blocks: pa.Table) -> pa.Table:
        rows = rows.sort_by("idx")
        block = blocks.slice(0, 1).to_pylist()[0]
        above = _steps(block["path"])
        beside_above = "".join(h for _, others in above for h in others)
        own, proofs, folded = [], [], []
        for idx, leaf, bent in zip(rows["idx"].to_pylist(), rows["digest"].to_pylist(), rows["bent"].to_pylist()):
            steps = [*siblings(block["store"], block["edges"], block["used"], idx % BLOCK), *above]
            proofs.append(digest([*(h for _, others in steps[:block["edges"]] for h in others), beside_above]))
            folded.append(fold(leaf if bent is None else bent, steps))
            own.append(leaf)
        n = len(own)
        return pa.table([rows["key"], pa.array(own), pa.array([block["subroot"]] * n), pa.array([root] * n), pa.array(proofs),
                         pa.array(folded), pa.array([f == root for f in folded])], names=schema.names)
    return of_block


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text")) -> DataFrame:
    """One row per input row: key, leaf, subroot, root, proof_sha256, folded_root, verified.

    The first five are of the data as they are.  ``folded_root`` is what the proof leads to from
    the leaf recomputed after tampering: where 5 divides the crc32 of the key's decimal text, A-Z of
    the text are lower-cased.  A NULL key is never tampered with and comes first in its
    source; a NULL source is a source of its own, before the others.  Rows with equal
    keys are ordered by their digests.  A table of one row has its leaf as root and an empty proof
    (the hash of nothing); an empty table gives an empty result.  Other columns are ignored.
    """
    col = {c: F.col(c) for c in fields}
    changed = leaf_digest(*[ascii_lower(col[c]) if c == text else col[c] for c in fields])
    tampered = F.crc32(F.col(key).cast("string").cast("binary")) % 5 == 0
    leaves = saved(docs.select(F.col(key).alias("key"), F.col(source).alias("source"), leaf_digest(*col.values()).alias("digest"),
                               F.when(tampered, changed).alias("bent")), "leaves")
    ranked = running(leaves, ["source", "key", "digest"], "ranked")
    sums = saved(ranked.groupBy("source").agg(F.min("place").alias("first"), F.count("*").alias("n")), "sources")
    sources = saved(running(sums, ["source"], "source-order").withColumnRenamed("place", "tree"), "trees")
    nodes = saved(ranked.join(sources.select(F.col("source").alias("of"), "first", "n", "tree"), F.col("source").eqNullSafe(F.col("of")))
                  .select("tree", (F.col("place") - F.col("first")).alias("idx"), "n", "key", "digest", "bent"), "nodes")
    schema = T.StructType([T.StructField(key, docs.schema[key].dataType), *T._parse_datatype_string(
        "leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean").fields])
    built = tiers(nodes, "source")
    many = sources.count()
    if not many:
        return docs.sparkSession.createDataFrame([], schema)
    roots = None
    for blocks in built:
        ended = blocks.where(F.col("n") <= BLOCK).select("tree", "root")
        roots = ended if roots is None else roots.unionByName(ended)
    top = tiers(roots.select(F.lit(0).cast("long").alias("tree"), F.col("tree").alias("idx"), F.lit(many).cast("long").alias("n"),
                             F.col("root").alias("digest")), "top")
    root = top[-1].select("root").first()["root"]
    over = with_paths(top, None, "top").mapInArrow(_paths_of_block, "tree long, idx long, path binary, subroot string")
    blocks = with_paths(built, over.select(F.col("idx").alias("tree"), "path"), "source")
    rows = nodes.select("tree", F.expr(f"idx div {BLOCK}").alias("block"), "idx", "key", "digest", "bent")
    return rows.groupBy("tree", "block").cogroup(blocks.select("tree", "block", "edges", "used", "store", "path", "subroot")
                                                 .groupBy("tree", "block")).applyInArrow(_proofs(schema, root), schema)

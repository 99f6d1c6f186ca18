"""SimHash near-deduplication with the generalised pigeonhole principle.

Fingerprints: a 64-bit SimHash over word shingles.  Links: distinct fingerprints at
most ``max_bits`` apart, found exactly:

1. bits that are correlated over all fingerprints are grouped into partitions;
2. every fingerprint gets its own thresholds: max_bits + 1 units are dealt over the
   partitions (u units: probe that partition up to distance u - 1; 0: skip it) by
   dynamic programming on estimated candidate counts.  Any fingerprint within
   max_bits must come within the threshold of some partition, whatever the deal;
3. the probes (fingerprint's partition value with up to u - 1 bits flipped) meet the
   index of partition values in a join that verifies the whole distance, and emits a
   pair only from the first partition that finds it and from its smaller end.

Scale: copies collapse to one fingerprint before probing, and fingerprints that share
a partition value with their group's leader and lie within reach of it are joined by
that one link: pairs inside such a group are never emitted.  Statistics are 64 x 64
sums and 8 x 256 counts over all fingerprints, whatever their number.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations
from math import comb, log2

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loam.llm.common import connected_components, keep_rows, saved, text_digest

SHINGLE_WORDS = 4
MAX_BITS = 4
SEED = 42
CHUNK = 1 << 16
#: Cost of verifying a candidate, in shuffled probe rows.
CANDIDATE_COST = 0.2


def fingerprint(text: str | None, shingle_words: int = SHINGLE_WORDS) -> int:
    """Signed 64-bit SimHash of the A-Z lower-cased text; 0 without words."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes.lower and split know ASCII only
    n = len(words)
    if not n:
        return 0
    joined = b" ".join(words)
    if n < shingle_words:
        digests, total = [xxhash.xxh64_digest(joined, SEED)], 1
        return _majority(digests, total)
    lengths = np.fromiter(map(len, words), np.int64, n)
    ends = np.cumsum(lengths + 1) - 1
    starts = (ends - lengths)[: n - shingle_words + 1].tolist()
    ends = ends[shingle_words - 1:].tolist()
    digest = xxhash.xxh64_digest
    return _majority([digest(joined[a:b], SEED) for a, b in zip(starts, ends)], len(starts))


def _majority(digests: list[bytes], total: int) -> int:
    ones = np.zeros(64, np.int64)
    for at in range(0, total, CHUNK):
        part = digests[at: at + CHUNK]
        bits = np.unpackbits(np.frombuffer(b"".join(part), np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * ones > total).tobytes(), "big", signed=True)


def fingerprints(docs: DataFrame, text: str = "text", key: str = "doc_id",
                 shingle_words: int = SHINGLE_WORDS) -> DataFrame:
    """key, text_sha256, fp (signed 64-bit) of every row."""
    @F.pandas_udf("long")
    def hashed(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(t, shingle_words) for t in texts], dtype="int64")

    return docs.select(key, text_digest(text).alias("text_sha256"), hashed(F.col(text)).alias("fp"))


def _bits(values: np.ndarray) -> np.ndarray:
    """(n, 64) 0/1; column b is bit b."""
    return np.unpackbits(values.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)[:, ::-1]


def _co_occurrence(fps: DataFrame) -> np.ndarray:
    """64 x 64 counts of fingerprints that have both bits."""
    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((64, 64), np.int64)
        for b in batches:
            x = _bits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)).astype(np.float64)
            total += (x.T @ x).astype(np.int64)
        i, j = np.indices((64, 64))
        yield pa.RecordBatch.from_arrays([pa.array(i.ravel()), pa.array(j.ravel()), pa.array(total.ravel())],
                                         ["i", "j", "n"])

    out = np.zeros((64, 64))
    for r in fps.select("fp").mapInArrow(sums, "i long, j long, n long").groupBy("i", "j").agg(
            F.sum("n").alias("n")).collect():
        out[r["i"], r["j"]] = r["n"]
    return out


def group_bits(together: np.ndarray, n: int, parts: int) -> list[list[int]]:
    """Bits grouped so that correlated ones share a partition (widths differ by one at most)."""
    p = together.diagonal() / max(n, 1)
    spread = np.sqrt(np.maximum(p * (1 - p), 1e-12))
    corr = np.abs((together / max(n, 1) - np.outer(p, p)) / np.outer(spread, spread))
    np.fill_diagonal(corr, 0)
    left, groups = set(range(64)), []
    for k in range(parts):
        width = 64 // parts + (k < 64 % parts)
        own = [max(sorted(left), key=lambda b: corr[b, sorted(left)].sum())]
        left.discard(own[0])
        while len(own) < width:
            best = max(sorted(left), key=lambda b: corr[b, own].sum())
            own.append(best)
            left.discard(best)
        groups.append(own)
    return groups


def _octets(groups: list[list[int]]) -> list[tuple[int, list[int]]]:
    """(partition, up to 8 of its bits) pieces whose values are counted."""
    return [(k, g[i: i + 8]) for k, g in enumerate(groups) for i in range(0, len(g), 8)]


def _piece_values(bits: np.ndarray, piece: list[int]) -> np.ndarray:
    return bits[:, piece].astype(np.int64) @ (1 << np.arange(len(piece)))


def _histograms(fps: DataFrame, pieces: list[tuple[int, list[int]]]) -> np.ndarray:
    """How many fingerprints have each value of each piece."""
    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(pieces), 256), np.int64)
        for b in batches:
            bits = _bits(b.column(0).to_numpy(zero_copy_only=False).view(np.uint64))
            for k, (_, piece) in enumerate(pieces):
                total[k] += np.bincount(_piece_values(bits, piece), minlength=256)
        k, v = np.indices(total.shape)
        yield pa.RecordBatch.from_arrays([pa.array(k.ravel()), pa.array(v.ravel()), pa.array(total.ravel())],
                                         ["k", "v", "n"])

    out = np.zeros((len(pieces), 256))
    for r in fps.select("fp").mapInArrow(counts, "k long, v long, n long").groupBy("k", "v").agg(
            F.sum("n").alias("n")).collect():
        out[r["k"], r["v"]] = r["n"]
    return out


def _distance_tables(hist: np.ndarray, n: int, most: int) -> np.ndarray:
    """[piece, value, d]: share of fingerprints whose piece lies d bits from the value (d <= most)."""
    v = np.arange(256)
    apart = np.array([bin(x).count("1") for x in range(256)])[v[:, None] ^ v[None, :]]
    return np.stack([np.stack([(apart == d) @ h for d in range(most + 1)], axis=1) for h in hist]) / max(n, 1)


class Deal:
    """Partitions of the bits and the per-fingerprint thresholds."""

    def __init__(self, groups: list[list[int]], near: np.ndarray, n: int, max_bits: int):
        self.groups, self.near, self.n, self.max_bits = groups, near, n, max_bits
        self.pieces = _octets(groups)
        self.masks = [sum(1 << b for b in g) for g in groups]

    def thresholds(self, bits: np.ndarray) -> np.ndarray:
        """(rows, partitions) units, each row summing to max_bits + 1 at least cost."""
        rows, units = len(bits), self.max_bits + 1
        best = np.full((rows, units + 1), np.inf)
        best[:, 0] = 0
        choice = []
        for k, group in enumerate(self.groups):
            dist = np.zeros((rows, units))
            dist[:, 0] = 1
            for p, (part, piece) in enumerate(self.pieces):
                if part == k:
                    step = self.near[p][_piece_values(bits, piece)]
                    dist = np.stack([sum(dist[:, a] * step[:, d - a] for a in range(d + 1)) for d in range(units)], 1)
            within = np.cumsum(dist, axis=1) * self.n
            probes = np.cumsum([comb(len(group), d) for d in range(units)])
            cost = np.concatenate([np.zeros((rows, 1)), probes + CANDIDATE_COST * within], axis=1)
            options = np.stack([np.stack([best[:, total - u] + cost[:, u] if u <= total else np.full(rows, np.inf)
                                          for u in range(units + 1)], 1) for total in range(units + 1)], 1)
            choice.append(options.argmin(axis=2))
            best = options.min(axis=2)
        out, total = np.zeros((rows, len(self.groups)), np.int64), np.full(rows, units)
        for k in reversed(range(len(self.groups))):
            out[:, k] = choice[k][np.arange(rows), total]
            total -= out[:, k]
        return out


def _parts_for(n: int, max_bits: int) -> int:
    """Number of partitions with the least cost were the bits independent."""
    def cost(m: int) -> float:
        width, units = 64 / m, max_bits + 1
        share = [units // m + (k < units % m) for k in range(m)]
        probes = sum(sum(comb(round(width), d) for d in range(u)) for u in share)
        return probes * (1 + CANDIDATE_COST * n / 2 ** width)
    return min(range(2, max_bits + 2), key=cost)


def links(fps: DataFrame, max_bits: int = MAX_BITS) -> DataFrame:
    """Edges (a, b) between distinct fingerprints ``fp`` that connect all pairs within max_bits.

    Pairs that a shared leader already connects are left out.
    """
    n = fps.count()
    parts = _parts_for(max(n, 2), max_bits)
    groups = group_bits(_co_occurrence(fps), n, parts)
    pieces = _octets(groups)
    deal = Deal(groups, _distance_tables(_histograms(fps, pieces), n, max_bits), n, max_bits)
    masks = [m - (1 << 64) if m >= 1 << 63 else m for m in deal.masks]

    # the leader of a partition value is its smallest fingerprint
    led = fps
    for k, mask in enumerate(masks):
        led = led.withColumn(f"v{k}", F.col("fp").bitwiseAND(F.lit(mask)))
    value = F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col(f"v{k}").alias("value"))
                                for k in range(parts)])).alias("p")
    index = led.select("fp", value).select("fp", "p.part", "p.value")
    leaders = index.groupBy("part", "value").agg(F.min("fp").alias("leader"))
    near = F.bit_count(F.col("leader").bitwiseXOR(F.col("fp"))) <= max_bits
    labels = saved(index.join(leaders, ["part", "value"]).groupBy("fp").agg(
        *[F.max(F.when(F.col("part") == k, F.when(near, F.col("leader")).otherwise(F.col("fp")))).alias(f"l{k}")
          for k in range(parts)]), "labels")
    label_cols = [f"l{k}" for k in range(parts)]

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 4096):
                b = whole.slice(at, 4096)
                fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
                units = deal.thresholds(_bits(fp))
                packed = units @ (8 ** np.arange(parts))
                lists = [b.column(1 + k) for k in range(parts)]
                for k, group in enumerate(deal.groups):
                    for d in range(max_bits + 1):
                        rows = np.flatnonzero(units[:, k] > d)
                        if not len(rows):
                            break
                        flips = np.array([sum(1 << x for x in c) for c in combinations(group, d)], np.uint64)
                        values = ((fp[rows] & np.uint64(deal.masks[k]))[:, None] ^ flips[None, :]).ravel()
                        again = np.repeat(rows, len(flips))
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(len(again), k, np.int32)), pa.array(values.view(np.int64)),
                             pa.array(fp[again].view(np.int64)), pa.array(packed[again]),
                             *[x.take(pa.array(again)) for x in lists]],
                            ["part", "value", "a", "units", *[f"a{k}" for k in range(parts)]])

    probes = labels.select("fp", *label_cols).mapInArrow(
        probe, "part int, value long, a long, units long, " + ", ".join(f"a{k} long" for k in range(parts)))
    held = labels.select(F.col("fp").alias("b"), *[F.col(f"l{k}").alias(f"b{k}") for k in range(parts)],
                         F.explode(F.array(*[F.struct(F.lit(k).alias("part"), F.col("fp").bitwiseAND(F.lit(m)).alias("value"))
                                             for k, m in enumerate(masks)])).alias("p")) \
        .select("b", *[f"b{k}" for k in range(parts)], "p.part", "p.value")
    apart = F.col("a").bitwiseXOR(F.col("b"))
    found = (probes["part"] == held["part"]) & (probes["value"] == held["value"]) & (F.col("a") < F.col("b")) \
        & (F.bit_count(apart) <= max_bits)
    for k, m in enumerate(masks):
        own = F.shiftright(F.col("units"), 3 * k).bitwiseAND(F.lit(7))
        found = found & ((probes["part"] <= k) | (F.bit_count(apart.bitwiseAND(F.lit(m))) >= own))
        found = found & (F.col(f"a{k}") != F.col(f"b{k}"))
    pairs = probes.join(held, found).select("a", "b")
    stars = labels.select(F.col("fp").alias("b"), F.explode(F.array_distinct(F.array(*label_cols))).alias("a")) \
        .where("a != b").select("a", "b")
    return pairs.unionByName(stars)


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle_words: int = SHINGLE_WORDS,
                    max_bits: int = MAX_BITS) -> DataFrame:
    """One row per document: key, text_sha256, fingerprint (16 hex digits), component_id.

    component_id is the smallest key reachable over links (NULL keys are ignored; NULL
    if the component has no other).  NULL and empty texts have fingerprint zero and link
    like any other.  Repeated rows give repeated results; an empty table none.
    """
    rows = saved(fingerprints(docs, text, key, shingle_words), "fingerprints")
    fps = saved(rows.groupBy("fp").agg(F.min(key).alias("first")), "distinct")
    comps = connected_components(links(fps.select("fp"), max_bits))
    member = fps.join(comps.withColumnRenamed("node", "fp"), "fp", "left") \
        .withColumn("component", F.coalesce("component", "fp"))
    smallest = member.groupBy("component").agg(F.min("first").alias("component_id"))
    by_fp = saved(member.join(smallest, "component").select("fp", "component_id"), "members")
    return rows.join(by_fp, "fp").select(
        key, "text_sha256", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, text: str = "text", key: str = "doc_id", shingle_words: int = SHINGLE_WORDS,
             max_bits: int = MAX_BITS) -> DataFrame:
    """Of every component the document with the smallest key (then digest) stays, with all its columns."""
    rows = saved(near_duplicates(docs, text, key, shingle_words, max_bits)
                 .select(key, "text_sha256", "fingerprint", "component_id"), "components")
    # components without any key are told apart by their fingerprint
    group = F.coalesce(F.col("component_id").cast("string"), F.col("fingerprint"))
    one = rows.groupBy(group.alias("g")).agg(
        F.min(F.struct(F.col(key).isNull().alias("none"), F.col(key).alias("k"), F.col("text_sha256").alias("s"))).alias("m"))
    same = rows.groupBy(key, "text_sha256").agg(F.count("*").alias("n_same"))
    chosen = one.select(F.col("m.k").alias("k"), F.col("m.s").alias("s"))
    stays = same.join(chosen, F.col(key).eqNullSafe(F.col("k")) & (F.col("text_sha256") == F.col("s")), "left_semi")
    return keep_rows(docs, stays, text, key)

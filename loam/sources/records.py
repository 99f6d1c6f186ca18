"""Records of one large text file, found by many tasks at once.

A CSV record may hold line breaks inside quotes and a JSON array is one document, so a task
that starts reading in the middle of such a file does not know whether it stands inside
a quoted text, nor how deep.  Spark's own readers give each such file to a single task.  Here:

1. The file is read in pieces at a separator that every record ends with (a line feed, or ``}``),
   split into byte ranges (blocks) as any text file.
2. Every block is scanned under both assumptions, starting outside or inside quotes, and
   reports for each: where it ends, how much deeper, and the least depth at a separator.
   These reports compose, so running sums over the blocks (one row each) give every
   block's true start.
3. The blocks are read again, each with its true start, and emit their records.  A record that
   crosses a border comes in fragments, which are joined by the block that it starts in;
   nothing else is shuffled.

Both readings must cut the file at the same bytes, whatever the cluster's size at the time, so
the file is read through a session of its own with fixed split sizes.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_FAR = 1 << 40
#: Characters of records that are handed on together.
_HELD = 4 << 20


@dataclass(frozen=True)
class Format:
    """``step(piece, quoted)`` tells whether the piece ends inside quotes, and its depth before and after the separator."""
    sep: str
    ends_with_sep: bool     # the separator belongs to the record
    depth: int              # at the start of a file
    step: Callable[[str, bool], tuple[bool, int, int]]
    trim: str               # pattern of what is not the record's own at its ends


# From inside a quoted field to its closing quote; a doubled quote is text.
_CSV_REST = re.compile(r'(?:[^"]|"")*+"(?!")')


def _csv_step(line: str, quoted: bool) -> tuple[bool, int, int]:
    if '"' not in line:
        return quoted, 0, 0
    at = 0
    while True:
        if quoted:
            end = _CSV_REST.match(line, at)
            if not end:
                return True, 0, 0
            at, quoted = end.end(), False
        # outside: only a quote that starts a field opens one
        elif line.startswith('"', at):
            at, quoted = at + 1, True
            continue
        at = line.find(",", at) + 1
        if not at:
            return False, 0, 0


_JSON_REST = re.compile(r'(?:[^"\\]|\\.)*+"', re.S)
_JSON_TEXT = re.compile(r'"(?:[^"\\]|\\.)*+"', re.S)


def _json_step(piece: str, quoted: bool) -> tuple[bool, int, int]:
    if quoted:
        end = _JSON_REST.match(piece)
        if not end:
            return True, 0, 0
        piece = piece[end.end():]
    if '"' in piece:
        piece = _JSON_TEXT.sub("", piece)
        at = piece.find('"')
        quoted = at >= 0
        piece = piece[:at] if quoted else piece
    else:
        quoted = False
    deeper = piece.count("{") + piece.count("[") - piece.count("]")
    return quoted, deeper, deeper if quoted else deeper - 1


CSV = Format("\n", False, 1, _csv_step, r"\r\Z")
JSON_ARRAY = Format("}", True, 0, _json_step, r"\A[^{]*")


def _pieces(spark: SparkSession, path: str, form: Format) -> DataFrame:
    """(file, block, piece) in the order of the file within each block; splits do not depend on the cluster's size."""
    reader = spark.newSession()
    for name in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes"):
        reader.conf.set(name, spark.conf.get(name))
    reader.conf.set("spark.sql.files.minPartitionNum", "1")
    text = reader.read.option("lineSep", form.sep).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.col("value").alias("piece"))
    # everything but the splits follows the caller's session
    return spark.createDataFrame([], text.schema).unionByName(text)


def _blocks_of(batches: Iterator[pa.RecordBatch], *extra: str) -> Iterator[tuple[tuple, Iterator[str]]]:
    """Runs of rows of one block with their pieces, one by one."""
    def rows():
        for batch in batches:
            yield from zip(*(batch.column(c).to_pylist() for c in ("file", "block", *extra, "piece")))
    for key, run in groupby(rows(), key=lambda r: r[:-1]):
        yield key, (r[-1] for r in run)


def _reports(form: Format):
    step = form.step

    def report(batches):
        for (file, block), pieces in _blocks_of(batches):
            ends, deep, low = [False, True], [0, 0], [_FAR, _FAR]
            for piece in pieces:
                outside = step(piece, ends[0])
                inside = outside if ends[0] == ends[1] else step(piece, ends[1])
                for h, (quoted, _, change) in enumerate((outside, inside)):
                    ends[h] = quoted
                    deep[h] += change
                    if not quoted:
                        low[h] = min(low[h], deep[h])
            yield pa.RecordBatch.from_arrays(
                [pa.array([file]), pa.array([block], pa.int64()), *(pa.array([v]) for v in (*ends, *deep, *low))],
                ["file", "block", "end0", "end1", "deep0", "deep1", "low0", "low1"])
    return report


def block_starts(pieces: DataFrame, form: Format) -> DataFrame:
    """(file, block, quoted, depth, open, owner): how each block starts; one row per block.

    ``open``: it starts inside a record, which began in block ``owner``.
    """
    reports = pieces.mapInArrow(_reports(form), "file string, block long, end0 boolean, end1 boolean, deep0 long, deep1 long, low0 long, low1 long")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    # a block either ends the same way whatever its start, or keeps the start, or turns it round
    fixed = F.col("end0") == F.col("end1")
    turned = F.when(fixed, 0).otherwise(F.col("end0").cast("int"))
    steps = reports.withColumn("turns", F.sum(turned).over(order)) \
        .withColumn("set", F.when(fixed, F.col("end0").cast("int") + F.col("turns")))
    # the last block that decides, and the turns since
    parity = (F.coalesce(F.last("set", ignorenulls=True).over(before), F.lit(0))
              + F.coalesce(F.lag("turns").over(order), F.lit(0))) % 2
    states = steps.withColumn("quoted", parity == 1)
    pick = lambda c: F.when(F.col("quoted"), F.col(f"{c}1")).otherwise(F.col(f"{c}0"))
    states = states.withColumn("depth", form.depth + F.coalesce(F.sum(pick("deep")).over(before), F.lit(0))) \
        .withColumn("open", F.col("quoted") | (F.col("depth") > 1)) \
        .withColumn("closes", F.col("depth") + pick("low") <= 1) \
        .withColumn("ends_open", pick("end") | (F.col("depth") + pick("deep") > 1))
    begins = F.when((~F.col("open") | F.col("closes")) & F.col("ends_open"), F.col("block"))
    return states.select("file", "block", "quoted", "depth", "open", F.last(begins, ignorenulls=True).over(before).alias("owner"))


def _records(form: Format):
    step, sep, trim = form.step, form.sep, re.compile(form.trim)
    closing = sep if form.ends_with_sep else ""

    def emit(batches):
        for (file, block, known, quoted, depth, opened, owner), pieces in _blocks_of(
                batches, "known", "quoted", "depth", "open", "owner"):
            if not known:
                raise RuntimeError("the file was split in another way than before; it must not change while it is read")
            parts: list[str] = []
            out: list[tuple] = []  # (owner, first of the file, text); whole records have no owner
            first, held = block == 0, 0
            for piece in pieces:
                quoted, inner, after = step(piece, quoted)
                if not quoted and depth + inner <= 0:
                    parts.clear()   # the array is closed
                    break
                depth += after
                parts.append(piece)
                if not quoted and depth <= 1:
                    text = sep.join(parts) + closing
                    parts.clear()
                    if not opened:
                        text = trim.sub("", text)
                    if text or opened:
                        out.append((owner if opened else None, first, text))
                        first, held = False, held + len(text)
                    opened = False
                if len(out) >= 1000 or held > _HELD:
                    yield _batch(file, block, out)
                    out, held = [], 0
            if parts:  # goes on in the next block, behind the separator
                out.append((owner if opened else block, first, sep.join(parts) + sep))
            if out:
                yield _batch(file, block, out)
    return emit


def _batch(file: str, block: int, out: list[tuple]) -> pa.RecordBatch:
    owners, first, texts = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array([file] * len(out)), pa.array([block] * len(out), pa.int64()), pa.array(owners, pa.int64()),
                                       pa.array(first), pa.array(texts, pa.string())], ["file", "block", "owner", "first", "value"])


def records(spark: SparkSession, path: str, form: Format) -> DataFrame:
    """(first, value): one row per record; ``first`` marks the first of each file.

    Every block of every file is a part of some task; a file as large as the cluster can hold is read
    by as many tasks as it has blocks.  The states of the blocks are broadcast: one row for each
    ``spark.sql.files.maxPartitionBytes`` of input.
    """
    pieces = _pieces(spark, path, form)
    states = block_starts(pieces, form)
    placed = pieces.join(F.broadcast(states.withColumn("known", F.lit(True))), ["file", "block"], "left")
    parts = placed.select("file", "block", F.coalesce("known", F.lit(False)).alias("known"), "quoted", "depth", "open", "owner", "piece") \
        .mapInArrow(_records(form), "file string, block long, owner long, first boolean, value string")
    whole = parts.where("owner is null").select("first", "value")
    # sorted by block; a record's fragments are no longer than the record
    crossing = parts.where("owner is not null").groupBy("file", "owner").agg(
        F.max(F.col("first") & (F.col("owner") == F.col("block"))).alias("first"),
        F.concat_ws("", F.transform(F.array_sort(F.collect_list(F.struct("block", "value"))), lambda p: p["value"])).alias("value"))
    if not form.ends_with_sep:  # at the end of the file the joint after the last fragment is one too many
        crossing = crossing.withColumn("value", F.regexp_replace("value", rf"{form.sep}\z", ""))
    crossing = crossing.select("first", F.regexp_replace("value", form.trim.replace(r"\Z", r"\z"), "").alias("value"))
    return whole.unionByName(crossing.where("value != ''"))

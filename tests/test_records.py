"""CSV and JSON files read by many tasks against a reader that takes each file whole."""

import csv
import io
import json
import random

import pytest

from loam.sources import readers
from loam.sources.records import CSV, JSON_ARRAY, _pieces, block_starts, records


@pytest.fixture
def small_blocks(spark):
    """Blocks of a few bytes, so that records cross many borders."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}

    def use(size):
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(size))
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield use
    for k, v in old.items():
        spark.conf.set(k, v)


def cell(rng):
    return rng.choice(["", "x", "a b", 'say "hi"', "two\nlines", '"\n"', ",", '","', "\n\n\n", '""', "é\n" * 9, "end\n", "y" * 90, '"', "\r\n", " lead"])


def made(tmp_path, rows, name, newline="\n", last_newline=True):
    out = io.StringIO()
    csv.writer(out, lineterminator=newline).writerows(rows)
    text = out.getvalue()
    path = tmp_path / name
    path.write_bytes((text if last_newline else text[: -len(newline)]).encode())
    return str(path)


@pytest.mark.parametrize("size,newline", [(11, "\n"), (23, "\r\n"), (64, "\n"), (10 ** 6, "\n")])
def test_csv_by_blocks(spark, tmp_path, small_blocks, size, newline):
    rng = random.Random(size)
    rows = [["id", "t", "u"]] + [[str(i), cell(rng), cell(rng)] for i in range(60)]
    path = made(tmp_path, rows, "a.csv", newline, last_newline=size != 64)
    small_blocks(size)
    got = readers.load(spark, path, multi_line=True, all_strings=True, missing=())
    if size < 100:
        assert got.rdd.getNumPartitions() > 20
    # an empty field is missing, as in any of the readers here
    want = [tuple(c if c != "" else None for c in r) for r in rows[1:]]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)
    assert got.columns == rows[0]


def test_csv_folder_each_file_has_a_header(spark, tmp_path, small_blocks):
    (tmp_path / "d.csv").mkdir()
    made(tmp_path / "d.csv", [["a\nb", "c"], ["1", "x\ny"], ["2", "z"]], "p1.csv")
    made(tmp_path / "d.csv", [["a\nb", "c"], ["3", "\n"]], "p2.csv")
    small_blocks(5)
    got = readers.load(spark, str(tmp_path / "d.csv"), multi_line=True)
    assert got.columns == ["a\nb", "c"] and dict(got.dtypes)["a\nb"] == "bigint"
    assert sorted(map(tuple, got.collect())) == [(1, "x\ny"), (2, "z"), (3, "\n")]


def test_csv_quotes_inside_a_plain_field(spark, tmp_path, small_blocks):
    """A quote opens a quoted text only where a field starts."""
    path = tmp_path / "q.csv"
    path.write_text('id,t,u\n1,5" pipe,ok\n2,"a\nb",7" and 8"\n3,x"y"z,"q"\n')
    for size in (4, 1000):
        small_blocks(size)
        got = readers.load(spark, str(path), multi_line=True, all_strings=True)
        assert sorted(map(tuple, got.collect())) == [("1", '5" pipe', "ok"), ("2", "a\nb", '7" and 8"'), ("3", 'x"y"z', "q")]


def test_csv_header_only_and_open_end(spark, tmp_path, small_blocks):
    small_blocks(4)
    (tmp_path / "h.csv").write_text("a,b\n")
    assert readers.load(spark, str(tmp_path / "h.csv"), multi_line=True, all_strings=True).collect() == []
    (tmp_path / "o.csv").write_text('a,b\n1,x\n2,"never\nclosed\n')
    rows = [r["value"] for r in records(spark, str(tmp_path / "o.csv"), CSV).where("not first").collect()]
    assert sorted(rows) == ["1,x", '2,"never\nclosed']


def test_starts_of_blocks(spark, tmp_path, small_blocks):
    """Every block's start against a reading of the whole file."""
    rng = random.Random(5)
    rows = [[str(i), cell(rng)] for i in range(120)]
    path = made(tmp_path, rows, "s.csv")
    small_blocks(40)
    data = open(path, newline="").read().encode()
    got = block_starts(_pieces(spark, path, CSV), CSV).collect()
    assert len(got) > 30
    for r in got:
        # the first line of a block starts behind the first line feed at or after its first byte but one
        at = 0 if r.block == 0 else data.index(b"\n", r.block - 1) + 1 if data[r.block - 1:r.block] != b"\n" else data.index(b"\n", r.block) + 1
        quoted, fresh, i = False, True, 0
        while i < at:
            c = data[i:i + 1]
            if quoted:
                if data[i:i + 2] == b'""':
                    i += 1
                elif c == b'"':
                    quoted = False
            elif c == b'"' and fresh:
                quoted = True
            fresh = not quoted and c in b",\n"
            i += 1
        assert r.quoted == quoted, (r, data[at:at + 30])


def value(rng, depth=0):
    kind = rng.randrange(8 if depth < 3 else 5)
    if kind == 5:
        return {rng.choice(["k", "a}b", 'q"', "n"]): value(rng, depth + 1) for _ in range(rng.randrange(3))}
    if kind == 6:
        return [value(rng, depth + 1) for _ in range(rng.randrange(4))]
    return rng.choice(["", "x", "}", "{", '"', "\\", '\\"}', "],[", "é}", "line\nbreak", 1, 2.5, None, True, "y" * 70])


@pytest.mark.parametrize("size,indent", [(17, 1), (90, None), (10 ** 6, None)])
def test_json_by_blocks(spark, tmp_path, small_blocks, size, indent):
    rng = random.Random(size)
    rows = [{"id": i, "v": json.dumps(value(rng)), "deep": {"w": [{"x": str(value(rng, 3))}], "e": {}}} for i in range(40)]
    path = tmp_path / "a.json"
    path.write_text("  " + json.dumps(rows, indent=indent, ensure_ascii=size == 90) + "\n")
    small_blocks(size)
    got = readers.load(spark, str(path))
    if size < 100:
        assert got.rdd.getNumPartitions() > 20
    want = [(r["id"], r["v"], r["deep"]["w"][0]["x"]) for r in rows]
    assert sorted((r.id, r.v, r.deep.w[0].x) for r in got.collect()) == want
    texts = [json.loads(r.value) for r in records(spark, str(path), JSON_ARRAY).collect()]
    assert sorted(texts, key=lambda r: r["id"]) == rows


def test_json_other_documents(spark, tmp_path):
    for name, text, n in (("e", "[]", 0), ("l", '{"a":1}\n{"a":2}\n', 2), ("n", '[null, {"a":1}]', 2), ("o", '[{"a":1},\n{"a":2}]', 2)):
        (tmp_path / f"{name}.json").write_text(text)
        got = readers.load(spark, str(tmp_path / f"{name}.json"), schema="a int")
        assert got.count() == n or name == "n", name

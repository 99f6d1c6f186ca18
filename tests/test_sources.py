"""Loader dispatch and file formats on small fixtures written per test."""

import json
import os

import pytest

from loam.sources import readers


def test_unknown_extension_raises(spark, tmp_path):
    p = tmp_path / "data.xml"
    p.write_text("<a/>")
    with pytest.raises(ValueError):
        readers.load(spark, str(p))


def test_csv_header_and_types(spark, tmp_path):
    p = tmp_path / "t.CSV"
    p.write_text("Order Date,price,name\n2024-01-02,1.5,a\n2024-01-03,,b\n")
    df = readers.load(spark, str(p))
    assert df.columns == ["Order Date", "price", "name"]
    rows = df.orderBy("name").collect()
    assert rows[0]["price"] == 1.5 and rows[1]["price"] is None


def test_csv_all_strings(spark, tmp_path):
    p = tmp_path / "t.csv"
    p.write_text("a,b\n1,2.5\n3,\n")
    df = readers.load(spark, str(p), all_strings=True)
    assert dict(df.dtypes) == {"a": "string", "b": "string"}


def test_json_document_and_lines(spark, tmp_path):
    doc = tmp_path / "doc.json"
    doc.write_text(json.dumps([{"x": 1, "y": "a"}, {"x": 2, "y": "b"}]))
    lines = tmp_path / "lines.json"
    lines.write_text("\n".join(json.dumps(r) for r in [{"x": 1, "y": "a"}, {"x": 2, "y": None}]))
    assert readers.load(spark, str(doc)).count() == 2
    df = readers.load(spark, str(lines))
    assert df.count() == 2 and df.where("y IS NULL").count() == 1


def test_nan_becomes_null(spark):
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "x double")
    assert readers.normalize_missing(df).where("x IS NULL").count() == 1


def test_sample_is_partition_independent(spark):
    df = spark.range(0, 500).withColumnRenamed("id", "k")
    a = [r["k"] for r in readers.sample_rows(df, ["k"], 7).collect()]
    b = [r["k"] for r in readers.sample_rows(df.repartition(6), ["k"], 7).collect()]
    assert a == b and len(a) == 7


def test_outputs_under_checkpoint_root(spark):
    from loam.sources.sinks import output_root
    assert output_root(spark).startswith(spark.sparkContext.getCheckpointDir())
    assert os.path.basename(output_root(spark)) == "loam-output"

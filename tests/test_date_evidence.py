"""Evidence for date columns: one pass over (column, text) rows, whatever the number of columns."""

from loam.operators import semantic_types as ST

VALUES = [None, "2024-01-05", " 2024-01-05 ", "Fri, 5 Jan 2024", "Friday 5.1.2024", "20240105", " 20240105", "$1,234.50", "12", "",
          "3.1.24", "mon", "Monday, March 5, 2024", "x" * 50, "5" * 41, "31/12/2024"]


def test_counts_by_shape_are_those_of_the_values(spark):
    df = spark.createDataFrame([(v, v and v[::-1]) for v in VALUES], "a string, `b c` string")
    for column, texts in (("a", VALUES), ("b c", [v and v[::-1] for v in VALUES])):
        got = ST._shape_counts(df, ["a", "b c"])[column]
        numbers = {"20240105", "$1,234.50", "12", "5" * 41, "50104202", "21"}
        assert [sum(r[k] for r in got) for k in ("n_rows", "non_null", "numeric_like")] == [
            len(texts), len(texts) - 1, sum(t in numbers for t in texts)]
    seen = ST._shape_counts(df, ["a"])["a"]
    shapes = {}
    for r in seen:
        shapes[r["shape"]] = shapes.get(r["shape"], 0) + r["n_rows"]
    assert shapes == {"9999-99-99": 2, "9 AAA 9999": 1, "9.9.9999": 1, "99999999": 2, "9.9.99": 1, "AAAAA 9, 9999": 1,
                      "99/99/9999": 1, None: len(VALUES) - 9}


def test_many_columns_are_one_short_pass(spark, monkeypatch):
    frames = []
    real = ST.with_shapes
    monkeypatch.setattr(ST, "with_shapes", lambda df, text: frames.append(df.columns) or real(df, text))
    columns = [f"c{i}" for i in range(40)]
    df = spark.createDataFrame([tuple(f"{d}/1/2024" for _ in columns) for d in (13, 14)], ", ".join(f"{c} string" for c in columns))
    rows = ST.detect_column_types(df, count_all=False).collect()
    assert [(r["column_name"], r["semantic_type"], r["date_format"], r["datetime_like"]) for r in rows] == [
        (c, "datetime", "d/M/yyyy", 2) for c in columns]
    assert frames == [["at", "text"]]


def test_no_rows_still_give_a_row_for_each_column(spark):
    rows = ST.type_evidence(spark.createDataFrame([], "t string, n long"), ["t", "n"]).collect()
    assert [(r["column_name"], r["kind"], r["n_rows"], r["non_null"], r["datetime_like"]) for r in rows] == [
        ("t", "string", 0, 0, 0), ("n", "number", 0, 0, 0)]

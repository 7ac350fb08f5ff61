import pytest
from pyspark.sql import functions as F

from gristmill.sources.columns import MissingColumn, column_index, document_text, parse_line, read_columns


def test_lines():
    assert parse_line('a,"b, c","d ""e""",') == ["a", "b, c", 'd "e"', ""]
    assert parse_line(' a"b,c"d,v,1') == [" ab,cd", "v", "1"]
    assert parse_line('x,"open, to the end') == ["x", "open, to the end"]
    assert parse_line("") == [""]


def write(tmp_path, text):
    p = tmp_path / "f.csv"
    p.write_text(text, encoding="utf-8")
    return str(p)


def rows(df):
    return sorted(map(tuple, df.collect()))


def test_columns(spark, tmp_path):
    path = write(tmp_path, ' Key ,other,VALUE\n k1 ,x,"v, 1"\n,x,dropped\n k2,x,\n short,x\n\tk3\t,"a ""b""",\t v3\n')
    assert rows(read_columns(spark, path, "key", "value")) == [("k1", "v, 1"), ("k2", ""), ("k3", "v3")]
    assert rows(read_columns(spark, path, "KEY", "value", strict=False)) == [("k1", "v, 1"), ("k2", ""), ("k3", "v3"), ("short", "")]
    assert rows(read_columns(spark, path, "key")) == [("k1",), ("k2",), ("k3",), ("short",)]
    with pytest.raises(MissingColumn):
        read_columns(spark, path, "key", "nothing")


def test_empty_files(spark, tmp_path):
    assert read_columns(spark, write(tmp_path, ""), "key", "value").count() == 0
    assert read_columns(spark, write(tmp_path, "key,value\n"), "key", "value").count() == 0
    assert column_index([" A ", "b"], "a") == 0 and column_index([], "a") == -1


def test_document_text(spark):
    df = spark.createDataFrame([("t", "b"), (None, "b"), ("t", None), (None, None)], "t string, b string")
    assert [r[0] for r in df.select(document_text(F.col("t"), F.col("b"))).collect()] == ["t b", " b", "t ", " "]


def test_only_the_first_line_is_the_header(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    for name, text in (("a.csv", "id,v\n1,a\nid,v\n2,b\n"), ("b.csv", "id,v\n3,c\n"), ("c.csv", "id,v\n")):
        (folder / name).write_text(text)
    assert rows(read_columns(spark, str(folder), "id", "v")) == [("1", "a"), ("2", "b"), ("3", "c"), ("id", "v")]


def test_lines_of_a_table_and_back(spark):
    from gristmill.sources.columns import csv_line, parse_lines

    df = spark.createDataFrame([(1, 'a "b", c', None), (2, "", "x\ny"), (3, None, ",")], "n int, a string, b string")
    got = parse_lines(df.select("n", csv_line(F.col("a"), F.col("b")).alias("line")), "line")
    assert {r.n: r.fields for r in got.collect()} == {1: ['a "b", c', ""], 2: ["", "x y"], 3: ["", ","]}
    assert parse_lines(spark.createDataFrame([(None,)], "line string"), "line").first().fields is None

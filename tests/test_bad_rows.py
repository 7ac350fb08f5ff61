import csv

import pytest

from gristmill.sources.bad_rows import assemble, claim_fields, load_record, load_records, parse

FIELDS = claim_fields(["NEI", "SUPPORT"])
GOOD = '7,"A claim, ""quoted""",12,NEI,"[1, 2]",[]'


@pytest.mark.parametrize(
    "line, reason",
    [
        (GOOD, None),
        (GOOD + "\r\n", None),
        ('7,"two\nlines",,,[],[]', None),
        ("7,a\nb,,,[],[]", None),
        (' 7 , x ,  , SUPPORT ," [ 1 , 2 ] ",[]', None),
        ('7,"x",,,"[]","[ ]"', None),
        ("99999999999999999999999,x,,,[],[]", None),
        ('7,"open,,,[],[]', "quoting"),
        ('7,"x" ,,,[],[]', "quoting"),
        ('7, "x",,,[],[]', "quoting"),
        ('7,a"b,,,[],[]', "quoting"),
        ('7,"a"b",,,[],[]', "quoting"),
        ('7,"a"b",,', "quoting"),
        ("7,x,,,[]", "columns"),
        ("7,x,,,[],[],", "columns"),
        ("", "columns"),
        (None, "columns"),
        ("7\tx\t\t\t[]\t[]", "columns"),
        ("x,x,,,[],[]", "value"),
        (",x,,,[],[]", "value"),
        ("٣,x,,,[],[]", "value"),
        ("7,,,,[],[]", "value"),
        ("7,123...,,,[],[]", "value"),
        ("7,x�,,,[],[]", "value"),
        ("7,x\x07,,,[],[]", "value"),
        ("7,x\ty,,,[],[]", None),
        ("7,x,n/a,,[],[]", "value"),
        ("7,x,,nei,[],[]", "value"),
        ('7,x,,,"[1,]",[]', "value"),
        ('7,x,,,"[1 2]",[]', "value"),
        ("7,x,,,,[]", "value"),
        ("7,x,,,[],[-1]", "value"),
    ],
)
def test_reasons(line, reason):
    assert load_record(line, FIELDS)[0] == reason


def test_values():
    assert load_record(GOOD, FIELDS)[1] == [7, 'A claim, "quoted"', 12, "NEI", [1, 2], []]
    assert load_record("99999999999999999999999,x,,,[9223372036854775808],[1]", FIELDS)[1] == [None, "x", None, None, [None], [1]]


def test_line_breaks_are_put_back():
    body, marks = assemble('1,"a\r\nb"\n')
    assert "\n" not in body and marks
    assert parse('1,"a\r\nb",\n') == ["1", "a\r\nb", ""]
    with pytest.raises(csv.Error):
        parse('"')


def test_table(spark):
    long = "7,x" + "y" * 400_000 + ",,,[],[]"
    rows = [(1, GOOD, "k"), (2, "bad", None), (3, None, "k"), (None, GOOD, "k"), (1, GOOD, "k"), (4, long, "k"), (5, "", "k")]
    df = spark.createDataFrame(rows, "line_no bigint, line string, reason string").selectExpr("*", "'c' as claim", "1 as id", "2 as __line")
    every = load_records(df, FIELDS)
    assert every.columns == ["line_no", "reason", "id", "claim", "evidence_doc_id", "evidence_label", "evidence_sentences", "cited_doc_ids"]
    got = sorted(((r.line_no or 0, r.reason, r.id) for r in every.collect()), key=str)
    assert got == sorted([(1, None, 7), (1, None, 7), (0, None, 7), (2, "columns", None), (3, "columns", None), (4, None, 7), (5, "columns", None)], key=str)
    assert {(r.line_no, r.reason) for r in load_records(df, FIELDS, want="failed").collect()} == {(2, "columns"), (3, "columns"), (5, "columns")}
    assert load_records(df, FIELDS, want="loaded").count() == 4
    assert load_records(df.limit(0), FIELDS).count() == 0
    with pytest.raises(ValueError):
        load_records(df, FIELDS, keep=["line_no", "reason"])


def test_loaded_and_failed_are_all(spark, data):
    from gristmill.plans.problems import p2_found, p2_loaded

    assert p2_found(spark, data).count() + p2_loaded(spark, data).count() == spark.read.parquet(f"{data}/claims_raw.parquet").count()


def test_numbers_with_leading_zeros_and_beyond_bigint(spark):
    zeros = "0" * 25 + "1"
    assert load_record(f"{zeros},x,{zeros},,[{zeros}],[0]", FIELDS)[1] == [1, "x", 1, None, [1], [0]]
    df = spark.createDataFrame([(1, GOOD), (2, f"{10**30},x,,,[1],[{10**19}]"), (3, "7,x,,,[],[]"), (4, "broken")], "line_no bigint, line string")
    got = {r.line_no: r.beyond for r in load_records(df, FIELDS, beyond="beyond").collect()}
    assert got == {1: None, 2: "id,cited_doc_ids", 3: None, 4: None}


@pytest.mark.parametrize("block", [7, 20, 64, 1 << 20])
def test_records_are_assembled_from_lines(spark, tmp_path, block):
    from gristmill.sources.bad_rows import read_records

    records = ['1,"two\nlines",,,[],[]', "2,plain,,,[],[]", '3,"a ""quoted""\n\nand, long\n one over blocks",,,[],[]', "", '4,"x\r\ny",,,[],[]', '"' + "z\n" * 40 + '",5'] * 3
    (tmp_path / "a.csv").write_bytes(("\n".join(records) + "\n").encode())
    (tmp_path / "b.csv").write_bytes(b'6,"never closed\n7,x')
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(block))
    try:
        rows = read_records(spark, str(tmp_path)).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    got = [r.line for r in sorted(rows, key=lambda r: (r.file, r.start, r.nth))]
    assert got == [*records, '6,"never closed\n7,x']

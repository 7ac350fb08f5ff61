import random
import re

import pytest

from gristmill.operators.packed import Field, infer_delimiters, unpack

FIELDS = [Field("c"), Field("e", quoted=True)]


def by_grammar(text, quoted):
    if text is None:
        return []
    pattern = "\"(?:[^\"]|\"\")*\"|'(?:[^']|'')*'|“[^”]*”|[0-9]+" if quoted else "[0-9]+"
    out = []
    for x in re.findall(pattern, text):
        out.append(x[1:-1].replace('""', '"') if x[0] == '"' else x[1:-1].replace("''", "'") if x[0] == "'" else x[1:-1] if x[0] == "“" else x)
    return out


def rows_of(df):
    return sorted(((r.id, r.field, r.pos, r.item) for r in df.collect()), key=str)


def want(rows):
    return sorted(((i, f, k, x) for i, c, e in rows for f, t, q in (("c", c, False), ("e", e, True)) for k, x in enumerate(by_grammar(t, q), 1)), key=str)


CASES = ["[1,2]", "('3'; '4')", '{"5" | 6}', "7 8\t9\n10", None, "", "[]", "[ , ;]", "1,,2,", "7, 7, 7", "x12y, n/a", "['13']", "“Results, 14”, “A | B”", '"so-called ""core"" set; 1" ; 3', "'Patients'' data; 9'/2", "\"Authors' note\", 5", "\"open, 4, '6'", "it's 5, 'x'", "doc12:13", '"",5', "٣,4"]


def test_cases(spark):
    rows = [(i, t, u) for i, (t, u) in enumerate(zip(CASES, reversed(CASES)))]
    assert rows_of(unpack(spark.createDataFrame(rows, "id bigint, c string, e string"), FIELDS)) == want(rows)


def test_random_strings(spark):
    rng = random.Random(1)
    parts = ["1", "22", "'a'", '"b, c"', "“d”", ",", ";", "|", " ", "/", "\t", "[", "]", "'", '"', "x", "\n", "''", '""']
    rows = [(i, "".join(rng.choices(parts, k=rng.randrange(9))), "".join(rng.choices(parts, k=rng.randrange(9)))) for i in range(600)]
    assert rows_of(unpack(spark.createDataFrame(rows, "id bigint, c string, e string"), FIELDS)) == want(rows)


def test_repeats_nulls_long_and_clashing_columns(spark):
    long = ",".join(map(str, range(60_000)))
    rows = [(1, "5", "6", 2), (1, "9", "9", 3), (1, "5", "6", 2), (None, "1", None, 1), (2, long, '"' + "q" * 200_000 + '"', 1)]
    df = spark.createDataFrame(rows, "id bigint, c string, e string, t int").selectExpr("*", "1 as pos", "2 as item", "3 as field", "4 as source", "5 as v")
    got = unpack(df, FIELDS, order="t")
    assert [tuple(r) for r in got.where("id = 1").orderBy("field").collect()] == [(1, "c", 1, "5"), (1, "e", 1, "6")]
    assert got.where("id = 2").count() == 60_001 and got.where("id is null").count() == 1
    assert unpack(df.limit(0), FIELDS).count() == 0


def test_delimiters_by_source(spark):
    rows = [(i, "1;2;3" if i % 2 else "4|5", None, "a" if i % 2 else "b") for i in range(20)] + [(99, "7/8;9", None, None)]
    df = spark.createDataFrame(rows, "id bigint, c string, e string, s string")
    found = {(r.source, r.delimiter): r.accepted for r in infer_delimiters(df, FIELDS, "s").collect()}
    assert found[("a", ";")] and found[("b", "|")] and ("a", "|") not in found
    assert rows_of(unpack(df, FIELDS, source="s")) == want([r[:3] for r in rows])


def test_the_delimiters_decide(spark):
    rows = [(1, "1,2", "'a';\"b, c\""), (2, "3;4", "5|6"), (3, "[7, 8]", "9")]
    df = spark.createDataFrame(rows, "id bigint, c string, e string")
    right = {"c": [",", ";"], "e": [";", "|"]}
    flagged = lambda d: sorted(map(tuple, unpack(df, FIELDS, delimiters=d, unclean="flag").collect()), key=str)
    assert [r[:4] for r in flagged(right)] == want(rows) and all(r[4] for r in flagged(right))
    wrong = flagged({"c": [","], "e": [";"]})
    assert [r for r in wrong if not r[4]] == [(2, "c", None, "3;4", False), (2, "e", None, "5|6", False)]
    assert rows_of(unpack(df, FIELDS, delimiters={"c": [","], "e": [";"]})) == want(rows)
    with pytest.raises(ValueError):
        unpack(df, FIELDS, unclean="drop")


def test_a_sign_within_values_is_no_delimiter(spark):
    rows = [(i, f"v{i}.a, v{i}.b", None) for i in range(30)] + [(100 + i, f"{i}, {i + 1}", None) for i in range(30)] + [(200, "1;2", None)]
    got = {r.delimiter: (r.accepted, r.rows) for r in infer_delimiters(spark.createDataFrame(rows, "id bigint, c string, e string"), [Field("c")]).collect()}
    assert got == {",": (True, 30), ".": (False, 30), ";": (True, 1), " ": (False, 30)} or not got["."][0] and got[","][0] and got[";"][0]

from gristmill.llm import canonical

SCHEMA = "id bigint, claim string"


def keeps(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 as keep", "2 as flat", "'x' as leaves", "3 as node")
    return {r.id: r.keep_id for r in canonical.same_records(df).collect()}


def test_same_text_in_other_looks(spark):
    rows = [(1, "A claim (of 1.5 mg)."), (2, "a CLAIM of\n1.5mg"), (3, "A claim of 15 mg"), (4, "a claim of 1,5 mg"), (5, "Straße"), (6, "STRASSE"), (7, "a claim of 1.5 mg!")]
    assert keeps(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6, 7: 1}


def test_field_order(spark):
    rows = [
        (1, "population: adults; exposure: drug; outcome: pain"),
        (2, "OUTCOME = pain | POPULATION = adults |\nEXPOSURE = Drug."),
        (3, "exposure: adults; population: drug; outcome: pain"),
        (4, "population: adults; population: adults; outcome: pain"),
        (5, "population: adults; outcome: pain; outcome: pain"),
        (6, "population adults exposure drug outcome pain"),
        (7, "exposure drug; population: adults; outcome: pain"),
        (8, "population: adults"),
        (9, "- outcome : pain ; “exposure”; population=adults"),
        (10, "* exposure : drug | * outcome : pain | * population : adults | "),
        (11, "pain outcome: x; population: y"),
    ]
    got = keeps(spark, rows)
    assert {i for i, k in got.items() if k == 1} == {1, 2, 10}
    # 6 has the letters of 1, but no fields: another record.
    assert all(got[i] == i for i in (3, 4, 5, 6, 7, 8, 9, 11))


def test_a_lost_separator_makes_another_record(spark):
    # 2 and 3 have one folded text, but other fields.
    rows = [(4, "exposure: b; population: a outcome: c"), (3, "population: a outcome: c; exposure: b"), (2, "population: a; outcome: c; exposure: b"), (1, "outcome: c; exposure: b; population: a"), (5, "alone")]
    assert keeps(spark, rows) == {1: 1, 2: 1, 3: 3, 4: 3, 5: 5}


def test_nulls_repeats_empty_long(spark):
    long = "x" * 500_000
    rows = [(1, None), (2, ""), (3, "?!"), (None, "a"), (4, "a"), (4, "a"), (5, "A"), (6, long), (7, long + "."), (8, ";;|")]
    assert keeps(spark, rows) == {4: 4, 5: 4, 6: 6, 7: 6}
    assert keeps(spark, []) == {}
    df = spark.createDataFrame(rows, SCHEMA)
    assert {(r.keep_id, r.n_copies) for r in canonical.collapse(df).collect()} == {(4, 2), (6, 2)}


def test_one_digest_for_two_forms_is_told_apart(spark, monkeypatch):
    from pyspark.sql import functions as F

    real = canonical.digests
    monkeypatch.setattr(canonical, "digests", lambda *a: real(*a).withColumn("root", F.when(F.col("id") < 5, "one").otherwise(F.col("root"))))
    assert keeps(spark, [(1, "x"), (2, "y"), (3, "X"), (4, "y."), (5, "z"), (6, "Z")]) == {1: 1, 2: 2, 3: 1, 4: 2, 5: 5, 6: 5}


def test_of_several_texts_of_an_id_the_smallest_counts(spark):
    assert keeps(spark, [(1, "b"), (1, "a"), (2, "A"), (3, "B")]) == {1: 1, 2: 1, 3: 3}

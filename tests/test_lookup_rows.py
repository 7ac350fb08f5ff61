from gristmill.plans.queries import QUERIES


def test_every_row_asked_for_is_searched(spark, tmp_path):
    fox, dog = "the quick brown fox jumps over the lazy dog", "an entirely different claim about sleeping dogs"
    rows = [(7, fox), (200, fox), (300, fox.upper()), (8, fox + "s"), (100, dog), (101, dog)]
    spark.createDataFrame(rows, "id bigint, claim string").write.parquet(str(tmp_path / "claims_test.parquet"))
    got = {(r.q, r.id) for r in QUERIES["similar_lookup_rows"](spark, str(tmp_path)).collect()}
    # Ids 200 and 300 are copies of 7: their class is headed by an id that isn't divisible by 100.
    assert got == {(200, 7), (200, 8), (300, 7), (300, 8), (100, 100)}
    assert {r.q for r in QUERIES["similar_lookup"](spark, str(tmp_path)).collect()} == {100}

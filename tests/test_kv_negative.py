from gristmill.operators import kv


def test_operations_with_negative_seq_have_results(spark):
    log = [(-7, "put", "a", "1"), (-5, "get", "a", None), (-1, "delete", "a", None), (0, "get", "a", None), (3, "put", "b", "2"), (12, "get", "b", None)]
    ops = kv.operations(spark.createDataFrame(log, "seq bigint, op string, key string, value string"))
    want = {(-7, None, False), (-5, "1", True), (-1, "1", True), (0, None, False), (3, None, False), (12, "2", True)}
    for stretch in (2, 5, 100):
        assert {(r.seq, r.result, r.existed) for r in kv.results(ops, stretch).collect()} == want

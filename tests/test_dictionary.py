import pytest

from gristmill.operators import dictionary
from gristmill.operators.dictionary import Dictionary, DuplicateKeys, keep_first


def look(d, spark, keys):
    return {r.k: (r.value, r.found) for r in d.lookup(spark.createDataFrame([(k,) for k in keys], "k string"), "k").collect()}


@pytest.mark.parametrize("limit", [dictionary.BROADCAST_BYTES, 0])
def test_lookup(spark, monkeypatch, limit):
    monkeypatch.setattr(dictionary, "BROADCAST_BYTES", limit)
    d = Dictionary.of_lists(spark, ["alpha", "", "日本", "nothing"], ["1", "2", "3", None])
    assert look(d, spark, ["alpha", "", "日本", "nothing", "x"]) == {"alpha": ("1", True), "": ("2", True), "日本": ("3", True), "nothing": (None, True), "x": (None, False)}


def test_a_large_dictionary_is_not_broadcast(spark, monkeypatch):
    monkeypatch.setattr(dictionary, "BROADCAST_BYTES", 0)
    d = Dictionary.of_lists(spark, ["a"], ["1"])
    plan = d.lookup(spark.createDataFrame([("a",)], "k string"), "k")._jdf.queryExecution().optimizedPlan().toString()
    assert "broadcast" not in plan


def test_bad_input(spark):
    with pytest.raises(ValueError):
        Dictionary.of_lists(spark, ["a"], [])
    with pytest.raises(DuplicateKeys):
        Dictionary.of_lists(spark, ["a", "a"], ["1", "2"])
    empty = Dictionary.of_lists(spark, [], [])
    assert look(empty, spark, ["a"]) == {"a": (None, False)} and empty.secondary_space() == 0


def test_space(spark):
    d = Dictionary.of_lists(spark, [f"k{i}" for i in range(1000)], list(map(str, range(1000))))
    assert d.secondary_space() == 1488
    b = d.buckets().collect()
    assert (len(b), max(r.records for r in b)) == (787, 4)
    items = Dictionary.of_lists(spark, [f"item_{i}" for i in range(5000)], [""] * 5000)
    assert items.secondary_space() == 9308 < 10 * 5000


def test_keep_first(spark):
    df = spark.createDataFrame([(3, "a", "x"), (1, "a", "y"), (2, "b", None), (4, None, "z"), (1, "a", "y")], "n int, k string, v string")
    assert sorted(map(tuple, keep_first(df, "k", "n").collect())) == [(1, "a", "y"), (2, "b", None)]
    assert [tuple(r) for r in keep_first(df, "k", "n", 1).collect()] == [(1, "a", "y")]
    assert keep_first(df.limit(0), "k", "n").count() == 0

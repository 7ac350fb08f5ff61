import random

import pytest

from pyspark.sql import functions as F

from gristmill.operators import kv
from gristmill.sources.kv_store import KvStore

LOG = "seq bigint, op string, key string, value string"


def random_log(n, keys=500, seed=42):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        k, x = f"k{rng.randrange(keys)}", rng.random()
        op = "put" if x < 0.5 else "get" if x < 0.8 else "delete"
        rows.append((i, op, k, f"v{rng.randrange(100000)}" if op == "put" else None))
    return rows


def replay(rows):
    live, seen = {}, {}
    for seq, op, k, v in sorted(rows):
        seen[seq] = (live.get(k), k in live)
        if op == "put":
            live[k] = v
        elif op == "delete":
            live.pop(k, None)
    return live, seen


@pytest.mark.parametrize("stretch", [7, 1000, kv.STRETCH])
def test_random_operations_against_a_dict(spark, stretch):
    rows = random_log(5000)
    live, seen = replay(rows)
    ops = kv.operations(spark.createDataFrame(rows, LOG))
    assert {r.key: r.value for r in kv.snapshot(ops).collect()} == live
    assert {r.seq: (r.result, r.existed) for r in kv.results(ops, stretch).collect()} == seen


def test_one_hot_key(spark):
    rows = [(i, ["put", "get", "delete", "get"][i % 4], "hot", f"v{i}" if i % 4 == 0 else None) for i in range(4000)]
    _, seen = replay(rows)
    got = kv.results(kv.operations(spark.createDataFrame(rows, LOG)), 50)
    assert {r.seq: (r.result, r.existed) for r in got.collect()} == seen


def test_merge_in_batches_equals_one_snapshot(spark):
    rows = random_log(2000, 100, 5)
    table = spark.createDataFrame([], "key string, value string, seq bigint")
    for lo in range(0, 2000, 700):
        table = kv.merge(table, kv.operations(spark.createDataFrame(rows[lo : lo + 700], LOG)))
    assert {r.key: r.value for r in table.collect()} == replay(rows)[0]


def test_edge_operations(spark):
    rows = [(1, "PUT ", "", ""), (1, "put", "", ""), (2, "put", "ключ", "значение"), (3, "put", " k", None), (4, "put", None, "x"), (None, "put", "y", "x"), (5, "drop", "", "x"), (6, None, "", "x"), (7, "put", "日本", "x" * 300000)]
    ops = kv.operations(spark.createDataFrame(rows, LOG))
    assert {r.key: r.value for r in kv.snapshot(ops).collect()} == {"": "", "ключ": "значение", " k": "", "日本": "x" * 300000}
    empty = kv.operations(spark.createDataFrame([], LOG))
    assert kv.snapshot(empty).count() == kv.results(empty).count() == 0
    assert kv.merge(kv.snapshot(empty), empty).count() == 0


def test_get_many(spark):
    ops = kv.operations(spark.createDataFrame([(1, "put", "a", "1"), (2, "put", "b", "")], LOG))
    probes = spark.createDataFrame([("a",), ("a",), ("b",), ("c",), (None,)], "key string")
    got = sorted(kv.get_many(kv.snapshot(ops), probes).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([("a", "1", True), ("a", "1", True), ("b", "", True), ("c", None, False), (None, None, False)], key=str)


def split_by_hand(pairs, page):
    from gristmill.functions.hashing import spread_hashes

    h = spread_hashes([k for k, _ in pairs])
    size = [len(k.encode()) + len(v.encode()) + 9 for k, v in pairs]
    out = []

    def go(depth, prefix):
        own = [i for i in range(len(pairs)) if int(h[i]) & ((1 << depth) - 1) == prefix]
        total = sum(size[i] for i in own)
        if total + 8 > page and depth < 24:
            go(depth + 1, prefix)
            go(depth + 1, prefix | 1 << depth)
        else:
            out.append((depth, prefix, len(own), total))

    go(0, 0)
    return sorted(out)


def test_layout(spark):
    pairs = [(f"key{i}", f"value{i}") for i in range(200)]
    table = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "key string, value string, seq bigint")
    buckets = kv.layout(table, 512)
    assert sorted(map(tuple, buckets.collect())) == split_by_hand(pairs, 512)
    assert tuple(kv.layout_summary(buckets).first()) == (4, 16)
    assert [tuple(r) for r in kv.layout(table.limit(0), 512).collect()] == [(0, 0, 0, 0)]
    assert kv.layout(table, 1).count() == 16  # pages below 512 bytes count as 512


def test_store(spark, tmp_path):
    path = str(tmp_path / "table")
    store = KvStore(spark, path, page_bytes=100)
    assert store.page_bytes == 512 and store.get("a") is None and store.table().count() == 0
    store.put("a", "1")
    store.put("b", "2")
    store.put("a", "long value")
    again = KvStore(spark, path, page_bytes=4096)
    assert again.page_bytes == 512
    assert again.get("a") == "long value" and again.get("b") == "2"
    assert again.delete("a") is True and again.delete("a") is False and store.get("a") is None
    store.put_all(spark.createDataFrame([(2, "x", "new"), (1, "x", "old"), (3, "b", "3")], "n int, k string, v string"), "k", "v", "n")
    assert store.get("x") == "new" and store.get("b") == "3"
    store.compact()
    assert {r.key for r in store.table().collect()} == {"b", "x"}
    assert tuple(kv.layout_summary(store.layout()).first()) == (0, 1)
    store.destroy()
    assert not (tmp_path / "table").exists()


def test_point_look_up_is_pushed_to_the_files(spark, tmp_path):
    store = KvStore(spark, str(tmp_path / "t"))
    store.put("a", "1")
    plan = store.table().where("key = 'a'")._jdf.queryExecution().toString()
    assert "EqualTo(key,a)" in plan


def test_a_change_that_fails_before_the_pointer_leaves_the_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    store = KvStore(spark, path)
    store.put("a", "1")

    def killed(self, meta):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(KvStore, "_publish", killed)
        with pytest.raises(RuntimeError):
            store.put("a", "2")
    again = KvStore(spark, path)
    assert again.get("a") == "1"
    again.put("b", "3")
    assert {r.key: r.value for r in store.table().collect()} == {"a": "1", "b": "3"}


def test_two_writers_cannot_make_one_version(spark, tmp_path):
    from gristmill.sources.kv_store import ConcurrentChange

    store = KvStore(spark, str(tmp_path / "t"))
    meta = store.meta() | {"number": 1}
    store._publish(meta)
    with pytest.raises(ConcurrentChange):
        store._publish(meta)
    assert store.meta()["number"] == 1


def test_a_look_up_needs_one_file_of_the_base(spark, tmp_path):
    import pyarrow.parquet as pq

    store = KvStore(spark, str(tmp_path / "t"), partitions=4)
    store.apply(spark.range(4000).selectExpr("id as seq", "'put' as op", "format_string('k%06d', hash(id) % 100000) as key", "'v' as value"))
    store.compact()
    files = sorted((tmp_path / "t" / store.meta()["base"]).glob("*.parquet"))
    ranges = sorted((s.min, s.max) for f in files for s in [pq.ParquetFile(f).metadata.row_group(0).column(0).statistics])
    assert len(ranges) == 4 and all(a[1] < b[0] for a, b in zip(ranges, ranges[1:]))
    assert store.get(ranges[2][0]) == "v"


def test_many_small_changes_fold(spark, tmp_path):
    from gristmill.sources import kv_store

    store = KvStore(spark, str(tmp_path / "t"))
    want = {}
    for i in range(kv_store.MAX_DELTAS + 3):
        k = f"k{i % 4}"
        if i % 5 == 4:
            store.delete(k)
            want.pop(k, None)
        else:
            store.put(k, str(i))
            want[k] = str(i)
    assert {r.key: r.value for r in store.table().collect()} == want
    assert len(store.meta()["deltas"]) <= kv_store.MAX_DELTAS and store.meta()["base"]


def test_file_sizes(spark):
    df = spark.createDataFrame([(0,), (504,), (505,), (1016,), (1017,), (100_000,)], "b bigint")
    assert [r[0] for r in df.select(kv.file_bytes(F.col("b"), 512)).collect()] == [512, 512, 1024, 1024, 2048, 131072]


def test_layout_of_uneven_tables(spark):
    pairs = [(f"k{i}", "v" * (2000 if i % 50 == 0 else 1)) for i in range(400)]
    table = spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(pairs)], "key string, value string, seq bigint")
    assert sorted(map(tuple, kv.layout(table, 512).collect())) == split_by_hand(pairs, 512)

from gristmill.operators import neardup
from gristmill.sources.kv_store import KvStore
from gristmill.streaming.faces import index_stream, upsert_stream

LOG = "seq bigint, op string, key string, value string"


def test_upserts_of_a_stream(spark, tmp_path):
    src = str(tmp_path / "src")
    store = KvStore(spark, str(tmp_path / "table"))
    (tmp_path / "src").mkdir()
    log = spark.readStream.schema(LOG).parquet(src)
    for rows in ([(1, "put", "a", "1"), (2, "put", "b", "2")], [(1, "delete", "a", None), (2, "put", "b", "3")]):
        spark.createDataFrame(rows, LOG).coalesce(1).write.mode("append").parquet(src)
        q = upsert_stream(spark.readStream.schema(LOG).parquet(src), store, str(tmp_path / "cp")).trigger(availableNow=True).start()
        q.awaitTermination(120)
    assert log.isStreaming
    assert {r.key: r.value for r in store.table().collect()} == {"b": "3"}


def test_index_of_a_stream(spark, tmp_path):
    src, out = str(tmp_path / "src"), str(tmp_path / "sigs")
    spark.createDataFrame([(1, "the quick brown fox jumps over the lazy dog"), (2, "something else entirely, no doubt")], "id bigint, t string").write.parquet(src)
    stream = spark.readStream.schema("id bigint, t string").parquet(src)
    index_stream(stream, "id", "t", out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination(120)
    sigs = spark.read.parquet(out)
    probe = spark.createDataFrame([(9, "the quick brown fox leaps over the lazy dog")], "id bigint, t string")
    q = neardup.signatures(neardup.shingle_sets(probe, "id", "t"), neardup.Params())
    assert [(r.q, r.id) for r in neardup.similar_to(q, sigs).collect()] == [(9, 1)]

"""A durable keyed table: a sorted base, deltas of later changes, and numbered pointers that name what is current."""

from __future__ import annotations

import json
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gristmill.operators import kv

SCHEMA = "key string, value string, seq bigint"
CHANGES = "key string, value string, seq bigint, op string"
#: Deltas that a reader merges at most; one more makes the next change fold them.
MAX_DELTAS = 8
#: Share of the base's records from which deltas are folded into the base, not only into one another.
FOLD_SHARE = 0.25


class ConcurrentChange(RuntimeError):
    """Another writer has made the next version first; nothing was changed."""


class KvStore:
    """Opens the table at ``path``, or creates it empty.

    A change writes one delta with the latest put or delete of each key it touches, so its cost is that of the
    change, not of the table; deltas are folded from time to time.  Base and deltas are cut into ranges of keys
    and sorted, with Parquet statistics and Bloom filters of the key: a look-up's filter reaches the files and
    skips all but the range that may hold the key.

    A version is a file ``meta-<number>.json`` that is written under another name and then renamed; the highest
    number counts.  A change that fails before the renaming leaves the table as it was, whatever it has
    written; two writers of the same number can't both succeed.  Readers of an older version aren't
    disturbed until ``compact``.  The page size is kept with the table and only used by its layout.
    """

    def __init__(self, spark: SparkSession, path: str, page_bytes: int | None = None, partitions: int | None = None):
        self.spark, self.path, self.partitions = spark, path.rstrip("/"), partitions
        jvm = spark.sparkContext._jvm
        self._Path = jvm.org.apache.hadoop.fs.Path
        self._fs = self._Path(self.path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
        meta = self.meta()
        if meta is None:
            self._fs.mkdirs(self._Path(self.path))
            meta = {"number": 0, "base": None, "base_rows": 0, "deltas": [], "page_bytes": max(page_bytes or 4096, kv.LEAST_PAGE), "seq": 0}
            self._publish(meta)
        self.page_bytes = meta["page_bytes"]

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._Path(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._Path(self.path))]
        return sorted(int(n[5:-5]) for n in names if n.startswith("meta-") and n.endswith(".json"))

    def meta(self) -> dict | None:
        """What the current version consists of; None if there is no table."""
        numbers = self._numbers()
        if not numbers:
            return None
        return json.loads(self.spark.read.text(f"{self.path}/meta-{numbers[-1]:020d}.json", wholetext=True).first()[0])

    def _publish(self, meta: dict) -> None:
        new = self._Path(f"{self.path}/_new-{uuid.uuid4().hex}.json")
        out = self._fs.create(new, True)
        out.write(bytearray(json.dumps(meta).encode()))
        out.close()
        at = self._Path(f"{self.path}/meta-{meta['number']:020d}.json")
        # Renaming onto an existing name fails on a distributed file system; a local one would overwrite it.
        if self._fs.exists(at) or not self._fs.rename(new, at):
            self._fs.delete(new, False)
            raise ConcurrentChange(f"version {meta['number']} is there already")

    def _changes(self, names: list[str]) -> DataFrame:
        return self.spark.read.schema(CHANGES).parquet(*(f"{self.path}/{n}" for n in names))

    def _base(self, meta: dict) -> DataFrame:
        if meta["base"] is None:
            return self.spark.createDataFrame([], SCHEMA)
        return self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{meta['base']}")

    @staticmethod
    def _latest(changes: DataFrame) -> DataFrame:
        last = changes.groupBy("key").agg(F.max(F.struct("seq", "op", "value")).alias("x"))
        return last.select("key", "x.value", "x.seq", "x.op")

    def table(self) -> DataFrame:
        """(key, value, seq) of the current version; a filter on key reaches the files of base and deltas."""
        meta = self.meta()
        if not meta["deltas"]:
            return self._base(meta)
        changes = self._changes(meta["deltas"])
        if meta["base"] is not None:
            changes = self._base(meta).withColumn("op", F.lit("put")).unionByName(changes)
        return self._latest(changes).where("op = 'put'").select("key", "value", "seq")

    def _write(self, rows: DataFrame, kind: str) -> str:
        name = f"{kind}-{uuid.uuid4().hex}"
        parts = rows.repartitionByRange(self.partitions, "key") if self.partitions else rows.repartitionByRange("key")
        parts.sortWithinPartitions("key").write.option("parquet.bloom.filter.enabled#key", "true").parquet(f"{self.path}/{name}")
        return name

    def apply(self, log: DataFrame) -> None:
        """Applies a log of puts and deletes after all earlier ones; its seq orders it within itself."""
        meta = self.meta()
        if len(meta["deltas"]) >= MAX_DELTAS:
            meta = self._fold(meta, FOLD_SHARE)
        ops = kv.operations(log).where("op <> 'get'")
        low, top = ops.agg(F.min("seq"), F.max("seq")).first()
        if top is None:
            return
        # The batch's numbers are moved behind all earlier ones, negative ones too.
        shift = meta["seq"] - min(int(low), 0)
        delta = self._write(self._latest(ops.withColumn("seq", F.col("seq") + shift)).select("key", "value", "seq", "op"), "delta")
        self._publish(meta | {"number": meta["number"] + 1, "deltas": [*meta["deltas"], delta], "seq": int(top) + shift + 1})

    def _fold(self, meta: dict, share: float) -> dict:
        """Publishes a version of the same content: deltas as one delta, or, if they are many beside the base, all as a new base."""
        if not meta["deltas"]:
            return meta
        changes = self._changes(meta["deltas"])
        if changes.count() >= share * meta["base_rows"]:
            base = self._write(self.table(), "base")
            rows = self.spark.read.schema(SCHEMA).parquet(f"{self.path}/{base}").count()
            after = meta | {"base": base, "base_rows": rows, "deltas": []}
        else:
            after = meta | {"deltas": [self._write(self._latest(changes).select("key", "value", "seq", "op"), "delta")]}
        after["number"] = meta["number"] + 1
        self._publish(after)
        return after

    def put_all(self, rows: DataFrame, key: str, value: str, seq: str) -> None:
        """Puts all rows in the order of ``seq``; of equal keys the last wins."""
        self.apply(rows.select(F.col(seq).alias("seq"), F.lit("put").alias("op"), F.col(key).alias("key"), F.col(value).alias("value")))

    def put(self, key: str, value: str) -> None:
        self.apply(self.spark.createDataFrame([(0, "put", key, value)], "seq bigint, op string, key string, value string"))

    def delete(self, key: str) -> bool:
        """Deletes the key; whether it was there."""
        there = self.get(key) is not None
        if there:
            self.apply(self.spark.createDataFrame([(0, "delete", key, None)], "seq bigint, op string, key string, value string"))
        return there

    def get(self, key: str) -> str | None:
        return kv.get(self.table(), key)

    def get_many(self, probes: DataFrame, key: str = "key") -> DataFrame:
        return kv.get_many(self.table(), probes, key)

    def layout(self) -> DataFrame:
        return kv.layout(self.table(), self.page_bytes)

    def records(self) -> DataFrame:
        """(kind, op, records): what base and deltas hold, records that later ones replace and tombstones too."""
        meta = self.meta()
        rows = self._base(meta).select(F.lit("base").alias("kind"), F.lit("put").alias("op"))
        if meta["deltas"]:
            rows = rows.unionByName(self._changes(meta["deltas"]).select(F.lit("delta").alias("kind"), "op"))
        return rows.groupBy("kind", "op").agg(F.count("*").alias("records"))

    def compact(self) -> None:
        """Folds all deltas into the base, which drops replaced records and tombstones, and deletes what no version needs then."""
        meta = self._fold(self.meta(), 0)
        keep = {meta["base"], *meta["deltas"], f"meta-{meta['number']:020d}.json"}
        for status in self._fs.listStatus(self._Path(self.path)):
            if status.getPath().getName() not in keep:
                self._fs.delete(status.getPath(), True)

    def exists(self) -> bool:
        return bool(self._numbers())

    def destroy(self) -> None:
        self._fs.delete(self._Path(self.path), True)

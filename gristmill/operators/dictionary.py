"""A static dictionary of unique keys: look-ups by join, and the space of a two-level perfect hash table over it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.hashing import JavaRandom, poly_hashes, with_numbers

PRIME = 1_000_000_007
#: Bytes of keys and values up to which a dictionary is broadcast.
BROADCAST_BYTES = 32 << 20


class DuplicateKeys(ValueError):
    """A dictionary was built from keys that aren't unique."""


class Dictionary:
    """An immutable map from ``key`` to ``value``.

    Building checks that no key comes twice (a null key counts as a key that finds nothing) and measures keys and
    values; a dictionary of at most ``BROADCAST_BYTES`` is broadcast in look-ups, a larger one is joined by
    a shuffle, or as the optimizer finds best.  ``''`` is a key; a null value is told from a miss by
    ``found``.
    """

    def __init__(self, rows: DataFrame, key: str, value: str):
        self.rows = rows.select(F.col(f"`{key}`").alias("key"), F.col(f"`{value}`").alias("value"))
        size = F.sum(F.octet_length(F.col("key").cast("string")) + F.coalesce(F.octet_length(F.to_json(F.struct("value"))), F.lit(0)))
        by_key = self.rows.groupBy("key").agg(F.count("*").alias("n"), size.alias("size"))
        got = by_key.agg(F.count("*").alias("keys"), F.max("n").alias("most"), F.sum("size").alias("size")).first()
        self.size, self.bytes = got.keys, got.size or 0
        if got.most is not None and got.most > 1:
            raise DuplicateKeys(f"a key comes {got.most} times")

    @classmethod
    def of_lists(cls, spark, keys: list[str], values: list, value_type: str = "string") -> Dictionary:
        if len(keys) != len(values):
            raise ValueError("there must be as many values as keys")
        return cls(spark.createDataFrame(list(zip(keys, values)), f"key string, value {value_type}"), "key", "value")

    def lookup(self, probes: DataFrame, on: str, value: str = "value", found: str = "found") -> DataFrame:
        """Each probe with the value of its key, or null, and whether it was found."""
        if {value, found} & set(probes.columns):
            raise ValueError("the probes have a column named like the result")
        own = self.rows.select(F.col("key").alias("__key"), F.col("value").alias(value), F.lit(True).alias("__hit"))
        if self.bytes <= BROADCAST_BYTES:
            own = F.broadcast(own)
        joined = probes.join(own, F.col(f"`{on}`") == F.col("__key"), "left")
        return joined.withColumn(found, F.coalesce("__hit", F.lit(False))).drop("__key", "__hit")

    def buckets(self, seed: int = 42) -> DataFrame:
        """(bucket, records) of the first level: the polynomial hash modulo the number of keys, with drawn parameters."""
        return hash_buckets(self.rows.select("key"), max(self.size, 1), seed)

    def secondary_space(self, seed: int = 42) -> int:
        """Slots of all second levels, the square of each bucket's records."""
        return self.buckets(seed).agg(F.sum(F.col("records") * F.col("records"))).first()[0] or 0


def first_level(seed: int = 42) -> tuple[int, int]:
    """Multiplier and start of the first level's hash."""
    draw = JavaRandom(seed)
    return 1 + draw.long_below(PRIME - 1), draw.long_below(PRIME)


def hash_buckets(keys: DataFrame, size: int, seed: int = 42) -> DataFrame:
    """(bucket, records) of a table of string keys."""
    a, b = first_level(seed)
    hashed = with_numbers(keys.select("key"), "key", "h", lambda texts: poly_hashes(texts, a, b, PRIME))
    return hashed.where("h is not null").groupBy(F.pmod(F.col("h"), F.lit(size)).alias("bucket")).agg(F.count("*").alias("records"))


def keep_first(rows: DataFrame, key: str, seq: str, limit: int | None = None) -> DataFrame:
    """The first row, by ``seq``, of each key that isn't null; of those the first ``limit``, if given.

    Pre-aggregated by key, so that no task orders a hot key's rows; of equal ``seq`` the smallest row counts.
    """
    others = [c for c in rows.columns if c not in (key, seq)]
    best = rows.where(F.col(f"`{key}`").isNotNull()).groupBy(F.col(f"`{key}`")).agg(F.min(F.struct(F.col(f"`{seq}`"), *(F.col(f"`{c}`") for c in others))).alias("__x"))
    out = best.select(F.col(f"`{key}`"), *(F.col(f"__x.`{c}`").alias(c) for c in [seq, *others])).select(*rows.columns)
    return out if limit is None else out.orderBy(seq).limit(limit)

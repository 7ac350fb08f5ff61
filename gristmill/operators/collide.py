"""Pairs of entries that share a key, in one sort of the entries, whatever the size of a key's group."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gristmill.functions.arrow import text_bytes
from gristmill.session import materialize

#: Entries of one key that are compared with one another in one step; a longer group is cut into chunks.
CHUNK = 4096
#: Pairs looked at in one step of a task.
STEP = 1 << 16

#: Of pairs (i, j) of rows of a table of payload, those to keep, as two arrays.  The table lies in columns: a check
#: should read one column of the pairs that are left, not whole rows.
Admit = Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def _admitted(ids: np.ndarray, load: np.ndarray, i: np.ndarray, j: np.ndarray, admit: Admit | None) -> tuple[np.ndarray, np.ndarray]:
    if admit is not None and len(i):
        i, j = admit(load, i, j)
    a, b = ids[i], ids[j]
    keep = a != b
    a, b = a[keep], b[keep]
    return np.minimum(a, b), np.maximum(a, b)


def pairs_of_runs(keys: np.ndarray, ids: np.ndarray, load: np.ndarray, admit: Admit | None, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(smaller id, larger id) of the entries of equal keys, which stand together."""
    n = len(keys)
    if n < 2:
        return
    load = np.asfortranarray(load)
    new = np.ones(n, bool)
    new[1:] = keys[1:] != keys[:-1]
    at = np.arange(n)
    before = at - np.maximum.accumulate(np.where(new, at, 0))  # entries of the same key ahead of each
    ends = np.cumsum(before)
    lo = 0
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(ends, (ends[lo - 1] if lo else 0) + step, "right")))
        many = before[lo:hi]
        i = np.repeat(at[lo:hi], many)
        if len(i):
            nth = np.arange(len(i)) - np.repeat(np.cumsum(many) - many, many)
            yield _admitted(ids, load, i, i - 1 - nth, admit)
        lo = hi


def _across(ids: np.ndarray, load: np.ndarray, one: np.ndarray, two: np.ndarray, admit: Admit | None, step: int = STEP) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The same for entries of one chunk with those of another."""
    if not len(two):
        return
    width = max(1, step // len(two))
    for lo in range(0, len(one), width):
        part = one[lo : lo + width]
        yield _admitted(ids, load, np.repeat(part, len(two)), np.tile(two, len(part)), admit)


def _loads(column: pa.Array, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids, and so many further numbers, of a column of entries' loads."""
    data, _ = text_bytes(column)
    table = data.view(np.int64).reshape(len(column), 1 + width) if len(data) else np.zeros((len(column), 1 + width), np.int64)
    return table[:, 0], table[:, 1:]


def binary_rows(table: np.ndarray) -> pa.Array:
    """Each row of a table of 64-bit numbers as one binary value, as colliding_pairs takes them."""
    n, width = table.shape
    ends = (np.arange(n + 1) * (8 * width)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends.tobytes()), pa.py_buffer(np.ascontiguousarray(table).tobytes())])


def colliding_pairs(entries: DataFrame, width: int = 0, admit: Admit | None = None, chunk: int = CHUNK) -> DataFrame:
    """Distinct pairs (a, b), a < b, of ids among the entries (key, load) that share a key and are admitted.

    key is BIGINT; ``load`` holds the id and ``width`` further 64-bit numbers, as binary_rows makes it, by which
    ``admit`` may rule pairs out; one column, as each column of each entry costs on its way to Python.  The entries are
    shuffled and sorted by key once; a task holds one chunk of a key's entries at most.  A group of more
    than ``chunk`` entries is cut into chunks; each is paired with itself where it is read, and any two
    chunks meet in a task of their own, so that no key's pairs depend on one task.  No group is left out or cut
    short.  Entries without key or load take no part; an empty table gives an empty table.
    """
    rows = entries.select(F.col("key").cast("long").alias("key"), "load").where("key is not null and load is not null")
    names = ["a", "b", "key", "chunk", "load"]
    schema = "a bigint, b bigint, key bigint, chunk bigint, load binary"

    def out_pairs(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b), none, none, pa.nulls(len(a), pa.binary())], names=names)

    def out_chunk(key: int, which: int, ids: np.ndarray, load: np.ndarray) -> pa.RecordBatch:
        n = len(ids)
        cols = [pa.array(np.full(n, v, np.int64)) for v in (key, which)]
        return pa.RecordBatch.from_arrays([pa.nulls(n, pa.int64()), pa.nulls(n, pa.int64()), *cols, binary_rows(np.column_stack([ids, load]))], names=names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros((0, width), np.int64))
        which = 0  # chunks of the held run's key that have been handed on
        for batch in batches:
            if not batch.num_rows:
                continue
            keys, ids, load = (np.concatenate(x) for x in zip(held, (batch.column(0).to_numpy(), *_loads(batch.column(1), width))))
            # The last run may go on in the next batch.
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last and which:
                end = int(np.searchsorted(keys, keys[0], "right"))
                yield out_chunk(int(keys[0]), which, ids[:end], load[:end])
                which = 0
            for a, b in pairs_of_runs(keys[:last], ids[:last], load[:last], admit):
                yield out_pairs(a, b)
            keys, ids, load = keys[last:], ids[last:], load[last:]
            while len(keys) > chunk:
                for a, b in pairs_of_runs(keys[:chunk], ids[:chunk], load[:chunk], admit):
                    yield out_pairs(a, b)
                yield out_chunk(int(keys[0]), which, ids[:chunk], load[:chunk])
                keys, ids, load, which = keys[chunk:], ids[chunk:], load[chunk:], which + 1
            held = keys, ids, load
        keys, ids, load = held
        if len(keys):
            for a, b in pairs_of_runs(keys, ids, load, admit):
                yield out_pairs(a, b)
            if which:
                yield out_chunk(int(keys[0]), which, ids, load)

    met = materialize(rows.repartition("key").sortWithinPartitions("key").mapInArrow(run, schema), "met")
    chunks = met.where("b is null").select("key", "chunk", "load")
    # Each chunk once for every other chunk of its key: as many copies as the pairs of chunks need.
    total = chunks.groupBy("key").agg(F.max("chunk").alias("top"))
    other = chunks.join(total, "key").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("top")))).where("other <> chunk")
    meet = other.select(F.xxhash64("key", F.least("chunk", "other"), F.greatest("chunk", "other")).alias("key"), (F.col("chunk") > F.col("other")).cast("long").alias("second"), "load")

    def cross(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []

        def flush(keys: np.ndarray, ids: np.ndarray, load: np.ndarray) -> Iterator[pa.RecordBatch]:
            cuts = np.flatnonzero(np.append(True, keys[1:] != keys[:-1]))
            for lo, hi in zip(cuts, np.append(cuts[1:], len(keys))):
                side = load[lo:hi, 0]
                for a, b in _across(ids, np.asfortranarray(load[:, 1:]), lo + np.flatnonzero(side == 0), lo + np.flatnonzero(side == 1), admit):
                    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys, (ids, load) = batch.column(0).to_numpy(), _loads(batch.column(2), width)
            load = np.column_stack([batch.column(1).to_numpy(), load])
            if held:
                keys, ids, load = (np.concatenate(x) for x in zip(held, (keys, ids, load)))
            last = int(np.searchsorted(keys, keys[-1], "left"))
            if last:
                yield from flush(keys[:last], ids[:last], load[:last])
            held = [keys[last:], ids[last:], load[last:]]
        if held:
            yield from flush(*held)

    far = meet.repartition("key").sortWithinPartitions("key").mapInArrow(cross, "a bigint, b bigint")
    return met.where("b is not null").select("a", "b").unionByName(far).distinct()

"""Seeded random points, each computed on its own."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from gristmill.functions.hashing import _A, _C, _MASK, JavaRandom


def random_points(spark: SparkSession, n: int, seed: int = 42, skip: int = 0, prefix: str = "p") -> DataFrame:
    """(id, lat, lng, name) of ``n`` points spread evenly in degrees, from the generator of the Java library.

    Point i takes the doubles 2 * (skip + i) and the next of the seeded sequence, so that any part of the
    table can be computed anywhere and the points don't depend on partitions.
    """
    # States of 64-bit numbers modulo 2**48: a task jumps to its first point and goes on in steps of four.
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy()
            lat, lng = np.empty(len(ids)), np.empty(len(ids))
            for lo in range(0, len(ids), 4096):
                part = ids[lo : lo + 4096]
                first = JavaRandom(seed).skip(4 * (skip + int(part[0]))).state
                m = 4 * len(part)
                a, c = np.ones(m, np.uint64), np.zeros(m, np.uint64)
                a[:] = _A
                np.cumprod(a, out=a)  # powers modulo 2**64 are right modulo 2**48
                c[1:] = a[:-1]
                c[0] = 1
                np.cumsum(c, out=c)
                state = (a * np.uint64(first) + c * np.uint64(_C)) & np.uint64(_MASK)
                high, low = state[0::2] >> np.uint64(22), state[1::2] >> np.uint64(21)
                d = ((high << np.uint64(27)) + low).astype(np.float64) * 2.0**-53
                lat[lo : lo + 4096], lng[lo : lo + 4096] = d[0::2] * 180 - 90, d[1::2] * 360 - 180
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(lat), pa.array(lng), pa.array([f"{prefix}{i}" for i in ids.tolist()])], names=["id", "lat", "lng", "name"])

    return spark.range(n).mapInArrow(run, "id bigint, lat double, lng double, name string")

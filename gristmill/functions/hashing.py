"""Hash functions with given values: string hashes over UTF-16 units, and the generator their parameters come from."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

# Multiplier and addend of the 48-bit linear congruential generator of the Java library's Random.
_A, _C, _MASK = 0x5DEECE66D, 0xB, (1 << 48) - 1


class JavaRandom:
    """The Java library's Random, with steps forward at no cost."""

    def __init__(self, seed: int):
        self.state = (seed ^ _A) & _MASK

    def skip(self, n: int) -> JavaRandom:
        a, c, ta, tc = _A, _C, 1, 0
        while n:
            if n & 1:
                ta, tc = ta * a & _MASK, (tc * a + c) & _MASK
            a, c, n = a * a & _MASK, (c * a + c) & _MASK, n >> 1
        self.state = (self.state * ta + tc) & _MASK
        return self

    def bits(self, n: int) -> int:
        """The next ``n`` bits as a signed number of 32 bits."""
        self.state = (self.state * _A + _C) & _MASK
        x = self.state >> (48 - n)
        return x - (1 << 32) if n == 32 and x >> 31 else x

    def long(self) -> int:
        x = (self.bits(32) << 32) + self.bits(32)
        return (x + (1 << 63)) % (1 << 64) - (1 << 63)

    def double(self) -> float:
        return ((self.bits(26) << 27) + self.bits(27)) * 2.0**-53

    def long_below(self, bound: int) -> int:
        """A number from 0 up to, without, ``bound``, by the library's rule for bounded longs."""
        r, m = self.long(), bound - 1
        if bound & m == 0:
            return r & m
        u = (r % (1 << 64)) >> 1
        while u + m - (r := u % bound) >= 1 << 63:
            u = (self.long() % (1 << 64)) >> 1
        return r


def units(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """UTF-16 units of all texts, one after the other, and the number of each; null counts as empty."""
    raw = [(t or "").encode("utf-16-le", "surrogatepass") for t in texts]
    return np.frombuffer(b"".join(raw), np.uint16).astype(np.uint64), np.array([len(r) // 2 for r in raw], np.int64)


def _sums(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sum of each text's values modulo 2**64."""
    out = np.zeros(len(counts), np.uint64)
    some = counts > 0
    if some.any():
        out[some] = np.add.reduceat(values, (np.cumsum(counts) - counts)[some])
    return out


def _from_end(counts: np.ndarray) -> np.ndarray:
    """For each unit, how many units of its text follow it."""
    ends = np.cumsum(counts)
    return np.repeat(ends - 1, counts) - np.arange(ends[-1] if len(ends) else 0)


def string_hashes(texts: list[str | None]) -> np.ndarray:
    """Unsigned 32-bit h = h * 31 + unit."""
    u, counts = units(texts)
    power = np.full(int(counts.max(initial=0)) + 1, 31, np.uint64)
    power[0] = 1
    np.cumprod(power, out=power)
    return (_sums(u * power[_from_end(counts)], counts) & np.uint64(0xFFFFFFFF)).astype(np.int64)


def spread_hashes(texts: list[str | None]) -> np.ndarray:
    """The string hash with its upper half mixed into the lower, as addresses of a hash table use it."""
    h = string_hashes(texts)
    return h ^ (h >> 16)


def poly_hashes(texts: list[str | None], a: int, b: int, prime: int) -> np.ndarray:
    """h = (h * a + unit) mod prime from h = b; prime and a below 2**31."""
    u, counts = units(texts)
    h = np.full(len(texts), b, np.int64)
    starts = np.cumsum(counts) - counts
    # Texts side by side, unit by unit: as many steps as the longest text has units.
    order = np.argsort(-counts, kind="stable")
    for k in range(int(counts.max(initial=0))):
        live = order[: np.searchsorted(-counts[order], -k, "left")]
        h[live] = (h[live] * a + u[starts[live] + k].astype(np.int64)) % prime
    return h


def with_numbers(df: DataFrame, text: str, name: str, kernel: Callable[[list[str | None]], np.ndarray]) -> DataFrame:
    """``df`` with a BIGINT column that ``kernel`` computes from the texts of each Arrow batch; null for null."""
    if name in df.columns:
        raise ValueError(f"there is a column {name!r} already")
    at = df.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            col = batch.column(at)
            got = pa.array(kernel(col.to_pylist()).astype(np.int64), mask=col.is_null().to_numpy(zero_copy_only=False))
            yield pa.RecordBatch.from_arrays([*batch.columns, got], names=[*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.LongType())]))

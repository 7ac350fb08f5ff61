"""Arrow columns as numpy arrays, and batches in parts of bounded size."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and row offsets of a column of strings or binaries; nulls count as empty."""
    if pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        column = column.view(pa.large_string() if pa.types.is_large_binary(column.type) else pa.string())
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    if not wide and not pa.types.is_string(column.type):
        column, wide = column.cast(pa.large_string()), True
    _, offsets, data = column.buffers()
    n = len(column)
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    rows = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + n + 1].astype(np.int64)
    low, high = int(rows[0]), int(rows[-1])
    return np.frombuffer(data, np.uint8)[low:high] if high > low else np.zeros(0, np.uint8), rows - low


def row_chunks(rows: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Ranges of rows of about ``limit`` bytes, one row at least; ``rows`` are offsets."""
    at, n = 0, len(rows) - 1
    while at < n:
        end = min(n, max(at + 1, int(np.searchsorted(rows, rows[at] + limit, "right")) - 1))
        yield at, end
        at = end


def parts(batch: pa.RecordBatch, column: int, limit: int) -> Iterator[pa.RecordBatch]:
    """The batch in slices of about ``limit`` bytes of a text column, one row at least."""
    _, rows = text_bytes(batch.column(column))
    for lo, hi in row_chunks(rows, limit):
        yield batch.slice(lo, hi - lo)


def ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers from each start on, so many of each, one range after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - (ends - counts), counts)

"""Token ids of a whole corpus by a public byte-level BPE tokenizer."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gristmill.functions.arrow import row_chunks, text_bytes
from gristmill.llm import bpe


def encode_rows(encoder: bpe.Encoder, data: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """As Encoder.encode; a single row over the chunk size is cut where a piece starts anyway."""
    if len(rows) == 2 and len(data) > 2 * bpe.CHUNK_BYTES:
        cuts = bpe.safe_cuts(data, bpe.CHUNK_BYTES)
        parts = [encoder.encode(data[lo:hi], np.array([0, hi - lo]))[0] for lo, hi in zip(cuts[:-1], cuts[1:])]
        ids = np.concatenate(parts)
        return ids, np.array([len(ids)])
    return encoder.encode(data, rows)


def _map(df: DataFrame, text: str, keep: list[str], out: str, path: str, schema: T.StructType, counts_only: bool) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = bpe.encoder(path)
        for batch in batches:
            data, rows = text_bytes(batch.column(len(keep)))
            for lo, hi in row_chunks(rows, bpe.CHUNK_BYTES):
                ids, count = encode_rows(encoder, data[rows[lo] : rows[hi]], rows[lo : hi + 1] - rows[lo])
                if counts_only:
                    result = pa.array(count.astype(np.int64))
                else:
                    offsets = np.concatenate([[0], np.cumsum(count)]).astype(np.int32)
                    result = pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))
                part = batch.slice(lo, hi - lo)
                yield pa.RecordBatch.from_arrays([*(part.column(k) for k in range(len(keep))), result], names=[*keep, out])

    return df.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").cast("string").alias("__text")).mapInArrow(run, schema)


def encode_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "ids", tokenizer: str | None = None) -> DataFrame:
    """The columns ``keep`` of each row and the token ids of its text, without special tokens.

    The ids are those of the vocabulary's own merges, found by the prefix tables of
    :mod:`gristmill.llm.bpe`.  A narrow map: no shuffle, one row out for each row in, whole texts.
    Null and empty texts give an empty list; strings that look like special tokens are ordinary text;
    repeated rows come out as often as they come in; an empty table gives an empty table.  ``out`` must
    not be among ``keep``.  ``tokenizer`` is a tokenizers JSON file that executors can read.
    """
    keep = ["doc_id"] if keep is None else list(keep)
    if out in keep:
        raise ValueError(f"the column {out!r} is among those kept")
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.ArrayType(T.IntegerType(), True), True)])
    return _map(df, text, keep, out, tokenizer or bpe.default_path(), schema, False)


def count_tokens(df: DataFrame, text: str = "text", keep: list[str] | None = None, out: str = "n_tokens", tokenizer: str | None = None) -> DataFrame:
    """As encode_tokens, with the number of ids only; 0 for null and empty texts."""
    keep = ["doc_id"] if keep is None else list(keep)
    if out in keep:
        raise ValueError(f"the column {out!r} is among those kept")
    schema = T.StructType([*(df.schema[c] for c in keep), T.StructField(out, T.LongType(), True)])
    return _map(df, text, keep, out, tokenizer or bpe.default_path(), schema, True)

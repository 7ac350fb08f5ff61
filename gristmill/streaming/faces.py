"""Streams into the keyed table and into a table of band entries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from gristmill.operators import neardup
from gristmill.sources.kv_store import KvStore


def upsert_stream(log: DataFrame, store: KvStore, checkpoint: str) -> DataStreamWriter:
    """Applies each batch of a stream of operations (seq, op, key, value) to a store.

    Batches are applied one after the other; within a batch ``seq`` orders the operations.  A batch that is
    delivered again after a failure puts and deletes the same keys again, with the same result.
    """

    def apply(batch: DataFrame, _: int) -> None:
        store.apply(batch)

    return log.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint)


def index_stream(documents: DataFrame, id_col: str, text: str, path: str, checkpoint: str, params: neardup.Params = neardup.Params()) -> DataStreamWriter:
    """Appends the sketches of a stream of texts to the Parquet table of a SignatureIndex, or to one that similar_to can be asked about."""
    return neardup.sketches(documents, id_col, text, params).writeStream.format("parquet").outputMode("append").option("path", path).option("checkpointLocation", checkpoint)

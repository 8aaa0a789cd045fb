"""Deliveries from a stream into a ``DeliveryStore``: every micro-batch is one atomic merge."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from triloom.operators.deliveries import DeliveryStore


def ingest(
    stream: DataFrame, store_path: str, identifier: Callable[[], Sequence[Column]], checkpoint: str, row_id: str = "rec_id", loaded_at: str = "loaded_at", **trigger
) -> StreamingQuery:
    """Starts the query. A micro-batch that is replayed after a failure is not applied again.

    The store names its batches by their epoch, and the epoch and the data are committed
    by one rename, so delivery to the store is exactly once. ``trigger`` as for
    ``DataStreamWriter.trigger``, by default all that is there now.
    """

    def merge(batch: DataFrame, epoch: int) -> None:
        DeliveryStore(batch.sparkSession, store_path, identifier(), row_id, loaded_at).apply(batch, f"epoch-{epoch}")

    return stream.writeStream.foreachBatch(merge).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

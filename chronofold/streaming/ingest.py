"""Continuous ingest: every micro-batch of a stream is appended to a store once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from chronofold.sources.store import Store


def ingest_stream(rows: DataFrame, store: Store, dataset: str, name: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Starts the stream ``name``.  A batch repeated after a failure is told by its number and skipped."""

    def append(batch: DataFrame, number: int) -> None:
        store.ingest_df(dataset, batch, (name, number))

    writer = rows.writeStream.queryName(name).foreachBatch(append).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

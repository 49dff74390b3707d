"""Continuous ingest into index tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from nearfield.sources.index_table import Index, append_batch


def _start(stream: DataFrame, work: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    writer = stream.writeStream.option("checkpointLocation", checkpoint).foreachBatch(work)
    return (writer.trigger(availableNow=True) if every is None else writer.trigger(processingTime=every)).start()


def ingest_stream(
    docs: DataFrame,
    index: Index,
    checkpoint: str,
    prepare: Callable[[DataFrame], DataFrame] | None = None,
    seq: str | None = None,
    every: str | None = "60 seconds",
) -> StreamingQuery:
    """Parse and embed (``prepare``), then upsert every micro-batch. Upserts by id can be run again."""

    def work(batch: DataFrame, batch_id: int) -> None:
        index.upsert(batch if prepare is None else prepare(batch), seq)

    return _start(docs, work, checkpoint, every)


def append_stream(vectors: DataFrame, path: str, checkpoint: str, order: str, every: str | None = "60 seconds") -> StreamingQuery:
    """Append every micro-batch with ids that go on from the batches before it."""

    def work(batch: DataFrame, batch_id: int) -> None:
        append_batch(batch.sparkSession, path, batch, order, batch_id)

    return _start(vectors, work, checkpoint, every)


def keep_stream(rows: DataFrame, path: str, checkpoint: str, every: str | None = "60 seconds") -> StreamingQuery:
    """Write every micro-batch, whose rows have ids already, to its own folder; a batch that runs again replaces it."""

    def work(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return _start(rows, work, checkpoint, every)

"""Streaming ingest: a stream of events into a store, once each."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from semevra.engine import Engine


def stream_into(engine: Engine, events: DataFrame, checkpoint: str, now_ms: int | None = None, available_now: bool = True) -> StreamingQuery:
    """Start the query. Each micro-batch is admitted and committed with its number, so one that is run again after a
    failure changes nothing; the source's offset moves only after the commit."""

    def write(batch: DataFrame, number: int) -> None:
        engine.admit_and_ingest(batch, now_ms, number)

    w = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    if available_now:
        w = w.trigger(availableNow=True)
    return w.start()

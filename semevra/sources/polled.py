"""Sources that are polled and committed: a batch of events and the offset behind it, kept in the store's folder."""

from __future__ import annotations

from collections.abc import Sequence
from typing import Protocol

from pyspark.sql import DataFrame, SparkSession

from semevra.engine import Engine
from semevra.model import EVENT, EngineError
from semevra.sources.store import Files


class Source(Protocol):
    """Offsets count events from 0. ``poll`` does not move the offset; ``commit`` does, to a place that was polled."""

    name: str

    def committed(self) -> int: ...

    def poll(self, most: int) -> tuple[DataFrame | None, int]: ...

    def commit(self, offset: int) -> None: ...


class MemorySource:
    """Events from a list, for tests that need to control what comes when. Its offset outlives the process, its events do not."""

    def __init__(self, spark: SparkSession, root: str, name: str, events: Sequence[tuple]) -> None:
        if not name or "/" in name:
            raise EngineError("a source's name is not empty and has no slash")
        self.spark, self.name, self.events = spark, name, list(events)
        self.files = Files(spark, root)
        self._at = f"sources/{name}.offset"

    def committed(self) -> int:
        """A source that never committed is at 0."""
        return int(self.files.read(self._at)) if self.files.exists(self._at) else 0

    def poll(self, most: int) -> tuple[DataFrame | None, int]:
        """(the next ``most`` events, None if there are none; the offset behind them)."""
        start = self.committed()
        end = min(start + max(most, 0), len(self.events))
        return (self.spark.createDataFrame(self.events[start:end], EVENT) if end > start else None), max(start, end)

    def commit(self, offset: int) -> None:
        """The offset is replaced whole, so that a crash leaves the old one or the new one."""
        self.files.write(self._at, str(offset))


def drain(engine: Engine, source: Source, most: int, now_ms: int | None = None) -> dict[str, int]:
    """Ingest all that ``source`` has, ``most`` events at a time; counts by outcome.

    The offset moves after the snapshot is committed, so what a crash repeats is recognised by its idempotency keys.
    """
    out: dict[str, int] = {}
    while True:
        events, end = source.poll(most)
        if events is None:
            return out
        for k, v in engine.admit_and_ingest(events, now_ms).items():
            out[k] = out.get(k, 0) + v
        source.commit(end)

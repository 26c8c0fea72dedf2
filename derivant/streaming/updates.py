"""Streams of tuples: each micro-batch is taken in as a change, and results are kept up to date."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..engine import Engine
from ..sources.storage import stored


def follow(engine: Engine, stream: DataFrame, relation: str, checkpoint: str, columns: Sequence[str] | None = None, on_update: Callable[[Engine, int], None] | None = None, **trigger) -> StreamingQuery:
    """Inserts what arrives on stream into a relation and runs the rules on it.

    A batch is written to shared storage before it is inserted, since the engine reads
    it more than once. Relations are sets, so a batch that is delivered twice changes
    nothing. on_update(engine, batch) may read any relation; what it reads is valid until
    the next batch, as tables that are no longer needed are deleted then.
    """

    def take(batch: DataFrame, number: int) -> None:
        engine.vacuum()
        engine.insert(relation, stored(batch, f"batch-{number}").frame, columns)
        engine.run()
        if on_update is not None:
            on_update(engine, number)

    writer = stream.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint)
    return (writer.trigger(**trigger) if trigger else writer).start()

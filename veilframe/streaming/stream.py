"""Audits of case pairs that arrive as a stream: each micro-batch is audited as a table and appended to a sink."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery


def audit_stream(pairs: DataFrame, audit: Callable[[DataFrame], DataFrame], sink: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Appends ``audit(batch)`` to the Parquet folder ``sink``, a folder for each batch.

    A batch that is repeated after a failure overwrites its own folder, so its rows are never there twice.
    """

    def write(batch: DataFrame, number: int) -> None:
        audit(batch).write.mode("overwrite").parquet(f"{sink}/batch={number}")

    writer = pairs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()

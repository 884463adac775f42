"""Structured Streaming into and out of collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from nearfield.collection import Collection


def upsert_stream(collection: Collection, stream: DataFrame, checkpoint: str, order: str | None = None, once: bool = False) -> StreamingQuery:
    """Upsert every micro-batch of (id, vector, attributes).

    The batch number is logged with the ops, so a batch that is delivered again after a failure is passed over.
    `once` takes what is there and stops.
    """

    def write(batch: DataFrame, number: int) -> None:
        if number > collection.stream_batch:
            collection.upsert_frame(batch, order, stream_batch=number)

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def windowed_counts(stream: DataFrame, time: str = "ts", key: str = "event_type", size: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, key, n) of an event stream; events later than `late` are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, size), key).agg(F.count("*").alias("n"))

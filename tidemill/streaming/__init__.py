"""Late data as a stream: a watermark bounds what is held, each batch is an upsert by key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources import VersionedTable


def windowed_counts(events: DataFrame, time: str = "ts", key: str = "event_type", width: str = "1 day", late: str = "3 days") -> DataFrame:
    return events.withWatermark(time, late).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("value"))


def upsert_stream(stream: DataFrame, table: VersionedTable, order_by: str, checkpoint: str) -> StreamingQuery:
    """Each micro-batch's last row of a key goes into the table; a batch that runs twice gives the same table."""

    def apply(batch: DataFrame, _: int) -> None:
        if not batch.isEmpty():
            table.upsert(batch, order_by)

    return stream.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

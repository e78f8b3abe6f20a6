"""Latest row per key over a stream, each batch added to a registry at the cost of the batch. An extension."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.registry import Registry

#: Files of a bucket from which on a batch also compacts it.
FILES = 8


def latest_table(spark: SparkSession, root: str, key: str, order: list[str], version: int | None = None) -> DataFrame | None:
    """The last row of each key, as of the newest version or an earlier one; None before the first batch."""
    rows = Registry(spark, root, key, order).read(version)
    return None if rows is None else rows.drop("first_seq")


def start_latest(stream: DataFrame, root: str, checkpoint: str, key: str, order: list[str], available_now: bool = True) -> StreamingQuery:
    """Keeps one row per key, the last by ``order``. A batch that is run again, as after a restart, finds itself committed
    and changes nothing."""

    def add(batch: DataFrame, epoch: int) -> None:
        registry = Registry(batch.sparkSession, root, key, order)
        registry.upsert(batch, "stream", epoch)
        registry.compact(FILES)

    w = stream.writeStream.foreachBatch(add).option("checkpointLocation", checkpoint).outputMode("append")
    return (w.trigger(availableNow=True) if available_now else w).start()

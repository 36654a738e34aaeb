"""An extension: change logs of profiles and favourites as streams, into the same append logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.store import latest, merge
from ..sources.documents import append_once


def read_changes(spark: SparkSession, folder: str, schema: str) -> DataFrame:
    """New JSON files of a folder as they come."""
    return spark.readStream.schema(schema).json(folder)


def once_only(changes: DataFrame, key: str, time: str, delay: str = "1 hour") -> DataFrame:
    """Changes without repeats of a key that come within ``delay``; state older than that is dropped."""
    return changes.withWatermark(time, delay).dropDuplicatesWithinWatermark([key])


def append_stream(changes: DataFrame, table: str, checkpoint: str, key: str, *order: str) -> StreamingQuery:
    """Append the latest row of every key in each micro-batch to ``table``, once: a batch that is replayed takes its own place."""

    def write(batch: DataFrame, number: int) -> None:
        append_once(latest(batch, key, *order), table, number)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def merge_stream(changes: DataFrame, path: str, checkpoint: str, key: str, *order: str) -> StreamingQuery:
    """Merge every micro-batch into the table at ``path``, which holds the latest row of each key; replays change nothing."""

    def write(batch: DataFrame, _: int) -> None:
        merge(batch, path, key, *order)

    return changes.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def counts_by_window(changes: DataFrame, time: str, kind: str, size: str = "1 day", delay: str = "1 hour") -> DataFrame:
    """Numbers of changes by kind in tumbling windows, late ones within ``delay`` counted."""
    return changes.withWatermark(time, delay).groupBy(F.window(time, size), kind).agg(F.count(F.lit(1)).alias("n"))

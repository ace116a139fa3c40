"""Streams: fixed-window rate counts and a change feed, over files or any streaming source."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..operators.states import rate_windows, upsert


def event_stream(spark: SparkSession, path: str, schema, files_a_batch: int = 1) -> DataFrame:
    """Parquet files of events as a stream, in order of arrival."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_batch).parquet(path)


def rate_stream(events: DataFrame, seconds: int, limit: int, keys: list[str], late: str = "1 hour") -> DataFrame:
    """rate_windows on a stream: a window's state goes once it is later than the watermark; rows that come after that are left out."""
    return rate_windows(events.withWatermark("ts", late), seconds, limit, keys)


def upsert_stream(rows: DataFrame, key: str, order: str, read: Callable[[], DataFrame], write: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Each micro-batch is put over the stored table by upsert(); read and write give and take that table, write with the batch's number, so that a repeated batch can be known."""
    return rows.writeStream.foreachBatch(lambda batch, n: write(upsert(read(), batch, key, order), n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

"""Queues over Structured Streaming: producers append files, consumers drain by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType


def listen(spark: SparkSession, path: str, schema: StructType | str, max_files: int | None = None) -> DataFrame:
    """A stream of parquet records; ``max_files`` a batch is the back-pressure."""
    reader = spark.readStream.schema(schema)
    return (reader.option("maxFilesPerTrigger", max_files) if max_files else reader).parquet(path)


def once(stream: DataFrame, *keys: str, time: str | None = None, late: str = "1 hour") -> DataFrame:
    """Each record once by its keys, e.g. (host, producer, seq). With a time column, state is
    dropped after ``late``; without, it grows with the keys."""
    if time:
        return stream.withWatermark(time, late).dropDuplicatesWithinWatermark(list(keys))
    return stream.dropDuplicates(list(keys))


def drain(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Pop everything that is there into parquet, then stop: the phase between two barriers."""
    return stream.writeStream.format("parquet").option("checkpointLocation", checkpoint).option("path", path).trigger(availableNow=True).start()


def deliver(stream: DataFrame, consume: Callable[[DataFrame, int], None], checkpoint: str, seconds: int | None = None) -> StreamingQuery:
    """Hand every micro-batch to a consumer: all that is there, or every few seconds."""
    writer = stream.writeStream.foreachBatch(consume).option("checkpointLocation", checkpoint)
    return (writer.trigger(processingTime=f"{seconds} seconds") if seconds else writer.trigger(availableNow=True)).start()


def sizes(stream: DataFrame, host: str) -> DataFrame:
    """Running number of records of each host (complete or update mode)."""
    return stream.groupBy(host).agg(F.count(F.lit(1)).alias("size"))

"""Extension: the batch operators behind a file-source stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def stream(spark: SparkSession, folder: str, schema: T.StructType, pattern: str = "*.parquet") -> DataFrame:
    return spark.readStream.schema(schema).option("pathGlobFilter", pattern).parquet(folder)


def windowed_counts(events: DataFrame, length: str = "1 day", late: str = "2 days") -> DataFrame:
    """Events per type and tumbling window; rows later than the watermark are left out, so state stays bounded."""
    return (
        events.withWatermark("ts", late)
        .groupBy(F.window("ts", length).alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.sum("value").alias("value"))
        .select(F.col("w.start").alias("window_start"), "event_type", "n", "value")
    )


def ingest(source: DataFrame, batch: Callable[[DataFrame, int], None], checkpoint: str, keys: list[str], late: str | None = None, time: str = "ts") -> StreamingQuery:
    """Each micro-batch, without keys seen before, to the batch operator; ends when what is there has been read.

    With a watermark, keys are forgotten once they are later than it.
    """
    rows = source.withWatermark(time, late) if late else source
    fresh = rows.dropDuplicatesWithinWatermark(keys) if late else rows.dropDuplicates(keys)
    return fresh.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

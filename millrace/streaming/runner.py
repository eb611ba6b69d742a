"""Runs a pipeline on files as they arrive, and windowed counts of late events.

A file source with a checkpoint gives each file once; every micro-batch runs
the same configuration as a batch does, and writes under its batch id, so a
batch that runs again after a failure replaces its own output.
"""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..plans.pipeline import build


def run_on_arrival(spark: SparkSession, path: str, schema: StructType, config: dict[str, Any], source: str, output: str, out_path: str, checkpoint: str, kind: str = "parquet", env: dict[str, Any] | None = None, files_each: int | None = None) -> StreamingQuery:
    """Starts the pipeline on each batch of new files; stops by itself when none is left."""

    def each(batch: DataFrame, batch_id: int) -> None:
        channels = build(batch.sparkSession, config, {source: batch}, env)
        channels[output].write.mode("overwrite").parquet(f"{out_path}/batch_id={batch_id}")

    reader = spark.readStream.schema(schema).format(kind)
    reader = reader.option("maxFilesPerTrigger", files_each) if files_each else reader
    return reader.load(path).writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, keys: list[str], window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Counts of each key by event time, for a stream or a table; a stream waits ``late`` for late rows."""
    own = events.withWatermark(time, late) if events.isStreaming else events
    return own.groupBy(F.window(time, window).alias("w"), *keys).agg(F.count(F.lit(1)).alias("n")).select(F.col("w.start").alias("window_start"), *keys, "n")

"""Scoring a file stream with a saved bundle (Structured Streaming).

Every scoring transform is stateless (projections only), so a streaming
DataFrame goes through the same code as a batch one.  The sink is parquet with
a checkpoint location, giving exactly-once file output across restarts; use
``trigger(availableNow=True)`` for incremental batch runs.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.types import StructType


def stream_source(spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet",
                  max_files_per_trigger: int | None = None) -> DataFrame:
    reader = spark.readStream.format(fmt).schema(schema)
    if fmt == "csv":
        reader = reader.option("header", True)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    return reader.load(path)


def score_stream(stream: DataFrame, score: Callable[[DataFrame], DataFrame], sink_path: str,
                 checkpoint_path: str, available_now: bool = True):
    """Apply ``score`` to each micro-batch and append to parquet; returns the query."""
    scored = score(stream)
    writer = (scored.writeStream.format("parquet").option("path", sink_path)
              .option("checkpointLocation", checkpoint_path).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="30 seconds")
    return writer.start()

"""Table sinks: processed tables, clustered rows, predictions."""

from __future__ import annotations

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, fmt: str = "parquet", mode: str = "overwrite",
                partition_by: list[str] | None = None) -> str:
    """Write ``df`` as parquet (default) or headered CSV; returns the path.

    Writes are distributed (one file per task) and atomic per job through
    Spark's commit protocol, so a lost executor only re-runs its tasks.
    """
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if fmt == "csv":
        writer.option("header", True).csv(path)
    else:
        writer.format(fmt).save(path)
    return path

"""Parquet table access and the catalog scan (row and column count per dataset)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TABLE_NAMES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem",
               "events", "documents", "embeddings", "pages", "benchmark", "labels",
               "conversations")


def table_path(sf_dir: str, name: str) -> str:
    return f"{sf_dir.rstrip('/')}/{name}.parquet"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(table_path(sf_dir, name))


def catalog_counts(spark: SparkSession, sources: dict[str, DataFrame]) -> DataFrame:
    """One row per dataset: name, rows, columns.

    ``count()`` on a parquet scan with no projection reads only footers/row-group
    metadata, so this stays cheap however large the files are.
    """
    parts = [
        df.agg(F.count(F.lit(1)).alias("n_rows"))
        .select(F.lit(name).alias("table_name"), "n_rows",
                F.lit(len(df.columns)).cast("bigint").alias("n_cols"))
        for name, df in sources.items()
    ]
    return reduce(DataFrame.unionByName, parts)

"""Intermediate tables in the shared checkpoint folder, dropped as soon as nothing reads them."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from tabwise.session import ensure_checkpoint_dir


class Scratch:
    """A folder of parquet tables under ``spark.checkpoint.dir``.

    ``write`` runs one job and returns a frame that reads the files: lineage is
    cut and a lost executor only re-reads files.  ``drop`` deletes a table that
    no later step reads; tables behind a returned lazy result have to stay.
    """

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{ensure_checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"

    def path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def write(self, df: DataFrame, table: str) -> DataFrame:
        df.write.mode("error").parquet(self.path(table))
        return self.spark.read.schema(df.schema).parquet(self.path(table))

    def drop(self, *tables: str) -> None:
        jvm = self.spark.sparkContext._jvm
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for table in tables:
            path = jvm.org.apache.hadoop.fs.Path(self.path(table))
            path.getFileSystem(conf).delete(path, True)
